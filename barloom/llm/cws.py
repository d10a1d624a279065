"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are shingles of words, weighted by how often they occur. For a term of weight w,
hashes of the term give r and c from Gamma(2, 1) and b from [0, 1); with t = floor(ln w / r + b) its
rank value is ln c - r (t - b + 1), and the least in a set, with its t, is the sample of the set. Two
sets have the same sample with a probability equal to their generalised Jaccard similarity.

The weight of a term is dealt out over the bins: its n-th occurrence goes to the bin that a hash of
term and n names, and in each bin the term competes with the weight it has there, by r, c and b of
its own. So the sum of the lesser weights over all bins is that of the whole, a bin is a random part
of the weight of both sets, and the share of equal samples among the bins that either set fills has
their generalised Jaccard similarity as its mean, however skewed the weights are. A document costs
one evaluation per term and bin it has weight in, at most one per occurrence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, WIDTH = 128, 5
#: A long holds the bin from bit 56 (at most 128 bins), the rank value in 40 bits, the name in 16.
_SHIFT, _SCALE, _NAME, _BIN = 200.0, float(1 << 32), 16, 56
_LOWEST = -(1 << 63)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the word shingles, repeats included; fewer words than width are one shingle, and no
    words (or null) one empty shingle. Case counts."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def over(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) >= width, many).otherwise(F.array(F.xxhash64(h)))

    return _let(F.transform(found, lambda w: F.xxhash64(w)), over)


def _uniform(term: Column, k: int) -> Column:
    """A number inside (0, 1) from a hash of the term."""
    return (F.shiftrightunsigned(F.xxhash64(term, F.lit(k)), 12).cast("double") + 0.5) * F.lit(2.0**-52)


def _gamma2(term: Column, k: int) -> Column:
    """Gamma(2, 1): the sum of two exponentials."""
    return -F.log(_uniform(term, k) * _uniform(term, k + 1))


def _place(term: Column, occurrence: Column, bins: int, seed: int) -> Column:
    """The bin of an occurrence of the term, counted from 0."""
    return F.pmod(F.xxhash64(term, occurrence.cast("int"), F.lit(seed - 1)), F.lit(bins))


def _sample(term: Column, place: Column, weight: Column | None, seed: int) -> Column:
    """The bin, the rank value of the term with its weight in the bin and the name of (term, t), in one
    long that sorts by bin, then rank value. No weight is a weight of 1."""

    def ranked(own: Column) -> Column:
        r, c, b = _gamma2(own, seed), _gamma2(own, seed + 2), _uniform(own, seed + 4)
        # ln 1 = 0, so t is 0 for a single occurrence
        one = F.lit(0).cast("long")
        t = one if weight is None else F.when(weight == 1, one).otherwise(F.floor(F.log(weight.cast("double")) / r + b))
        rank = F.log(c) - r * (t - b + 1)
        name = F.pmod(F.xxhash64(own, t, F.lit(seed + 5)), F.lit(1 << _NAME))
        high = F.floor((F.greatest(rank, F.lit(-_SHIFT)) + _SHIFT) * _SCALE)
        return F.shiftleft(high, _NAME).bitwiseOR(name)

    return F.shiftleft(place.cast("long"), _BIN).bitwiseOR(_let(F.xxhash64(term, place.cast("int")), ranked))


def _runs(s: Column) -> Column:
    """Where the runs of equal values of a sorted array start."""
    return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))


def _samples(term: Column, weight: Column, bins: int, seed: int) -> Column:
    """The samples of a term in all bins in which it has weight."""

    def over(places: Column) -> Column:
        return _let(_runs(places), lambda starts: F.transform(starts, lambda at, k: _sample(term, F.get(places, at), F.coalesce(F.get(starts, k + 1), F.size(places)) - at, seed)))

    once = _let(_place(term, F.lit(0), bins, seed), lambda place: _sample(term, place, None, seed))
    many = F.sort_array(F.transform(F.sequence(F.lit(0), weight - 1), lambda n: _place(term, n, bins, seed)))
    return F.when(weight == 1, F.array(once)).otherwise(_let(many, over))


def signature(terms: Column, bins: int = BINS, seed: int = 7) -> Column:
    """For each bin that a row's terms fill, its number above 16 bits that name its sample; ascending.

    terms: an array of term hashes in which repeats add weight. The column is a function of the row
    alone: sorted hashes give terms and weights, sorted samples the least of each bin."""

    def weighed(s: Column, starts: Column) -> Column:
        return F.flatten(F.transform(starts, lambda at, k: _samples(F.get(s, at), F.coalesce(F.get(starts, k + 1), F.size(s)) - at, bins, seed)))

    def samples(s: Column) -> Column:
        return F.sort_array(_let(_runs(s), lambda found: weighed(s, found)))

    def least(z: Column) -> Column:
        first = F.filter(z, lambda x, i: (i == 0) | (F.shiftright(x, _BIN) != F.shiftright(F.get(z, i - 1), _BIN)))
        return F.transform(first, lambda x: F.shiftleft(F.shiftright(x, _BIN), _NAME).bitwiseOR(x.bitwiseAND(F.lit((1 << _NAME) - 1))))

    return _let(_let(F.sort_array(terms), samples), least)


def likeness(a: Column, b: Column) -> Column:
    """Equal samples as a share of the bins that either signature fills."""
    bins_of = lambda s: F.transform(s, lambda x: F.shiftright(x, _NAME))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(bins_of(a), bins_of(b)))


def text_of(signature: Column) -> Column:
    """Six hex digits for each filled bin: two of the bin and four of the sample."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def followed(docs: DataFrame, block_rows: int = 2000, most_blocks: int = 1 << 16) -> DataFrame:
    """Rows (block, at, guest, order, text, next_text) in which next_text is that of the next document.

    order is the id, or the least long for null; ties follow each other by text, and the last is followed by the first. Blocks are ranges
    of ids, from approximate quantiles, so each text is shuffled once; the first row of each block is
    also sent as a guest to the block before, to end it. Both lists are bounded by most_blocks."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    rows = docs.select(order.alias("order"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(most_blocks, 1 + rows.count() // block_rows)
    cuts = rows.agg(F.percentile_approx("order", [i / n for i in range(1, n)] if n > 1 else [0.5], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts)) if n > 1 else []
    block = _position(F.col("order"), cuts)
    placed = rows.withColumn("block", block)
    firsts = sorted(placed.groupBy("block").agg(F.min("order").alias("least")).collect())
    spark = docs.sparkSession
    ends = spark.createDataFrame([(r["least"], firsts[i - 1]["block"]) for i, r in enumerate(firsts)], "order long, end int")
    met = placed.join(F.broadcast(ends), "order", "left")
    own = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("guest")))
    guest = F.array(F.struct(F.col("end").alias("block"), F.lit(True).alias("guest")))
    dealt = met.select("text", "order", F.explode_outer(F.when(F.col("end").isNull(), own).otherwise(F.concat(own, guest))).alias("p"))
    dealt = dealt.select("p.block", "p.guest", "order", "text")
    w = Window.partitionBy("block").orderBy("guest", "order", "text")
    out = dealt.withColumn("at", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w))
    return out.select("block", "at", "guest", "order", "text", "next_text")


def _position(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most x: first among every 256th, then among those between."""
    if not cuts:
        return F.lit(0)
    coarse = F.array(*[F.lit(c) for c in cuts[::256]])
    fine = F.array(*[F.array(*[F.lit(c) for c in cuts[i : i + 256]]) for i in range(0, len(cuts), 256)])
    return F.element_at(
        F.transform(
            F.array(F.size(F.filter(coarse, lambda c: c <= x))),
            lambda k: F.when(k == 0, 0).otherwise((k - 1) * 256 + F.size(F.filter(F.get(fine, k - 1), lambda c: c <= x))),
        ),
        1,
    )


def fingerprints(docs: DataFrame, bins: int = BINS, width: int = WIDTH, show: Callable[[Column], Column] = lambda edited: edited) -> DataFrame:
    """For each row: doc_id, n_chars, edited, signature, edited_signature, next_signature.

    edited is show() of the edited text, in which the last floor(n_chars / 2) code points give way to
    the first as many, or all, of the next document. A null text is empty. Rows with equal ids follow
    each other in order of text; equal rows give equal results. A single row is followed by itself;
    an empty table stays empty. Columns other than doc_id and text are not read."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = followed(docs).withColumn("signature", signature(shingles(F.col("text"), width), bins)).withColumn("edited", edited)
    rows = rows.select("block", "at", "guest", "order", n.cast("long").alias("n_chars"), show(F.col("edited")).alias("edited"), "signature", signature(shingles(F.col("edited"), width), bins).alias("edited_signature"))
    rows = rows.withColumn("next_signature", F.lead("signature").over(Window.partitionBy("block").orderBy("at"))).where(~F.col("guest"))
    doc_id = F.when(F.col("order") != _LOWEST, F.col("order")).cast(docs.schema["doc_id"].dataType)
    return rows.select(doc_id.alias("doc_id"), "n_chars", "edited", "signature", "edited_signature", "next_signature")
