"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import bpe, clustering, cws, hmm, language, lines, mixing, private, ranked, simhash, suffixes, supervision, toxicity
from barloom.llm.text import fold, table, written


def op1_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every document under a hidden Markov model of the documents outside a fold."""
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1
    found = hmm.fit_and_score(docs, ~held_out, keep=(held_out.alias("held_out"),))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document without those in 100-byte strings that start earlier."""
    found = suffixes.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document from rules that vote or abstain."""
    kept = supervision.keep(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones outside a fold."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = fold(F.col("doc_id"), 5) == 0
    return found.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op7_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    found = cws.fingerprints(table(spark, sf_dir, "documents"), show=lambda edited: F.sha2(edited.cast("binary"), 256))
    return found.select(
        "doc_id",
        "n_chars",
        F.col("edited").alias("edited_sha256"),
        cws.text_of(F.col("signature")).alias("fingerprint"),
        cws.text_of(F.col("edited_signature")).alias("edited_fingerprint"),
        cws.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        cws.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those with a language outside a fold."""
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    held_out = fold(F.col("doc_id"), 3) == 1
    found = language.identify(docs.select("doc_id", "text"), language.train(docs, path, ~held_out), path)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible lines of every page without those on more than a tenth of the host's pages."""
    # written once: the patterns that find the lines cost more than all that follows, which reads them twice
    pages = table(spark, sf_dir, "pages").select("page_id", lines.host_of(F.col("url")).alias("host"), lines.visible_lines(F.col("html")).alias("text"))
    kept = lines.drop_boilerplate(written(pages, "pages"), F.col("host"), ratio=0.1)
    return kept.select("page_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), "text")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    index = ranked.build(table(spark, sf_dir, "documents"))
    return ranked.search(index, table(spark, sf_dir, "benchmark"), 50)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: the counts and base_sha256 are of what stands plainly, spans has the disguised as well."""
    found = private.find(table(spark, sf_dir, "documents"))
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kind_no = lambda s: F.array_position(F.array(*map(F.lit, private.KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(F.concat("plain", "added"), lambda s: F.struct(s["start"].alias("start"), kind_no(s).alias("no"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = lambda kind: F.size(F.filter("plain", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, private.KINDS), F.sha2(text_of(F.col("plain")).cast("binary"), 256).alias("base_sha256"), text_of(ordered).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding after five rounds from forty first centroids."""
    found = clustering.cluster(table(spark, sf_dir, "embeddings"), n_clusters=40, rounds=5)
    totals = found.totals()  # forty rows at most
    inertia = totals.agg(F.sum("cluster_inertia").alias("inertia")).scalar()
    rows = found.assigned.join(F.broadcast(totals), "cluster").withColumn("inertia", inertia)
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql_text(html: str) -> str:
    text = f"regexp_replace({html}, '{lines.HIDDEN}', chr(10), 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{lines.BREAKS}', chr(10), 'g'), '{lines.TAGS}', '', 'g')"
    for name, char in lines.ENTITIES:
        quoted = char.replace("'", "''")
        text = f"replace({text}, '{name}', '{quoted}')"
    return text


_OP10 = f"""
WITH page AS (
  SELECT row_number() OVER () AS r, page_id,
         coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
         {_sql_text("html")} AS text
  FROM pages),
line AS (
  SELECT r, host, i, list_extract(parts, i) AS line
  FROM (SELECT r, host, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM page WHERE text IS NOT NULL)),
total AS (SELECT host, count(*) AS n_pages FROM page GROUP BY host),
often AS (
  SELECT host, trim(line) AS line FROM line JOIN total USING (host) WHERE trim(line) <> ''
  GROUP BY host, trim(line), n_pages HAVING count(DISTINCT r) > 0.1::DOUBLE * n_pages AND count(DISTINCT r) > 1),
kept AS (
  SELECT l.r, count(*) AS n_lines, count(o.line) AS n_dropped, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (o.line IS NULL) AS text
  FROM line l LEFT JOIN often o ON o.host = l.host AND o.line = trim(l.line) GROUP BY l.r)
SELECT page_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN page.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM page LEFT JOIN kept USING (r)"""


_OP11 = """
WITH word AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
posting AS (SELECT r, doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
doc AS (SELECT r, sum(tf)::BIGINT AS n FROM posting GROUP BY r),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM doc),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM posting, total GROUP BY term),
asked AS (
  SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))),
scored AS (
  SELECT q, item_id, p.r, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN posting p USING (term) JOIN weight USING (term) JOIN doc USING (r), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 50"""


def _sql_rounds(rounds: int) -> str:
    """Centroids c0, c1, ... and the assignments a1, a2, ... between them; all whole numbers."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""d{k} AS (SELECT vec_id, cluster, sum((x - c) * (x - c))::BIGINT AS distance FROM v JOIN c{k} USING (d) GROUP BY vec_id, cluster),
a{k} AS (SELECT vec_id, cluster, distance FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if k < rounds:
            out.append(f"""m{k} AS (SELECT cluster, d, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN v USING (vec_id) GROUP BY cluster, d),
c{k + 1} AS (SELECT cluster, d, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{k} LEFT JOIN m{k} USING (cluster, d))""")
    return ",\n".join(out)


_OP13 = f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS d, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept),
c0 AS (
  SELECT cluster, d, x AS c
  FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < 40) JOIN v USING (vec_id)),
{_sql_rounds(5)}
SELECT vec_id, cluster::INTEGER AS cluster, distance,
       (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a5 JOIN (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c5 GROUP BY cluster) USING (cluster)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (op1_hmm_scoring, op2_simhash, op3_byte_bpe, op4_suffix_dedup, op5_quality_rules, op6_toxicity, op7_weighted_sampling, op8_mix_sources, op9_language, op10_line_dedup, op11_ranked_search, op12_personal_data, op13_clustering)}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": _OP10, "op11_ranked_search": _OP11, "op13_clustering": _OP13} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
