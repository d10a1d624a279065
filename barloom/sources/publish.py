"""Write, audit, publish: a table of parts behind a manifest that is swapped last.

A batch is staged in a folder of its own, audited there, and becomes visible by one new version of the
manifest, the list of (part, batch, rows, fingerprint) that make up the table.  Readers see the newest
complete version, so a batch that fails its audit, or a run that dies anywhere before the swap, leaves
the table as it was.  A batch that is run again rewrites its own folder and ends the same way."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.operators.quality import Rule, violations

MANIFEST = "part string, batch string, n_rows long, fingerprint long"


class Rejected(ValueError):
    """The batch failed its audit; `problems` has (problem, n) and nothing was published."""

    def __init__(self, batch: str, problems: dict[str, int]):
        super().__init__(f"batch {batch} is not published: {problems}")
        self.problems = problems


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions of the manifest, oldest first."""
    fs, at = _fs(spark, f"{root}/manifest")
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at)]
    return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(part, batch, n_rows, fingerprint), one row per part; empty before the first batch."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/v{known[-1] if version is None else version:08d}")


def published(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table that the newest (or the given) version of the manifest lists."""
    listed = manifest(spark, root, version).select("batch", "part").collect()  # a row per part of the table
    if not listed:
        raise FileNotFoundError(f"nothing is published under {root}")
    batches = sorted({r["batch"] for r in listed})
    tables = [spark.read.parquet(f"{root}/batches/{b}").where(F.col("_part").isin(*[r["part"] for r in listed if r["batch"] == b])) for b in batches]
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.drop("_part")


def audit(staged: DataFrame, keys: Sequence[str], contract: Sequence[Rule] | None = None) -> dict[str, int]:
    """What is wrong with a staged batch, by kind; empty if nothing is."""
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    found = {
        "rows without a key": staged.where(null_key).count(),
        "keys that repeat": staged.where(~null_key).groupBy(*keys).count().where("count > 1").count(),
    }
    if contract:
        for r in violations(staged, contract, keys[0]).groupBy("column", "problem").count().collect():  # columns of the contract
            found[f"{r['column']}: {r['problem']}"] = r["count"]
    return {k: n for k, n in found.items() if n}


def publish(df: DataFrame, root: str, batch: str, keys: Sequence[str], part: str, contract: Sequence[Rule] | None = None) -> DataFrame:
    """Publish `df` as `batch`: its parts (values of the column `part`) replace those of earlier batches, other
    parts stay.  Returns the new manifest.

    Raises Rejected, with nothing published, if a key is null or repeats in the batch or the contract is
    broken.  An empty batch changes nothing.  If the same batch is published already with the same rows,
    nothing is written.  A batch name belongs to its rows: other rows under it are an error.  Writers of one
    table take turns; one that finds its version number taken starts over from what the other left."""
    spark = df.sparkSession
    folder = f"{root}/batches/{batch}"
    before = manifest(spark, root)
    if before.where(F.col("batch") == batch).limit(1).count():
        # its files are in use: rows that are the same are done, others need another name
        if _records(spark.read.parquet(folder)).exceptAll(_records(_parted(df, part))).count() == 0:
            return before
        raise ValueError(f"batch {batch} is published with other rows")
    _parted(df, part).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(folder)
    staged = spark.read.schema(_parted(df, part).schema).parquet(folder)
    problems = audit(staged, keys, contract)
    if problems:
        raise Rejected(batch, problems)
    new = _records(staged).withColumn("batch", F.lit(batch)).select("part", "batch", "n_rows", "fingerprint")
    while True:
        known = versions(spark, root)
        kept = manifest(spark, root).join(new.select("part"), "part", "left_anti")
        waiting = f"{root}/manifest/_{batch}"
        kept.unionByName(new).coalesce(1).write.mode("overwrite").parquet(waiting)
        if _swap(spark, waiting, f"{root}/manifest/v{(known[-1] if known else 0) + 1:08d}"):
            return manifest(spark, root)


def _parted(df: DataFrame, part: str) -> DataFrame:
    return df.withColumn("_part", F.coalesce(F.col(part).cast("string"), F.lit("none")))


def _records(staged: DataFrame) -> DataFrame:
    """(part, n_rows, fingerprint): the fingerprint is a sum over rows, whatever their order."""
    rest = sorted(c for c in staged.columns if c != "_part")
    one = F.xxhash64(*rest).bitwiseAND(F.lit((1 << 31) - 1))
    return staged.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(one).alias("fingerprint"))


def _swap(spark: SparkSession, waiting: str, version: str) -> bool:
    """Give the written manifest its version number; false if that number is taken."""
    fs, at = _fs(spark, version)
    if fs.exists(at):
        return False
    try:
        return bool(fs.rename(spark._jvm.org.apache.hadoop.fs.Path(waiting), at))
    except Py4JJavaError:
        return False


def lost_parts(spark: SparkSession, root: str) -> DataFrame:
    """Parts of the published table whose rows are not what the manifest says: (part, n_rows, n_found)."""
    listed = manifest(spark, root)
    found = None
    for b in [r["batch"] for r in listed.select("batch").distinct().collect()]:
        own = _records(spark.read.parquet(f"{root}/batches/{b}")).withColumn("batch", F.lit(b))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return listed.select("part", "n_rows", F.col("n_rows").alias("n_found"))
    both = listed.join(found.toDF("part", "n_found", "_print", "batch"), ["part", "batch"], "left")
    wrong = (F.coalesce("n_found", F.lit(0)) != F.col("n_rows")) | (F.col("_print") != F.col("fingerprint"))
    return both.where(wrong).select("part", "n_rows", F.coalesce("n_found", F.lit(0)).alias("n_found"))
