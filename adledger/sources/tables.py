"""Readers and writers for pages, batches, verdicts and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from adledger import fixed
from adledger.functions.text import strip
from adledger.operators.verdicts import flatten_verdicts, last_verdicts
from adledger.schemas import AD, PAGE, VERDICT


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON when the path says so, else Parquet; the schema is never inferred."""
    fmt = "json" if path.rstrip("/").endswith((".json", "json")) else "parquet"
    return spark.read.schema(schema).format(fmt).load(path)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Every cached page that names its URL."""
    return read_table(spark, path, PAGE).where("url IS NOT NULL AND url <> ''")


def batch_schema() -> StructType:
    return StructType([StructField("run_date", PAGE["fetched_at"].dataType),
                       StructField("listings", ArrayType(AD)), *AD.fields])


def batch_rows(raw: DataFrame) -> DataFrame:
    """One row per ad of batches read with ``batch_schema``, wrapped or bare."""
    nested = raw.where("listings IS NOT NULL").select("run_date", F.inline("listings"))
    bare = raw.where("listings IS NULL AND url IS NOT NULL").select("run_date", *AD.names)
    return nested.unionByName(bare)


def scan_batch(spark: SparkSession, *paths: str, lines: bool = True) -> DataFrame:
    """Search batches: per line ``{run_date, listings: [...]}``, one ad, or an array of ads.

    Lines let a file be read by many tasks. A file written over several lines needs
    ``lines=False``, and then one task.
    """
    return batch_rows(spark.read.schema(batch_schema()).option("multiLine", not lines).json(list(paths)))


def as_ads(df: DataFrame) -> DataFrame:
    """The full ad shape: missing columns are null, titles are cut, types are fixed."""
    have = set(df.columns)
    defaults = {"type": "unit", "bills_included": "No"}
    cols = []
    for f in AD.fields:
        c = F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))
        if f.name in have and f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]))
        if f.name == "title":
            c = F.substring(F.coalesce(c, F.lit("")), 1, fixed.TITLE_CHARS)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols, *[c for c in df.columns if c not in AD.names])


def scan_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts, nested or flat, blank URLs dropped, the last by ``seq`` of each URL."""
    return last_verdicts(flatten_verdicts(read_table(spark, path, VERDICT)))


def parse_decisions(lines: DataFrame) -> DataFrame:
    """``- [status] url — note`` lines; prose is ignored, the last line per URL wins.

    ``lines`` has ``ord`` (position) and ``value``.
    """
    from adledger.operators.keyed import last_per_key

    def g(i):
        return strip(F.regexp_extract("value", fixed.DECISION_LINE, i))

    rows = lines.where(F.col("value").rlike(fixed.DECISION_LINE)).select(
        "ord", g(2).alias("url"),
        F.coalesce(F.nullif(F.upper(g(1)), F.lit("")), F.lit("SEEN")).alias("status"),
        g(3).alias("note"))
    return last_per_key([rows], [F.col("ord")]).drop("ord")


def scan_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of one or many files, read line by line in many tasks.

    The order is that of the files' names, of the pieces of a file by their first byte,
    and of the lines in a piece, which one task reads in order.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return parse_decisions(spark.read.text(path).select("value", place.alias("ord")))


def apply_decisions(tracker: DataFrame, decisions: DataFrame) -> DataFrame:
    """A person's status and note override the record's."""
    own = decisions.select("url", F.col("status").alias("_s"), F.col("note").alias("_n"))
    return (tracker.join(own, "url", "left")
            .withColumn("decision_note", F.when(F.col("_s").isNotNull(), F.col("_n"))
                        .otherwise(F.col("decision_note")))
            .withColumn("status", F.coalesce("_s", "status")).drop("_s", "_n"))


def write_daily(rows: DataFrame, path: str) -> None:
    """One partition per ``reported_on``; re-running a day replaces only that day."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("reported_on").parquet(path))


def write_queue(queue: DataFrame, path: str) -> None:
    queue.write.mode("overwrite").partitionBy("disposition").parquet(path)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Writes a stage's output and reads it back, so later stages start from it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
