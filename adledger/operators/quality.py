"""Per-source health: coverage, page quality, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adledger import fixed
from adledger.functions.blanks import blank_number, is_true
from adledger.functions.extract import any_amenity
from adledger.operators.rules import row_district


def pct(n: Column, d: Column) -> Column:
    """Whole percent, rounded down; null without a denominator."""
    return F.when(d > 0, F.floor(100 * n / d)).cast("int")


def field_coverage(ads: DataFrame) -> DataFrame:
    """Per source: how many rows state each field."""
    has = {
        "price": ~blank_number(F.col("price_pcm")),
        "beds": ~blank_number(F.col("bed_count")),
        "baths": ~blank_number(F.col("bathrooms"))
        | is_true(F.col("bathrooms_verified_by_search")),
        "size": ~blank_number(F.col("size_sqft")),
        "district": row_district().isNotNull(),
    }
    counts = ads.groupBy("platform").agg(
        F.count("*").alias("n"), *[F.count_if(c).alias("_" + k) for k, c in has.items()])
    return counts.select("platform", "n", *[
        pct(F.col("_" + k), F.col("n")).alias("pct_" + k) for k in has])


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key, the value at position n div 2 of the sorted values.

    Counts per distinct value are combined first, so the window sees one row
    per distinct value, however many rows a key has.
    """
    hist = df.groupBy(key, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(key).orderBy(value)
    upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = hist.groupBy(key).agg(F.sum("_c").alias("_n"))
    cum = hist.withColumn("_upto", upto).join(total, key)
    return (cum.where(F.col("_upto") >= F.floor(F.col("_n") / 2) + 1)
            .groupBy(key).agg(F.min(value).alias("median")))


def page_health(pages: DataFrame) -> DataFrame:
    """Per source: size, thin rate, description rate, amenities, and ``ok``.

    Needs ``source``, ``text`` and ``amenities`` (struct).
    """
    rows = pages.select(
        "source", F.length("text").alias("chars"),
        F.contains("text", F.lit("Description:")).alias("desc"),
        any_amenity(F.col("amenities")).alias("amen"))
    counts = rows.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("chars") < fixed.THIN_CHARS).alias("thin"),
        F.count_if("desc").alias("with_desc"), F.count_if("amen").alias("with_amenity"))
    joined = counts.join(upper_median(rows, "source", "chars"), "source")
    n = F.col("n")
    ok = ((F.col("median") >= fixed.MEDIAN_CHARS) & (F.col("thin") / n <= fixed.THIN_RATE)
          & ((n - F.col("with_desc")) / n <= fixed.NO_DESCRIPTION_RATE))
    return joined.select(
        "source", "n", "median", "thin", pct(F.col("with_desc"), n).alias("pct_desc"),
        pct(F.col("with_amenity"), n).alias("pct_amenity"), ok.alias("ok"))


def readiness(batch_sources: DataFrame, health: DataFrame) -> DataFrame:
    """One row: ready when every sampled source is ok and none was never sampled.

    ``batch_sources`` has ``platform``. No pages at all is ready.
    """
    never = (batch_sources.select(F.col("platform").alias("source")).distinct()
             .join(health.select("source"), "source", "left_anti"))
    marks = health.select(F.lit(1).alias("s"), F.when(~F.col("ok"), 1).otherwise(0).alias("f"),
                          F.lit(0).alias("n")).unionByName(
        never.select(F.lit(0).alias("s"), F.lit(0).alias("f"), F.lit(1).alias("n")))
    totals = marks.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(v) for k, v in
                         (("s", "sampled"), ("f", "failing"), ("n", "never_sampled"))])
    return totals.withColumn("ready", (F.col("sampled") == 0) | (
        (F.col("failing") == 0) & (F.col("never_sampled") == 0)))


def latest_samples(pages: DataFrame, n: int = 5) -> DataFrame:
    """Newest pages without a description per source, and how many there are in all."""
    missing = pages.where(~F.contains("text", F.lit("Description:"))).select(
        "source", "fetched_at", "url")
    newest = Window.partitionBy("source").orderBy(F.col("fetched_at").desc_nulls_first(), F.col("url").desc())
    top = missing.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n)
    total = missing.groupBy("source").agg(F.count("*").alias("total"))
    return top.join(total, "source").withColumn(
        "more", F.greatest(F.col("total") - n, F.lit(0)))


def source_miss_rate(log: DataFrame) -> DataFrame:
    """Per host over a fetch log (``host``, ``outcome`` ok / missed / challenged)."""
    counts = log.groupBy("host").agg(*[
        F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "missed", "challenged")])
    total = F.col("ok") + F.col("missed")
    rate = F.when(total > 0, 100.0 * F.col("missed") / total).otherwise(0.0)
    return counts.withColumn("rate", rate).withColumn(
        "alarm", (rate >= fixed.MISS_RATE_PCT) & (total >= fixed.MISS_MIN_TOTAL))


def run_counters(amenity_rows: DataFrame) -> DataFrame:
    """How many pages gave each amenity (``amenities`` struct), one row per field."""
    fields = ("floor_level", "floor_number", "lift", "concierge", "condition", "size_sqft")
    counts = amenity_rows.agg(*[F.count(F.col("amenities")[f]).alias(f) for f in fields])
    return counts.unpivot([], list(fields), "field", "hits")


def tally(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Counts per key; null and empty keys count as ``(blank)``."""
    named = F.coalesce(F.nullif(key.cast("string"), F.lit("")), F.lit("(blank)"))
    return df.groupBy(named.alias(name)).agg(F.count("*").alias("n"))
