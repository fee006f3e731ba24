"""Keyed set work: first or last per key, anti-joins, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adledger.functions.text import strip


def _one_per_key(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Spark keeps one row per key in every map task before the shuffle, so a
    key that holds a large share of all rows costs one row per task."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def trimmed(df: DataFrame, key: str = "url") -> DataFrame:
    """Rows with their key trimmed; a blank key drops the row."""
    return df.withColumn(key, strip(F.col(key))).where(F.col(key) != "")


def first_per_key(df: DataFrame, order: Sequence[Column], key: str = "url") -> DataFrame:
    """First row per trimmed key under a total order; rows with a blank key are dropped."""
    return _one_per_key(trimmed(df, key), key, order)


def last_per_key(parts: Sequence[DataFrame], order: Sequence[Column] = (),
                 key: str = "url") -> DataFrame:
    """Later parts override earlier ones; within a part the last row in ``order`` wins."""
    ranked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    rows = ranked[0]
    for part in ranked[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    newest_first = [F.col("_part").desc(), *[c.desc() for c in order]]
    return _one_per_key(trimmed(rows, key), key, newest_first).drop("_part")


def union_sources(parts: Sequence[DataFrame], order: Sequence[Column]) -> DataFrame:
    """All per-source batches as one, the earliest part winning a repeated URL."""
    rows = parts[0].withColumn("_part", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("_part", F.lit(i)), allowMissingColumns=True)
    return first_per_key(rows, [F.col("_part"), *order]).drop("_part")


def known_url_set(tracker: DataFrame) -> DataFrame:
    return (tracker.select(strip(F.col("url")).alias("url"))
            .where("url <> ''").distinct())


def new_only(batch: DataFrame, known: DataFrame, refresh: bool = False) -> DataFrame:
    """Batch rows whose URL is not tracked. With ``refresh`` all rows stay, flagged."""
    batch, known = trimmed(batch), trimmed(known)
    if not refresh:
        return batch.join(known.select("url"), "url", "left_anti").withColumn(
            "tracked", F.lit(False))
    flag = known.select("url").distinct().withColumn("tracked", F.lit(True))
    return (batch.join(flag, "url", "left")
            .withColumn("tracked", F.coalesce("tracked", F.lit(False))))


def retry_rows(pending: DataFrame, batch: DataFrame, known: DataFrame) -> DataFrame:
    """Stored rows of pending URLs that neither today's batch nor the tracker holds.

    The tracker holds every URL ever seen, so it is not broadcast, whatever its files are estimated at.
    """
    waiting = (trimmed(pending).join(trimmed(batch.select("url")), "url", "left_anti")
               .join(trimmed(known.select("url")).hint("merge"), "url", "left_anti"))
    row = F.col("row").withField("url", F.col("url")).withField("retry", F.lit(True))
    return waiting.select(row.alias("row")).select("row.*")


def cache_presence(df: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``already_cached``: a page for this URL has been read."""
    flag = trimmed(pages.select("url")).distinct().withColumn("already_cached", F.lit(True))
    return (df.withColumn("url", strip(F.col("url"))).join(flag, "url", "left")
            .withColumn("already_cached", F.coalesce("already_cached", F.lit(False))))


def fill_blanks(rows: DataFrame, details: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Detail values fill what the search row left blank.

    ``fields`` maps a column to the condition under which it counts as blank.
    A postcode is also corrected when the row has no district and the page does.
    """
    from adledger.functions.extract import district

    found = details.select("url", *[F.col(n).alias("_d_" + n) for n in fields])
    out = rows.join(found, "url", "left")
    for name, is_blank in fields.items():
        d = F.col("_d_" + name)
        take = is_blank
        if name == "postcode":
            take = take | (district(F.col(name)).isNull() & district(d).isNotNull())
        out = out.withColumn(name, F.when(take & d.isNotNull(), d).otherwise(F.col(name)))
    return out.drop(*["_d_" + n for n in fields])
