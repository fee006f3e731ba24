"""Streams over the events table, each run over what is there and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from adledger.catalog import sqlparts as q
from adledger.catalog.registry import query
from adledger.catalog.views import CRIT, HOST, Tables
from adledger.schemas import AD, FLAT_VERDICT, PAGE
from adledger.session import work_dir
from adledger.sources.state import State
from adledger.sources.tables import as_ads
from adledger.streaming import tracker as stream
from adledger.operators import verdicts


def events_stream(t: Tables):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)


SIGHTING = f"concat('https://', {HOST.format('user_id')}, '.example/ad/', user_id)"


def sightings(t: Tables):
    return events_stream(t).select(F.expr(SIGHTING).alias("url"), F.col("ts").cast("timestamp").alias("ts"),
                                   (F.col("event_type") == "purchase").alias("is_read"))


AD_SQL = f"""SELECT {SIGHTING} AS url, CAST('Flat' AS VARCHAR(10)) AS title, 'Alpha' AS platform,
 CAST(floor(value * 40) AS INT) AS price_pcm, CAST(1 + event_id % 4 AS INT) AS bed_count,
 CAST(1 + user_id % 3 AS INT) AS bathrooms, concat('Block ', user_id % 50, ', London SW', 1 + user_id % 12) AS area, event_id
FROM {{events}}"""


@query("stream_upsert", f"""
WITH e AS ({AD_SQL}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY event_id) AS k FROM e) WHERE k = 1),
f AS (SELECT *, CAST(NULL AS VARCHAR) AS postcode, CAST(NULL AS INT) AS size_sqft, CAST(NULL AS DATE) AS available_from, CAST(NULL AS VARCHAR) AS floor_level,
 CAST(NULL AS INT) AS floor_number, CAST(NULL AS VARCHAR) AS lift, CAST(NULL AS VARCHAR) AS concierge, CAST(NULL AS VARCHAR) AS condition, CAST(NULL AS VARCHAR) AS furnished,
 CAST(NULL AS INT) AS size_sqft_plan, CAST(NULL AS BOOLEAN) AS area_trusted, CAST(NULL AS VARCHAR) AS region_district, CAST(NULL AS VARCHAR) AS region_name,
 CAST(NULL AS BOOLEAN) AS bathrooms_verified_by_search, 'unchecked' AS aircon, '' AS aircon_scope FROM b),
g AS (SELECT * FROM f WHERE ({q.rule_code(CRIT)}) IS NULL), {q.ranked('g', CRIT)}
SELECT url, price_pcm, priority, rank_notes AS notes, 'NEW' AS status, '2024-02-01' AS found_on FROM ranked""")
def stream_upsert(t: Tables):
    """Ads arrive as events; every URL counts as read, so new ones go straight in."""
    spark, root = t.spark, work_dir(t.spark, "stream-upsert")
    ads = as_ads(events_stream(t).select(
        F.expr(SIGHTING).alias("url"), F.lit("Flat").alias("title"), F.lit("Alpha").alias("platform"),
        F.floor(F.col("value") * 40).cast("int").alias("price_pcm"),
        (1 + F.col("event_id") % 4).cast("int").alias("bed_count"),
        (1 + F.col("user_id") % 3).cast("int").alias("bathrooms"),
        F.expr("concat('Block ', user_id % 50, ', London SW', 1 + user_id % 12)").alias("area"),
        "event_id"))
    pages = t.events.select(F.expr(SIGHTING).alias("url"), F.lit("").alias("text"),
                            F.lit("2024-01-01").cast("date").alias("fetched_at"))
    none = verdicts.validate_verdicts(spark.createDataFrame([], FLAT_VERDICT),
                                      spark.createDataFrame([], PAGE))
    state = State(spark, root + "/state")
    stream.stream_upsert(ads.select(*AD.names, "event_id"), state, CRIT, [F.col("event_id")], pages,
                         none, root + "/checkpoint", lambda batch_id: dt.date(2024, 2, 1))
    return state.tracker().select("url", "price_pcm", "priority", "notes", "status",
                                  F.col("found_on").cast("string").alias("found_on"))


@query("stream_hold_release", """
WITH k AS (SELECT url, min(ts) AS arrived, min(ts) FILTER (is_read) AS read_at FROM {sightings} GROUP BY 1),
w AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM {sightings})
SELECT url, CASE WHEN read_at < arrived + INTERVAL 7 DAY THEN 'read' ELSE 'overdue' END AS how,
 strftime(CASE WHEN read_at < arrived + INTERVAL 7 DAY THEN read_at ELSE arrived + INTERVAL 7 DAY END, '%Y-%m-%d %H:%M:%S') AS released
FROM k, w WHERE read_at IS NOT NULL OR arrived + INTERVAL 7 DAY <= mark""")
def stream_hold_release(t: Tables):
    root = work_dir(t.spark, "stream-hold")
    stream.write_stream(stream.hold_release(sightings(t)), root + "/out", root + "/checkpoint")
    return t.spark.read.parquet(root + "/out").select(
        "url", "how", F.date_format("released", "yyyy-MM-dd HH:mm:ss").alias("released"))


@query("stream_once", "SELECT DISTINCT url FROM {sightings}")
def stream_once(t: Tables):
    root = work_dir(t.spark, "stream-once")
    stream.append_unreported(stream.report_once(sightings(t).select("url", "ts")),
                             root + "/out", root + "/checkpoint")
    return t.spark.read.parquet(root + "/out").select("url")


@query("late_margin", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM {sightings} GROUP BY 1
HAVING max(date_trunc('day', ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM {sightings})""")
def late_margin(t: Tables):
    root = work_dir(t.spark, "stream-days")
    stream.write_stream(stream.daily_arrivals(sightings(t)), root + "/out", root + "/checkpoint")
    return t.spark.read.parquet(root + "/out").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "n")
