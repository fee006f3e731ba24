"""Counts, deltas and display rows over the tracker."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger import fixed
from adledger.functions import extract
from adledger.functions.blanks import blank_number, is_true, some_number, some_text
from adledger.operators import cluster, rules
from adledger.operators.quality import tally

DASH = "–"


# --- counts -------------------------------------------------------------------

def snapshot(tracker: DataFrame) -> DataFrame:
    """One row: tracked, live, ruled out, in-unit, unreported, verdicts of live rows."""
    live = rules.is_live(F.col("status"))
    hit = rules.in_unit(F.col("aircon"), F.col("aircon_scope"))
    named = F.coalesce(some_text(F.col("aircon")), F.lit("(blank)"))
    # two levels: per verdict first, then one row
    per = tracker.groupBy(named.alias("verdict")).agg(
        F.count("*").alias("tracked"), F.count_if(live).alias("live"),
        F.count_if(live & hit).alias("hits"),
        F.count_if(live & F.col("reported_on").isNull()).alias("unreported"))
    entry = F.when(F.col("live") > 0, F.struct("verdict", "live"))
    return per.agg(
        F.coalesce(F.sum("tracked"), F.lit(0)).alias("tracked"),
        F.coalesce(F.sum("live"), F.lit(0)).alias("live"),
        F.coalesce(F.sum(F.col("tracked") - F.col("live")), F.lit(0)).alias("ruled_out"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("aircon_live"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("aircon_in_unit"),
        F.coalesce(F.sum("unreported"), F.lit(0)).alias("unreported"))


def verdict_counts(snap: DataFrame) -> DataFrame:
    return snap.select(F.explode("aircon_live").alias("verdict", "n"))


def baseline_delta(now: DataFrame, base: DataFrame, today: Column) -> DataFrame:
    """Counts beside a stored baseline: measure, before, after, diff, stale, basis.

    ``base`` has ``taken_on`` and one row, or none before the first baseline. With one,
    only changed counts are listed, and ``basis`` says whether it is of ``today`` or of
    an ``earlier`` day. Without one every count is listed, with basis ``missing`` and
    neither before nor diff: a running total, which is not a change from zero.
    """
    names = ["tracked", "live", "ruled_out", "aircon_in_unit", "unreported"]
    before = base.select("taken_on", *names).unpivot(["taken_on"], names, "measure", "before")
    after = now.unpivot([], names, "measure", "after")
    c = F.col
    basis = F.when(c("taken_on").isNull(), "missing").when(c("taken_on") == today, "today").otherwise("earlier")
    # a measure that an older baseline did not record counts from zero
    diff = F.when(c("taken_on").isNotNull(), F.coalesce(c("after"), F.lit(0)) - F.coalesce(c("before"), F.lit(0)))
    return (after.join(before, "measure", "full_outer")
            .select("measure", "before", "after", diff.alias("diff"), (c("taken_on") != today).alias("stale"), basis.alias("basis"))
            .where("diff IS NULL OR diff <> 0"))


def report_tallies(tracker: DataFrame) -> DataFrame:
    """Priority and verdict by live / ruled out, and status overall, in one scan."""
    rows = tracker.select(
        rules.is_live(F.col("status")).alias("is_live"),
        F.coalesce(some_text(F.col("priority")), F.lit("(blank)")).alias("priority"),
        rules.verdict_label(F.col("aircon"), F.col("aircon_scope")).alias("verdict"),
        F.coalesce(some_text(F.col("status")), F.lit("(blank)")).alias("status"))
    sets = rows.groupingSets(
        [[F.col("is_live"), F.col("priority")], [F.col("is_live"), F.col("verdict")],
         [F.col("status")]],
        "is_live", "priority", "verdict", "status").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"))
    field = F.when(F.col("g") == 3, "priority").when(F.col("g") == 5, "verdict").otherwise("status")
    return sets.select(field.alias("field"), "is_live",
                       F.coalesce("priority", "verdict", "status").alias("key"), "n")


def waiting_counts(tracker: DataFrame, pending: DataFrame) -> DataFrame:
    """Unread live rows, unread ruled-out rows, unreported rows, pending entries."""
    live = rules.is_live(F.col("status"))
    unread = F.col("aircon") == "unchecked"
    rows = tracker.select(
        F.when(is_true(unread & live), 1).otherwise(0).alias("unread_live"),
        F.when(is_true(unread & ~live), 1).otherwise(0).alias("unread_ruled_out"),
        F.when(live & F.col("reported_on").isNull(), 1).otherwise(0).alias("unreported"),
        F.lit(0).alias("waiting"))
    parked = pending.select(*[F.lit(0).alias(n) for n in
                              ("unread_live", "unread_ruled_out", "unreported")],
                            F.lit(1).alias("waiting"))
    both = rows.unionByName(parked)
    return both.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in both.columns])


def daily_index(tracker: DataFrame) -> DataFrame:
    """Report days, newest first, with that day's live count."""
    return (tracker.where("reported_on IS NOT NULL").groupBy("reported_on")
            .agg(F.count_if(rules.is_live(F.col("status"))).alias("n_live"))
            .orderBy(F.col("reported_on").desc()))


# --- display cells ------------------------------------------------------------

def money_cell(price: Column) -> Column:
    return F.coalesce(F.concat(F.lit("£"), F.format_number(price, 0)), F.lit("?"))


def cell(value: Column, dash: str = DASH) -> Column:
    v = value.cast("string")
    known = v.isNotNull() & ~v.isin("", "Unknown")
    return F.when(known, F.replace(v, F.lit("|"), F.lit("/"))).otherwise(dash)


def size_cell(size: Column, plan: Column) -> Column:
    """A stated size, else a plan's size marked as such."""
    return (F.when(~blank_number(size), size.cast("string"))
            .when(~blank_number(plan), F.concat(F.lit("~"), plan.cast("string"), F.lit("*")))
            .otherwise(DASH))


def area_name(district: Column, areas: Mapping[str, str] = fixed.AREAS) -> Column:
    """Neighbourhood of a district; a sub-district without one falls back to its parent."""
    lookup = F.create_map(*[F.lit(x) for kv in areas.items() for x in kv])
    d = F.upper(district)
    parent = F.regexp_replace(d, "[A-Z]$", "")
    return F.coalesce(F.element_at(lookup, d), F.element_at(lookup, parent))


def area_cell(postcode: Column, area: Column, areas: Mapping[str, str] = fixed.AREAS) -> Column:
    """The address, with its neighbourhood unless the address already says it."""
    address = cell(F.coalesce(F.nullif(postcode, F.lit("")), area))
    name = area_name(extract.district(postcode, area), areas)
    said = F.exists(F.split(name, "/"),
                    lambda part: F.contains(F.lower(address), F.lower(F.trim(part))))
    return F.when(name.isNotNull() & ~said, F.concat(
        address, F.lit(" · _"), name, F.lit("_"))).otherwise(address)


def flag_cell() -> Column:
    """Notable facts of a record. A lift needs a stated yes."""
    c = F.col
    verdict, scope = c("aircon"), c("aircon_scope")
    condition = F.coalesce(c("condition"), F.lit(""))
    flags = F.array_compact(F.array(
        F.when(rules.in_unit(verdict, scope), "**A/C**")
        .when(verdict.isin("yes", "likely"), F.when(
            scope == "communal_only", "A/C communal only")
            .otherwise("A/C, not clearly in the unit")),
        F.when(some_text(c("concierge")).isNotNull(), "concierge"),
        F.when(F.lower(c("lift")) == "yes", "lift"),
        F.when(F.contains(F.lower(condition), F.lit("refurb")), condition)
        .when(condition == "new_build", "new build")))
    return F.when(F.size(flags) > 0, F.array_join(flags, ", ")).otherwise(DASH)


def display_cells(df: DataFrame, areas: Mapping[str, str] = fixed.AREAS) -> DataFrame:
    c = F.col
    return df.select(
        "url", money_cell(c("price_pcm")).alias("price"),
        area_cell(c("postcode"), c("area"), areas).alias("area"),
        size_cell(c("size_sqft"), c("size_sqft_plan")).alias("sqft"),
        cell(F.coalesce(some_text(c("floor_level")), some_number(c("floor_number"))
                        .cast("string"))).alias("floor"),
        F.concat_ws("/", cell(c("bedrooms"), "?"), cell(c("bathrooms"), "?")).alias("beds_bath"),
        flag_cell().alias("flags"))


SHOWN = ("price_pcm", "postcode", "area", "size_sqft", "size_sqft_plan", "floor_level", "floor_number", "bedrooms", "bathrooms",
         "aircon", "aircon_scope", "concierge", "lift", "condition", "furnished", "priority", "addr_key", "outcode")


def listing_table(clustered: DataFrame, buildings: DataFrame,
                  areas: Mapping[str, str] = fixed.AREAS) -> DataFrame:
    """One display row per cluster: its best ad's cells and what shares its block.

    The links of a cluster are the rows of ``cluster.cluster_links``.
    """
    c = F.col
    best = clustered.where("url = cluster_id")
    cells = display_cells(best, areas)
    facts = cluster.cluster_facts(clustered).drop("links")
    units = cluster.units_in_building(
        best.select("url", "addr_key", "outcode", "priority", "ad_rank"), buildings
    ).select("url", "priority", "ad_rank", "units")
    rows = (cells.join(units, "url").withColumnRenamed("url", "cluster_id")
            .join(facts, "cluster_id"))
    extra = F.array_join(F.array_compact(F.array(
        F.when(c("n_ads") > 1, F.concat(c("n_ads").cast("string"), F.lit(" near-identical ads"))),
        F.when(c("units") > c("n_ads"), F.concat(
            c("units").cast("string"), F.lit(" units in this building"))))), "; ")
    notable = (F.when(extra == "", c("flags")).when(c("flags") == DASH, extra)
               .otherwise(F.concat_ws(" · ", c("flags"), extra)))
    return rows.select("cluster_id", "priority", "ad_rank", "price", "area", "sqft", "floor",
                       "beds_bath", "furnishing", notable.alias("notable"), "n_ads")


# --- the daily delta ----------------------------------------------------------

def todays_rows(tracker: DataFrame, day: Column) -> DataFrame:
    """Unreported rows that are not held, and rows already reported that day."""
    fresh = F.col("reported_on").isNull() & ~rules.held(day)
    return tracker.where(fresh | is_true(F.col("reported_on") == day))


def daily_counts(todays: DataFrame, clustered: DataFrame, tracker: DataFrame,
                 pending: DataFrame, day: Column) -> DataFrame:
    """One row: new, distinct, in-unit flats and ads, ruled out, waiting."""
    live = rules.is_live(F.col("status"))
    zero = ("n_new", "n_ruled_out", "distinct_flats", "flats_in_unit", "ads_in_unit", "waiting")

    def part(df: DataFrame, **cols: Column) -> DataFrame:
        return df.select(*[cols.get(n, F.lit(0)).cast("bigint").alias(n) for n in zero])

    summary = cluster.summarise(clustered)
    one = F.lit(1)
    rows = (part(todays, n_new=live.cast("int"), n_ruled_out=(~live).cast("int"))
            .unionByName(part(summary, distinct_flats=one,
                              flats_in_unit=F.col("in_unit").cast("int"),
                              ads_in_unit=F.col("n_hits")))
            .unionByName(part(tracker.where(rules.held(day)), waiting=one))
            .unionByName(part(pending, waiting=one)))
    return rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in zero])


def ruled_out_rows(rows: DataFrame, use_decision: bool) -> DataFrame:
    """Dead rows with the reason shown for each."""
    c = F.col
    status = F.lower(F.coalesce("status", F.lit("")))
    fallback = F.coalesce(some_text(c("decision_note")), status) if use_decision else status
    return rows.where(~rules.is_live(c("status"))).select(
        "url", "platform", rules.why_ruled_out(c("notes"), fallback).alias("why"),
        money_cell(c("price_pcm")).alias("price"), "notes")


def stamp_reported(tracker: DataFrame, day: Column) -> DataFrame:
    """The next snapshot: everything shown that day carries its date."""
    shown = F.col("reported_on").isNull() & ~rules.held(day)
    return tracker.withColumn("reported_on", F.when(shown, day).otherwise(F.col("reported_on")))


def field_tally(tracker: DataFrame, field: str) -> DataFrame:
    return tally(tracker, F.col(field))
