"""The daily run: plan, judge, commit, report, each a chain of DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger import fixed
from adledger.criteria import Criteria
from adledger.functions.extract import amenities
from adledger.functions.blanks import blank_number, blank_text
from adledger.operators import cluster, keyed, report, rules, verdicts
from adledger.operators.upsert import Upsert, upsert
from adledger.schemas import AD
from adledger.session import work_dir
from adledger.sources.state import State
from adledger.sources.tables import apply_decisions, as_ads, write_stage


def plan_queue(batch: DataFrame, known: DataFrame, pages: DataFrame, crit: Criteria,
               order: list[Column], refresh: bool = False) -> DataFrame:
    """Every distinct row of a batch with its ``disposition``.

    ``duplicate`` (tracked already), ``rejected``, ``cached`` or ``fetch``.
    """
    rows = keyed.new_only(keyed.first_per_key(batch, order), known, refresh=True)
    rows = keyed.cache_presence(rows, pages)
    rows = rules.base_tier(rules.hard_filter(rows, crit.columns()), crit.columns())
    skip = F.col("tracked") & ~F.lit(refresh)
    return rows.withColumn("disposition", F.when(skip, "duplicate")
                           .when(F.col("reason").isNotNull(), "rejected")
                           .when(F.col("already_cached"), "cached").otherwise("fetch")
                           ).drop("_notes_base")


def queue_order(*tail: Column) -> list[Column]:
    return [F.col("already_cached"), F.col("tier"), *tail]


def with_retries(batch: DataFrame, pending: DataFrame, tracker: DataFrame) -> DataFrame:
    """Today's batch and the stored rows of pending ads it does not hold.

    The stored rows are found and written first: they are few, and finding them shuffles every URL.
    """
    retries = keyed.retry_rows(pending, batch, keyed.known_url_set(tracker)).select(*AD.names)
    retries = write_stage(retries, work_dir(batch.sparkSession, "retries"))
    return batch.unionByName(retries, allowMissingColumns=True)


def fill_amenities(batch: DataFrame, pages: DataFrame) -> DataFrame:
    """Amenities read in the page prose fill the row's blanks."""
    found = pages.select("url", amenities(F.col("text")).alias("a")).select("url", "a.*")
    text = {n: blank_text(F.col(n)) for n in ("floor_level", "lift", "concierge", "condition")}
    numbers = {n: blank_number(F.col(n)) for n in ("floor_number", "size_sqft")}
    return keyed.fill_blanks(batch, found, {**text, **numbers})


def commit(state: State, batch: DataFrame, raw_verdicts: DataFrame, pages: DataFrame,
           crit: Criteria, run_date: dt.date, order: list[Column], run_id: str,
           review: DataFrame | None = None, refresh: bool = False,
           verdict_order: Sequence[Column] = ()) -> Upsert:
    """Gate, validate, merge and publish one run, over the buckets of the batch alone.

    The verdicts are folded into the store with the fingerprint of their page, in the same
    manifest, so a run is published with its verdicts or not at all. Of several verdicts for one URL the last by ``verdict_order`` counts, or by their ``seq``.
    """
    raw_verdicts = verdicts.last_verdicts(raw_verdicts, verdict_order)
    if review is not None:
        verdicts.require_judged(review, raw_verdicts)
    checked = verdicts.validate_verdicts(raw_verdicts, pages)
    part = state.part(batch)
    out = upsert(as_ads(batch), state.tracker(part), state.pending(part), checked, pages, crit,
                 run_date, order, refresh)
    judged = state.part(raw_verdicts, part)
    store = verdicts.fold_verdicts(state.verdicts(judged), raw_verdicts, pages)
    state.write(out.tracker, out.pending, run_id, dt.datetime.combine(run_date, dt.time()), part, (store, judged))
    return out


class Daily(NamedTuple):
    counts: DataFrame
    table: DataFrame
    links: DataFrame
    ruled_out: DataFrame
    stamped: DataFrame


def daily_report(tracker: DataFrame, pending: DataFrame, decisions: DataFrame,
                 day: dt.date) -> Daily:
    """That day's rows. Publish them first, then ``stamped`` as the next snapshot."""
    on = F.lit(day)
    tracker = apply_decisions(tracker, decisions)
    todays = report.todays_rows(tracker, on)
    live = cluster.cluster_ads(todays.where(rules.is_live(F.col("status"))), columns=report.SHOWN + ("platform",))
    buildings = cluster.building_counts(tracker)
    return Daily(
        report.daily_counts(todays, live, tracker, pending, on),
        report.listing_table(live, buildings), cluster.cluster_links(live),
        report.ruled_out_rows(todays, use_decision=False), report.stamp_reported(tracker, on))


class Shortlist(NamedTuple):
    sections: DataFrame
    table: DataFrame
    ruled_out: DataFrame


def shortlist_report(tracker: DataFrame, decisions: DataFrame,
                     limit_low: int = fixed.SHORTLIST_LOW) -> Shortlist:
    """Everything live, by tier; the last tier is cut to its best clusters."""
    tracker = apply_decisions(tracker, decisions)
    live = cluster.cluster_ads(tracker.where(rules.is_live(F.col("status"))), columns=report.SHOWN + ("platform",))
    summary = cluster.summarise(live)
    shown = cluster.shortlist(summary, limit_low).select("cluster_id")
    table = report.listing_table(live, cluster.building_counts(tracker))
    return Shortlist(cluster.more_than_shown(summary, limit_low),
                     table.join(shown, "cluster_id", "left_semi"),
                     report.ruled_out_rows(tracker, use_decision=True))
