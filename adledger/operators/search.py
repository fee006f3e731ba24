"""Search pages: sources, recency windows, empty pages, when a walk may stop."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adledger import fixed
from adledger.functions import extract
from adledger.functions.blanks import is_true
from adledger.functions.extract import found, to_int


def source_lookup(url: Column, registry: Sequence[tuple]) -> Column:
    """Name of the first registry entry (host, name, ...) whose host is in the URL."""
    return F.coalesce(*[F.when(F.contains(url, F.lit(e[0])), e[1]) for e in registry],
                      F.lit(None).cast("string"))


def resolve_source(pages: DataFrame, batch: DataFrame, tracker: DataFrame,
                   registry: Sequence[tuple]) -> DataFrame:
    """Adds ``source_name``: from today's batch, else the tracker, else the URL, else ``?``.

    A URL listed in the batch is not looked up in the tracker, even if its
    source is blank there. ``batch`` and ``tracker`` have unique URLs.
    """
    today = batch.select("url", F.struct("platform").alias("_b"))
    known = tracker.select("url", F.struct("platform").alias("_t"))
    listed = F.coalesce("_b", "_t")["platform"]
    named = F.when(~F.coalesce(listed, F.lit("")).isin("", "?"), listed)
    return (pages.join(today, "url", "left").join(known, "url", "left")
            .withColumn("source_name", F.coalesce(
                named, source_lookup(F.col("url"), registry), F.lit("?")))
            .drop("_b", "_t"))


def region_fallback(df: DataFrame, search_url: str = "search_url",
                    regions: Mapping[str, tuple] = fixed.REGION_DISTRICT) -> DataFrame:
    """Adds region district and name from the search URL; such rows are trusted."""
    key = F.regexp_extract(F.coalesce(F.col(search_url), F.lit("")), fixed.REGION_KEY, 1)

    def pick(i: int) -> Column:
        return F.coalesce(*[F.when(key == k, v[i]) for k, v in regions.items()])

    df = df.withColumn("region_district", pick(0)).withColumn("region_name", pick(1))
    return df.withColumn("area_trusted", F.col("region_district").isNotNull())


def host_subset(df: DataFrame, name: str, url: str = "url") -> DataFrame:
    """Rows whose URL lies on a host with ``name`` in it, in any letter case."""
    return df.where(F.contains(F.lower(extract.host(F.col(url))), F.lit(name.lower())))


def has_param(url: Column, param: str) -> Column:
    return url.rlike("[?&]" + re.escape(param) + "=")


def days_since_run(runs: DataFrame, now: Column) -> Column:
    """Whole days since the newest published run, null before the first one; a scalar subquery.

    ``runs`` has ``updated``. A run that searched and did not publish leaves no row, so the
    next window covers its time too.
    """
    seconds = F.unix_timestamp(now) - F.unix_timestamp(F.max("updated"))
    days = F.when(seconds.isNotNull(), F.greatest(F.lit(0), F.floor(seconds / 86400)))
    return runs.agg(days.cast("int").alias("gap")).scalar()


def recency_window(df: DataFrame, gap_days: Column, first_run_days: int, url: str = "url",
                   windows: Mapping[str, tuple] = fixed.RECENT_WINDOWS) -> DataFrame:
    """Adds ``scoped_url`` and ``window_days``: the URL narrowed to what is new.

    The wanted days snap up to an offered window; wider than all, already set,
    or not offered leaves the URL alone. A null gap is a first run.
    """
    c = F.col(url)
    want = F.coalesce(gap_days + fixed.WINDOW_MARGIN_DAYS, F.lit(first_run_days))
    scoped, days = [], []
    for host, (param, offered) in windows.items():
        here = F.contains(c, F.lit(host))
        steps = sorted(offered)
        value = F.coalesce(*[F.when(want <= d, offered[d]) for d in steps])
        day = F.coalesce(*[F.when(want <= d, d) for d in steps])
        open_ = ~has_param(c, param) & value.isNotNull() & (F.lit(first_run_days) > 0)
        joiner = F.when(F.contains(c, F.lit("?")), "&").otherwise("?")
        scoped.append(F.when(here, F.when(open_, F.concat(
            c, joiner, F.lit(param + "="), value)).otherwise(c)))
        days.append(F.when(here, F.struct(F.when(open_, day).alias("d"))))
    return df.withColumn("scoped_url", F.coalesce(*scoped, c)).withColumn(
        "window_days", F.coalesce(*days)["d"])


def param_drift(urls: DataFrame, thresholds: Mapping[str, int], url: str = "url",
                filters: Mapping[str, tuple] = fixed.URL_FILTERS) -> DataFrame:
    """URL parameters tighter than the criteria, one row per host and parameter value.

    A ceiling below the threshold, or a floor above it, hides ads before they
    are ever fetched.
    """
    from adledger.functions.extract import host

    c = F.col(url)
    entries = []
    for param, (key, kind) in filters.items():
        want = thresholds.get(key, 0)
        if want <= 0:
            continue
        got = found(c, "[?&]" + re.escape(param) + r"=(\d+)").try_cast("int")
        tighter = got < want if kind == "ceiling" else got > want
        entries.append(F.when(tighter, F.struct(
            F.lit(param).alias("param"), F.lit(kind).alias("kind"), got.alias("got"),
            F.lit(want).alias("want"))))
    return (urls.select(host(c).alias("host"), F.array_compact(F.array(*entries)).alias("e"))
            .where(F.size("e") > 0).select("host", F.inline("e")).distinct())


def stated_count(text: Column, url: Column,
                 patterns: Mapping[str, str] = fixed.STATED_COUNT) -> Column:
    """Largest result count the page prints, by its source's pattern."""
    def largest(pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit("(?mi)" + pattern), F.lit(1))
        return F.array_max(F.transform(hits, to_int))

    # one branch per host, first host in the URL wins
    return F.coalesce(*[F.when(F.contains(url, F.lit(h)), F.struct(largest(p).alias("n")))
                        for h, p in patterns.items()])["n"]


def empty_status(page_no: Column, total: Column, text: Column, url: Column,
                 registry: Sequence[tuple] = fixed.PORTALS,
                 windows: Mapping[str, tuple] = fixed.RECENT_WINDOWS,
                 patterns: Mapping[str, str] = fixed.STATED_COUNT) -> Column:
    """What an empty result page means: ``ok``, ``missed``, ``quiet`` or ``empty``.

    ``missed``: the page prints a count, so the extractor failed. ``quiet``: the
    source stated zero under its own recency window.
    """
    stated = stated_count(text, url, patterns)
    zero = F.coalesce(*[F.when(F.contains(url, F.lit(e[0])), F.lit(bool(e[5])))
                        for e in registry], F.lit(False))
    windowed = F.coalesce(*[F.when(F.contains(url, F.lit(h)), has_param(url, spec[0]))
                            for h, spec in windows.items()], F.lit(False))
    return (F.when(page_no > 0, "ok").when(stated > 0, "missed")
            .when(is_true(total == 0) & zero & windowed, "quiet").otherwise("empty"))


def quiet_check(searches: DataFrame) -> DataFrame:
    """Per host: quiet searches with no sibling that found anything are a problem.

    Needs ``host``, ``status`` and ``n_rows``.
    """
    g = searches.groupBy("host").agg(
        F.count_if(F.col("status") == "quiet").alias("quiet"), F.sum("n_rows").alias("found"))
    return g.withColumn("problem", (F.col("quiet") > 0) & (F.col("found") == 0))


def batch_gate(searches: DataFrame) -> DataFrame:
    """Problem rows of a run; the run is clean only if there are none."""
    failed = searches.where(~F.col("status").isin("ok", "quiet")).groupBy(
        "host", F.col("status").alias("problem")).agg(F.count("*").alias("n"))
    unvouched = quiet_check(searches).where("problem").select(
        "host", F.lit("quiet").alias("problem"), F.col("quiet").alias("n"))
    return failed.unionByName(unvouched)


def page_novelty(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Per (search_url, page_no): URLs, URLs new to the search, URLs already tracked.

    ``pages`` has one row per result: ``search_url``, ``page_no``, ``url``.
    """
    first_seen = pages.groupBy("search_url", "url").agg(F.min("page_no").alias("first_page"))
    rows = pages.select("search_url", "page_no", "url").distinct()
    flag = known.select("url").distinct().withColumn("_known", F.lit(1))
    fresh = first_seen.groupBy("search_url", F.col("first_page").alias("page_no")).agg(
        F.count("*").alias("n_new"))
    per_page = rows.join(flag, "url", "left").groupBy("search_url", "page_no").agg(
        F.count("*").alias("n_urls"), F.count("_known").alias("n_known"))
    return per_page.join(fresh, ["search_url", "page_no"], "left").withColumn(
        "n_new", F.coalesce("n_new", F.lit(0)))


def crawl_saturation(pages: DataFrame, known: DataFrame, totals: DataFrame,
                     incremental: bool = True) -> DataFrame:
    """Last page each search needed to read, and why it stopped there.

    ``totals`` has ``search_url``, ``total``, ``page_step``, ``sorted_newest``.
    One window row per page of a search, never one per ad.
    """
    c = F.col
    w = Window.partitionBy("search_url").orderBy("page_no")
    novelty = page_novelty(pages, known).join(totals, "search_url", "left")
    stale = is_true(c("sorted_newest") & F.lit(incremental)
                    & (c("n_known") / c("n_urls") >= fixed.STALE_SHARE))
    rows = (novelty.withColumn("seen", F.sum("n_new").over(w))
            .withColumn("_stale", stale)
            .withColumn("_both", c("_stale") & F.coalesce(F.lag("_stale").over(w), F.lit(False))))
    step = c("page_step")
    reason = (F.when(c("n_new") == 0, "not advancing")
              .when((c("total") > 0) & (c("seen") >= c("total")), "all seen")
              .when((c("total") > 0) & (step > 1) & ((c("page_no") + 1) * step >= c("total")),
                    "last page")
              .when(c("_both"), "already tracked"))
    last = rows.groupBy("search_url").agg(
        F.min(F.when(reason.isNotNull(), F.struct("page_no", reason.alias("why")))).alias("stop"),
        F.max("page_no").alias("walked"))
    return last.select("search_url", F.coalesce("stop.page_no", "walked").alias("last_page"),
                       F.coalesce("stop.why", F.lit("end")).alias("why"))


def partition_reuse(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Which hosts may reuse a stored clean result: same key, nothing else.

    ``requests`` has ``host`` and ``run_key``; ``manifest`` adds ``clean``.
    """
    clean = manifest.where("clean").select("host", "run_key").distinct().withColumn(
        "_hit", F.lit(True))
    return (requests.join(clean, ["host", "run_key"], "left")
            .withColumn("reuse", F.col("_hit").isNotNull()).drop("_hit"))


def run_keys(searches: DataFrame, run_date: Column, incremental: bool) -> DataFrame:
    """Per host: a key over the date, the exact URLs in order and the mode.

    ``searches`` has ``host``, ``ord`` and ``url``. The digest is a sum of one
    hash per (position, URL), so it combines before the shuffle and never
    gathers a host's URLs.
    """
    one = F.conv(F.substring(F.md5(F.concat_ws(" ", F.col("ord").cast("string"), "url")), 1, 15),
                 16, 10).cast("decimal(38,0)")
    return searches.groupBy("host").agg(F.concat_ws(
        "|", run_date.cast("string"), F.lit(str(incremental).lower()),
        F.count("*").cast("string"), F.sum(one).cast("string")).alias("run_key"))
