"""Claims and the pages they quote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger import fixed
from adledger.functions.blanks import blank_text, flags_of, is_true
from adledger.functions.terms import context_windows, term_scan
from adledger.functions.text import fingerprint, norm_text, strip
from adledger.operators.keyed import last_per_key
from adledger.schemas import FLAT_VERDICT


class UnjudgedError(RuntimeError):
    """Rows flagged for review still have no verdict."""


def flatten_verdicts(raw: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Nested or flat verdict rows as (url, verdict, scope, evidence, text_sha).

    With ``order``, columns of raw that say which came later, the last one of each URL wins.
    """
    if order:
        raw = last_per_key([raw], order)
    names = ("verdict", "scope", "evidence")
    picked = []
    for n in names:
        options = []
        if "aircon" in raw.columns:
            options.append(F.when(F.col("aircon").isNotNull(), F.col("aircon")[n]))
        if n in raw.columns:
            only_flat = F.col("aircon").isNull() if "aircon" in raw.columns else F.lit(True)
            options.append(F.when(only_flat, F.col(n)))
        picked.append(F.coalesce(*options).alias(n))
    return raw.where(strip(F.col("url")) != "").select(
        strip(F.col("url")).alias("url"), *picked, "text_sha",
        *[c for c in raw.columns if c not in ("url", "aircon", "text_sha", *names)])


def last_verdicts(verdicts: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Flat verdicts, the last one of each trimmed URL.

    ``order`` says which came later, or else the column ``seq`` where there is one; what
    that leaves open is settled by the verdict's own columns.
    """
    order = order or [F.col("seq")] * ("seq" in verdicts.columns)
    return last_per_key([verdicts], [*order, F.col("verdict"), F.col("scope"), F.col("evidence")])


def quoted(text: Column, evidence: Column) -> Column:
    return F.contains(norm_text(text), norm_text(evidence))


def _quotes_found(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, evidence) of asked, once each, with ``_quoted``: the quote is on the page.

    Only here a page's text meets another table, and only the result leaves it.
    """
    asked = asked.select("url", "evidence").distinct()
    return (pages.select("url", "text").join(asked, "url")
            .select("url", "evidence", quoted(F.coalesce("text", F.lit("")), F.col("evidence")).alias("_quoted")))


def validate_verdicts(verdicts: DataFrame, pages: DataFrame) -> DataFrame:
    """Keeps a claim only if its quote occurs on its page.

    One row per verdict: (url, verdict, scope, evidence, checked, flags), and its ``seq``
    where it has one. Texts are looked up for known claims with a quote alone.
    """
    c = F.col
    page = pages.select("url", c("text").isNull().alias("_unread"),
                        F.to_date("fetched_at").alias("_day"), F.lit(True).alias("_page"))
    word, scope = F.lower(strip(c("verdict"))), F.lower(strip(c("scope")))
    later = [n for n in ("seq",) if n in verdicts.columns]
    said = verdicts.select(
        "url", *later, F.coalesce(word, F.lit("")).alias("_v"), F.coalesce(scope, F.lit("")).alias("_s"),
        F.coalesce(strip(c("evidence")), F.lit("")).alias("evidence"))
    claims = said.where(c("_v").isin(*fixed.VERDICTS) & (c("_v") != "unstated") & (c("evidence") != ""))
    df = (said.join(page, "url", "left").join(_quotes_found(claims, pages), ["url", "evidence"], "left")
          .withColumnRenamed("evidence", "_e"))
    no_page = c("_page").isNull()
    unreadable = ~no_page & c("_unread")
    readable = ~no_page & ~unreadable
    known = c("_v").isin(*fixed.VERDICTS)
    claim = readable & known & (c("_v") != "unstated")
    kept = claim & is_true(c("_quoted"))
    scoped = kept & c("_v").isin("yes", "likely")
    a, b = fixed.FLAG["unknown"]
    s, z = fixed.FLAG["scope"]
    flags = flags_of(
        F.when(no_page, fixed.FLAG["no_page"]),
        F.when(unreadable, fixed.FLAG["unreadable"]),
        F.when(readable & ~known, F.concat(F.lit(a), c("_v"), F.lit(b))),
        F.when(claim & (c("_e") == ""), F.concat(c("_v"), F.lit(fixed.FLAG["no_quote"]))),
        F.when(claim & (c("_e") != "") & ~is_true(c("_quoted")), F.concat(c("_v"), F.lit(fixed.FLAG["not_found"]))),
        F.when(scoped & ~c("_s").isin(*fixed.SCOPES),
               F.concat(F.lit(s), c("_s"), F.lit(z))))
    return df.select(
        "url",
        F.when(~readable, "unchecked").when(kept, c("_v")).otherwise("unstated").alias("verdict"),
        F.when(scoped, F.when(c("_s").isin(*fixed.SCOPES), c("_s")).otherwise("unclear"))
        .otherwise("").alias("scope"),
        F.when(kept, c("_e")).otherwise("").alias("evidence"),
        F.when(readable, c("_day")).alias("checked"), flags.alias("flags"), *later)


def _fresh(text: Column, sha: Column, evidence: Column) -> Column:
    """A stored verdict still holds for a page: by fingerprint, or by its quote where it has none."""
    return F.when(blank_text(sha), blank_text(evidence) | quoted(text, evidence)).otherwise(sha == fingerprint(text))


def carry_verdicts(store: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored verdicts whose page is still there, with ``fresh``.

    Fresh: the stored fingerprint is the page's; without a fingerprint, the
    quote is still on the page or there was none. Pages are joined by their
    fingerprints; texts are looked up only for quotes without one.
    """
    c = F.col
    page = pages.select("url", fingerprint(F.coalesce("text", F.lit(""))).alias("_sha"))
    unsigned = store.where(blank_text(c("text_sha")) & ~blank_text(c("evidence")))
    fresh = F.when(blank_text(c("text_sha")), blank_text(c("evidence")) | c("_quoted")
                   ).otherwise(c("text_sha") == c("_sha"))
    names = store.columns
    return (store.join(page, "url").join(_quotes_found(unsigned, pages), ["url", "evidence"], "left")
            .select(*names, is_true(fresh).alias("fresh")))


def rejudge_partition(pages: DataFrame, store: DataFrame, terms=fixed.TERMS,
                      decoys=fixed.DECOYS) -> DataFrame:
    """Every page as ``silent``, ``carried`` or ``review``, with ``rejudge``.

    Only pages that mention a term are looked up in the store, in one join, where the row at
    hand also tells whether the stored verdict is fresh; the others are never shuffled.
    """
    scanned = term_scan(pages, "text", terms, decoys)
    c = F.col
    silent = F.size("terms") == 0
    stored = store.select("url", "verdict", "scope", "evidence", c("text_sha").alias("_sha"), F.lit(True).alias("_stored"))
    fresh = F.when(c("_stored"), is_true(_fresh(F.coalesce("text", F.lit("")), c("_sha"), c("evidence"))))
    looked_up = (scanned.where(~silent).join(stored, "url", "left").withColumn("_fresh", fresh)
                 .withColumn("class", F.when(is_true(c("_fresh")), "carried").otherwise("review"))
                 .withColumn("rejudge", (c("class") == "review") & is_true(~c("_fresh")))
                 .withColumns({n: F.when(c("class") == "carried", c(n))
                               for n in ("verdict", "scope", "evidence")}).drop("_fresh", "_sha", "_stored"))
    nothing = F.lit(None).cast("string")
    quiet = scanned.where(silent).withColumns({
        "class": F.lit("silent"), "rejudge": F.lit(False), "verdict": F.lit("unstated"),
        "scope": nothing, "evidence": nothing})
    return looked_up.unionByName(quiet)


def review_items(partitioned: DataFrame, terms=fixed.TERMS) -> DataFrame:
    """The review table handed to an external judge."""
    rows = partitioned.where("class = 'review'")
    return context_windows(rows, "text", terms).select(
        "url", "terms", F.col("windows").alias("text"),
        F.length("text").alias("text_chars"), fingerprint(F.col("text")).alias("text_sha"),
        "rejudge")


def stamp_verdicts(fresh: DataFrame, pages: DataFrame) -> DataFrame:
    """Fresh verdicts with the fingerprint of the page they were read off."""
    sha = pages.select("url", fingerprint(F.col("text")).alias("_sha"))
    return (fresh.join(sha, "url", "left")
            .withColumn("text_sha", F.coalesce("_sha", "text_sha")).drop("_sha"))


def merge_verdicts(base: DataFrame, fresh: DataFrame, pages: DataFrame,
                   order: Sequence[Column] = ()) -> DataFrame:
    """Base and stamped fresh verdicts, the fresh one winning per URL.

    ``order`` says which of several verdicts in one part came later, or else the column
    ``seq`` where there is one, and the last one wins; what that leaves open is settled
    by the verdict's own columns.
    """
    order = order or [F.col("seq")] * ("seq" in base.columns or "seq" in fresh.columns)
    return last_per_key([base, stamp_verdicts(fresh, pages)],
                        [*order, F.col("verdict"), F.col("scope"), F.col("evidence")])


def fold_verdicts(store: DataFrame, fresh: DataFrame, pages: DataFrame) -> DataFrame:
    """The store with fresh verdicts, one per URL, in place of older ones; blank URLs are left out."""
    if "text_sha" not in fresh.columns:
        fresh = fresh.withColumn("text_sha", F.lit(None).cast("string"))
    return merge_verdicts(store, fresh, pages).select(*FLAT_VERDICT.names)


def unjudged(review: DataFrame, verdicts: DataFrame) -> DataFrame:
    return review.where(strip(F.col("url")) != "").join(
        verdicts.select("url"), "url", "left_anti")


def require_judged(review: DataFrame, verdicts: DataFrame) -> None:
    """Stops the run while a review item has no verdict."""
    missing = unjudged(review, verdicts).select("url").orderBy("url").limit(5).collect()
    if missing:
        raise UnjudgedError("no verdict yet for: " + ", ".join(r.url for r in missing))


def carry_stored(df: DataFrame, old: str = "old") -> DataFrame:
    """Keeps a record's stored verdict, as one unit, when this run has none."""
    o = F.col(old)
    keep = (F.col("aircon") == "unchecked") & o["aircon"].isin(*fixed.VERDICTS)
    new = {"aircon": o["aircon"], "aircon_scope": F.coalesce(o["aircon_scope"], F.lit("")),
           "aircon_evidence": F.coalesce(o["aircon_evidence"], F.lit("")),
           "aircon_checked": o["aircon_checked"]}
    df = df.withColumn("_keep", is_true(keep))
    return df.withColumns({n: F.when(F.col("_keep"), v).otherwise(F.col(n))
                           for n, v in new.items()}).drop("_keep")
