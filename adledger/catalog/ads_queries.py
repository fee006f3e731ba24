"""Filters, ranking, keyed joins and ordering over ads."""

from __future__ import annotations

from pyspark.sql import functions as F

from adledger import fixed
from adledger.catalog import sqlparts as q
from adledger.catalog.registry import query
from adledger.catalog.views import CRIT, ORDER, STRICT, Tables
from adledger.functions import extract, sql
from adledger.functions.blanks import uninformative
from adledger.operators import keyed, report, rules, search
from adledger.plans import daily
from adledger.sources.tables import as_ads

ORDER_BY = "o1, o2, o3, o4, o5, o6, o7, o8, o9"


def order():
    return [F.col(c) for c in ORDER]


@query("first_per_key", """
SELECT url, o1, o2, o3, o4 FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY """ + ORDER_BY + """) AS k
FROM {ads_raw} WHERE trim(url) <> '') WHERE k = 1""")
def first_per_key(t: Tables):
    return keyed.first_per_key(t.ads_raw, order()).select("url", "o1", "o2", "o3", "o4")


@query("hard_filter", f"""
SELECT url, {q.rule_code(CRIT)} AS rule_code, {q.rule_code(CRIT, True)} AS reason FROM {{ads}}""")
def hard_filter(t: Tables):
    return rules.hard_filter(t.ads, CRIT.columns()).select("url", "rule_code", "reason")


@query("rejection_counts", f"""
SELECT coalesce(rule_code, 'kept') AS rule_code, count(*) AS n
FROM (SELECT {q.rule_code(CRIT)} AS rule_code FROM {{ads}}) GROUP BY 1""")
def rejection_counts(t: Tables):
    return rules.rejection_counts(rules.hard_filter(t.ads, CRIT.columns()))


@query("blank_defaults", """
SELECT url, left(coalesce(title, ''), 120) AS title, platform, 'unit' AS type, area, postcode, price_pcm,
 'No' AS bills_included, CAST(available_from AS VARCHAR) AS available_from, bed_count, size_sqft_plan FROM {ads_raw}""")
def blank_defaults(t: Tables):
    bare = t.ads_raw.select("url", "title", "platform", "area", "postcode", "price_pcm",
                            "available_from", "bed_count", "size_sqft_plan")
    return as_ads(bare).select(
        "url", "title", "platform", "type", "area", "postcode", "price_pcm", "bills_included",
        F.col("available_from").cast("string").alias("available_from"), "bed_count",
        "size_sqft_plan")


def _tier_query(name: str, column: str, crit, rule, notes: str):
    @query(name, f"""WITH {q.ranked('{ads}', crit)} SELECT url, {column} AS tier, {notes} AS notes FROM ranked""")
    def run(t: Tables):
        df = t.ads
        for step in (rules.base_tier, rules.amenity_tier, rules.aircon_tier, rules.ceiling_tier):
            df = step(df, crit.columns())
            if step is rule:
                break
        name = "_notes_" + rule.__name__.split("_")[0]
        return df.select("url", "tier", F.col(name).alias("notes"))
    return run


_tier_query("base_tier", "t0", CRIT, rules.base_tier, "n0")
_tier_query("amenity_tier", "t4", CRIT, rules.amenity_tier, "n1")
_tier_query("aircon_tier", "t5", STRICT, rules.aircon_tier, "n2")
_tier_query("ceiling_tier", "tier", STRICT, rules.ceiling_tier, "n3")


@query("rank_ads", f"""WITH kept AS (SELECT * FROM {{ads}} WHERE ({q.rule_code(CRIT)}) IS NULL),
{q.ranked('kept', CRIT)} SELECT url, price_pcm, tier, priority, rank_notes FROM ranked""")
def rank_ads(t: Tables):
    kept = rules.hard_filter(t.ads, CRIT.columns()).where("reason IS NULL")
    return rules.rank_ads(kept, CRIT.columns()).select(
        "url", "price_pcm", "tier", "priority", "rank_notes")


def ordered_ads(ads):
    """Filter, rank and order a batch: all its rows in rank order."""
    kept = rules.hard_filter(ads, CRIT.columns()).where("reason IS NULL")
    ranked = rules.rank_ads(kept, CRIT.columns())
    return ranked.orderBy(*rules.rank_order()).select(
        "url", "title", "platform", "price_pcm", "tier", "priority",
        "rank_notes")


def shortlist_of(ads, n: int = 50):
    """Flagship: the first rows of a batch in rank order."""
    return ordered_ads(ads).limit(n)


@query("rank_order", f"""WITH kept AS (SELECT * FROM {{ads}} WHERE ({q.rule_code(CRIT)}) IS NULL),
{q.ranked('kept', CRIT)} SELECT url, title, platform, price_pcm, tier, priority, rank_notes FROM ranked
ORDER BY {q.RANK_ORDER}""")
def rank_order(t: Tables):
    return ordered_ads(t.ads)


@query("district", f"""SELECT url, {q.district()} AS district FROM {{ads_raw}}""")
def district(t: Tables):
    return t.ads_raw.select(
        "url", extract.district(F.col("postcode"), F.col("area")).alias("district"))


@query("sql_district", f"""SELECT url, {q.district()} AS district FROM {{ads_raw}}""")
def sql_district(t: Tables):
    sql.register(t.spark)
    return t.sql("SELECT url, district(postcode, area) AS district FROM {ads_raw}")


@query("district_tier", f"""SELECT url, d AS district, {q.tier_of('d', CRIT)} AS tier
FROM (SELECT url, {q.district()} AS d FROM {{ads}})""")
def district_tier(t: Tables):
    d = extract.district(F.col("postcode"), F.col("area"))
    return t.ads.select("url", d.alias("district")).withColumn(
        "tier", rules.tier_of(F.col("district"), (CRIT.prime, CRIT.affluent, CRIT.fringe)))


AREA_ROWS = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in fixed.AREAS.items())


@query("area_name", f"""WITH names(district, name) AS (VALUES {AREA_ROWS}),
a AS (SELECT url, {q.district()} AS d FROM {{ads}})
SELECT a.url, coalesce(e.name, p.name) AS name FROM a LEFT JOIN names e ON e.district = a.d
LEFT JOIN names p ON p.district = regexp_replace(a.d, '[A-Z]$', '')""")
def area_name(t: Tables):
    d = extract.district(F.col("postcode"), F.col("area"))
    return t.ads.select("url", report.area_name(d).alias("name"))


_REGIONS = {"REGION%5E1127": ("TW9", "Richmond"), "REGION%5E1368": ("TW1", "Twickenham")}
_REGION_URL = ("concat('https://alpha.example/s?locationIdentifier=', "
               "CASE ok % 3 WHEN 0 THEN 'REGION%5E1127' WHEN 1 THEN 'REGION%5E1368' ELSE 'REGION%5E9' END, '&x=1')")


@query("region_fallback", """
SELECT url, CASE ok % 3 WHEN 0 THEN 'TW9' WHEN 1 THEN 'TW1' END AS region_district,
 CASE ok % 3 WHEN 0 THEN 'Richmond' WHEN 1 THEN 'Twickenham' END AS region_name, ok % 3 <> 2 AS area_trusted FROM {ads}""")
def region_fallback(t: Tables):
    ads = t.ads.select("url", F.expr(_REGION_URL).alias("search_url"))
    return search.region_fallback(ads, regions=_REGIONS).drop("search_url")


ADDR_KEY_SQL = r"""
WITH w AS (SELECT url, list_filter(string_split(regexp_replace(lower(coalesce(nullif(postcode, ''), area, '')), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM {ads})
SELECT url, left(array_to_string(list_filter(words, lambda x, i: NOT regexp_full_match(x, '[a-z]{1,2}\d{1,2}[a-z]?')
 AND NOT (regexp_full_match(x, '\d[a-z]{2}') AND i > 1 AND regexp_full_match(words[i - 1], '[a-z]{1,2}\d{1,2}[a-z]?'))
 AND x NOT IN ('london', 'the', 'uk', 'greater')), ' '), 40) AS addr_key FROM w"""


@query("addr_key", ADDR_KEY_SQL)
def addr_key(t: Tables):
    return t.ads.select("url", extract.addr_key(F.col("postcode"), F.col("area")).alias("addr_key"))


@query("sql_addr_key", ADDR_KEY_SQL)
def sql_addr_key(t: Tables):
    sql.register(t.spark)
    return t.sql("SELECT url, addr_key(postcode, area) AS addr_key FROM {ads}")


@query("postcode_parts", r"""
SELECT url, nullif(regexp_extract(upper(coalesce(nullif(postcode, ''), area, '')), '\b([A-Z]{1,2}\d{1,2}[A-Z]?)(?:\s+(\d[A-Z]{2}))?\b', 1), '') AS outcode,
 nullif(regexp_extract(upper(coalesce(nullif(postcode, ''), area, '')), '\b([A-Z]{1,2}\d{1,2}[A-Z]?)(?:\s+(\d[A-Z]{2}))?\b', 2), '') AS incode FROM {ads}""")
def postcode_parts(t: Tables):
    p, a = F.col("postcode"), F.col("area")
    return t.ads.select("url", extract.outcode(p, a).alias("outcode"),
                        extract.incode(p, a).alias("incode"))


@query("furnishing_of", f"""SELECT url, {q.furnishing('part furnished', 'unfurnished')} AS furnishing FROM {{ads}}""")
def furnishing_of(t: Tables):
    return t.ads.select("url", extract.furnishing_of(
        F.col("furnished"), F.lit("unfurnished")).alias("furnishing"))


@query("furnishing_label", f"""SELECT url, {q.furnishing('part', 'either')} AS label FROM {{ads}}""")
def furnishing_label(t: Tables):
    return t.ads.select("url", extract.furnishing_label(F.col("furnished")).alias("label"))


# --- keyed joins ---------------------------------------------------------------

@query("new_only", "SELECT url, title FROM {ads} a WHERE NOT EXISTS (SELECT 1 FROM {tracker} t WHERE t.url = a.url)")
def new_only(t: Tables):
    return keyed.new_only(t.ads, t.tracker).select("url", "title")


@query("new_only_refresh", """
SELECT a.url, a.title, t.url IS NOT NULL AS tracked FROM {ads} a LEFT JOIN (SELECT DISTINCT url FROM {tracker}) t ON t.url = a.url""")
def new_only_refresh(t: Tables):
    return keyed.new_only(t.ads, t.tracker, refresh=True).select("url", "title", "tracked")


def pending_table(t: Tables):
    from adledger.schemas import AD
    return t.pending_flat.select(
        "url", "first_seen", "attempts", "last_tried", F.col("last_sighted").alias("last_seen"),
        F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in AD.fields]).alias("row"))


@query("retry_rows", """
SELECT url, title, price_pcm, true AS retry FROM {pending_flat} p
WHERE NOT EXISTS (SELECT 1 FROM {batch} b WHERE b.url = p.url) AND NOT EXISTS (SELECT 1 FROM {tracker} t WHERE t.url = p.url)""")
def retry_rows(t: Tables):
    return keyed.retry_rows(pending_table(t), t.batch, keyed.known_url_set(t.tracker)).select(
        "url", "title", "price_pcm", "retry")


@query("pending_order", "SELECT url, CAST(first_seen AS VARCHAR) AS first_seen, attempts FROM {pending_flat} ORDER BY url")
def pending_order(t: Tables):
    return pending_table(t).orderBy("url").select(
        "url", F.col("first_seen").cast("string").alias("first_seen"), "attempts")


@query("cache_presence", """
SELECT a.url, p.url IS NOT NULL AS already_cached FROM {ads} a LEFT JOIN {ad_pages} p ON p.url = a.url""")
def cache_presence(t: Tables):
    return keyed.cache_presence(t.ads, t.ad_pages).select("url", "already_cached")


@query("known_url_set", "SELECT DISTINCT trim(url) AS url FROM {tracker} WHERE trim(url) <> ''")
def known_url_set(t: Tables):
    return keyed.known_url_set(t.tracker)


@query("union_sources", """
SELECT url, part, o1 FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY part, """ + ORDER_BY + """) AS k FROM (
 SELECT *, 0 AS part FROM {ads_raw} WHERE o1 % 2 = 1 UNION ALL SELECT *, 1 AS part FROM {ads_raw})) WHERE k = 1""")
def union_sources(t: Tables):
    raw = t.ads_raw
    parts = [raw.where("o1 % 2 = 1").withColumn("part", F.lit(0)), raw.withColumn("part", F.lit(1))]
    return keyed.union_sources(parts, order()).select("url", "part", "o1")


@query("fill_blanks", """
WITH d AS (SELECT url, CAST(2 + ok % 2 AS INT) AS bathrooms, CASE WHEN ok % 3 = 0 THEN 'Furnished' END AS furnished,
 concat('Block ', o1 % 50, ', London SW', 1 + o2 % 12) AS postcode FROM {ads} WHERE ok % 2 = 0)
SELECT a.url, CASE WHEN coalesce(a.bathrooms, 0) = 0 AND d.bathrooms IS NOT NULL THEN d.bathrooms ELSE a.bathrooms END AS bathrooms,
 CASE WHEN coalesce(a.furnished, '') = '' AND d.furnished IS NOT NULL THEN d.furnished ELSE a.furnished END AS furnished,
 CASE WHEN d.postcode IS NOT NULL AND (coalesce(a.pc, '') = '' OR a.pc NOT LIKE '%SW%') THEN d.postcode ELSE a.pc END AS postcode
FROM (SELECT *, CASE WHEN ok % 4 = 0 THEN area END AS pc FROM {ads}) a LEFT JOIN d ON d.url = a.url""")
def fill_blanks(t: Tables):
    from adledger.functions.blanks import blank_number, blank_text
    details = t.ads.where("ok % 2 = 0").select(
        "url", (2 + F.col("ok") % 2).cast("int").alias("bathrooms"),
        F.expr("CASE WHEN ok % 3 = 0 THEN 'Furnished' END").alias("furnished"),
        F.expr("concat('Block ', o1 % 50, ', London SW', 1 + o2 % 12)").alias("postcode"))
    rows = t.ads.withColumn("postcode", F.expr("CASE WHEN ok % 4 = 0 THEN area END"))
    return keyed.fill_blanks(rows, details, {
        "bathrooms": blank_number(F.col("bathrooms")), "furnished": blank_text(F.col("furnished")),
        "postcode": blank_text(F.col("postcode"))}).select(
        "url", "bathrooms", "furnished", "postcode")


# --- the plan -------------------------------------------------------------------

PLAN = f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {ORDER_BY}) AS k FROM {{batch}}) WHERE k = 1),
{q.ranked('b', CRIT)},
plan AS (SELECT r.*, {q.rule_code(CRIT, True)} AS reason, p.url IS NOT NULL AS already_cached,
  CASE WHEN t.url IS NOT NULL THEN 'duplicate' WHEN ({q.rule_code(CRIT)}) IS NOT NULL THEN 'rejected'
   WHEN p.url IS NOT NULL THEN 'cached' ELSE 'fetch' END AS disposition
 FROM ranked r LEFT JOIN (SELECT url FROM {{tracker}}) t ON t.url = r.url LEFT JOIN (SELECT url FROM {{ad_pages}}) p ON p.url = r.url)
"""


def plan(t: Tables):
    return daily.plan_queue(t.batch, t.tracker, t.ad_pages, CRIT, order())


@query("write_queue", PLAN + "SELECT url, disposition, t0 AS tier, reason FROM plan")
def write_queue(t: Tables):
    from adledger.session import work_dir
    from adledger.sources import tables
    path = work_dir(t.spark, "queue")
    tables.write_queue(plan(t).select("url", "disposition", "tier", "reason"), path)
    return t.spark.read.parquet(path)


@query("queue_order", PLAN + """SELECT url, already_cached, t0 AS tier FROM plan WHERE disposition IN ('cached', 'fetch')
ORDER BY already_cached, t0, url""")
def queue_order(t: Tables):
    queued = plan(t).where("disposition IN ('cached', 'fetch')")
    return queued.orderBy(*daily.queue_order(F.col("url"))).select(
        "url", "already_cached", "tier")


@query("head_samples", PLAN + "SELECT url, title, reason FROM plan WHERE disposition = 'rejected' ORDER BY url LIMIT 8")
def head_samples(t: Tables):
    return plan(t).where("disposition = 'rejected'").orderBy("url").limit(8).select(
        "url", "title", "reason")


@query("more_rejected", PLAN + """SELECT count(*) FILTER (disposition = 'rejected') AS rejected,
 greatest(count(*) FILTER (disposition = 'rejected') - 8, 0) AS more, count(*) FILTER (disposition = 'duplicate') AS duplicates FROM plan""")
def more_rejected(t: Tables):
    rejected = F.count_if(F.col("disposition") == "rejected")
    return plan(t).agg(rejected.alias("rejected"), F.greatest(rejected - 8, F.lit(0)).alias("more"),
                       F.count_if(F.col("disposition") == "duplicate").alias("duplicates"))


# --- predicates on records --------------------------------------------------------

@query("live_rows", f"SELECT url, status FROM {{tracker}} WHERE {q.LIVE}")
def live_rows(t: Tables):
    return t.tracker.where(rules.is_live(F.col("status"))).select("url", "status")


@query("in_unit_hit", f"SELECT url, {q.HIT} AS in_unit FROM {{tracker}}")
def in_unit_hit(t: Tables):
    return t.tracker.select("url", rules.in_unit(
        F.col("aircon"), F.col("aircon_scope")).alias("in_unit"))


LABEL = (f"CASE WHEN aircon IN ('yes', 'likely') AND NOT {q.HIT} THEN concat(aircon, '-', coalesce(nullif(aircon_scope, ''), 'unclear')) "
         "ELSE coalesce(nullif(aircon, ''), '(blank)') END")


@query("verdict_label", f"SELECT url, {LABEL} AS label FROM {{tracker}}")
def verdict_label(t: Tables):
    return t.tracker.select("url", rules.verdict_label(
        F.col("aircon"), F.col("aircon_scope")).alias("label"))


@query("uninformative", """
SELECT url, coalesce(furnished IN ('', 'Unknown', 'unchecked') OR trim(furnished) = '', true) AS furnished,
 coalesce(aircon IN ('', 'Unknown', 'unchecked') OR trim(aircon) = '', true) AS aircon FROM {tracker}""")
def uninformative_(t: Tables):
    return t.tracker.select("url", *[uninformative(F.col(c)).alias(c)
                                     for c in ("furnished", "aircon")])


OVERDUE = "coalesce(date_diff('day', found_on, DATE '1998-06-05') >= 7, false)"
HELD = f"(reported_on IS NULL AND {q.LIVE} AND aircon_checked IS NULL AND NOT {OVERDUE})"


@query("overdue", f"SELECT url, {OVERDUE} AS overdue FROM {{tracker}}")
def overdue(t: Tables):
    return t.tracker.select("url", rules.overdue(F.col("found_on"), F.lit("1998-06-05").cast(
        "date")).alias("overdue"))


@query("held_rows", f"SELECT url, CAST(found_on AS VARCHAR) AS found_on FROM {{tracker}} WHERE {HELD}")
def held_rows(t: Tables):
    return t.tracker.where(rules.held(F.lit("1998-06-05").cast("date"))).select(
        "url", F.col("found_on").cast("string").alias("found_on"))


@query("note_edit", """
WITH n AS (SELECT url, CAST(found_on AS VARCHAR) AS f, list_filter(string_split(coalesce(notes, ''), '; '),
  lambda x: x <> '' AND NOT (coalesce(size_sqft, 0) <> 0 AND contains(x, 'size not stated'))) AS l FROM {tracker})
SELECT url, array_to_string(CASE WHEN list_contains(l, concat('rejected on detail: available ', f, ', after 1998-01-01')) THEN l
 ELSE list_append(l, concat('rejected on detail: available ', f, ', after 1998-01-01')) END, '; ') AS notes FROM n""")
def note_edit(t: Tables):
    from adledger.functions.blanks import blank_number
    note = F.concat(F.lit("rejected on detail: available "), F.col("found_on").cast("string"),
                    F.lit(", after 1998-01-01"))
    return t.tracker.select("url", rules.note_edit(
        F.col("notes"), "size not stated", ~blank_number(F.col("size_sqft")), note).alias("notes"))


@query("why_ruled_out", """
SELECT url, coalesce(nullif(trim(regexp_extract(notes, 'rejected on detail:([^;]*)', 1)), ''), lower(status)) AS why
FROM {tracker} WHERE NOT (""" + q.LIVE + ")")
def why_ruled_out(t: Tables):
    return t.tracker.where(~rules.is_live(F.col("status"))).select(
        "url", rules.why_ruled_out(F.col("notes"), F.lower("status")).alias("why"))


@query("ruled_out_order", """
SELECT url, notes FROM {tracker} WHERE NOT (""" + q.LIVE + """) ORDER BY coalesce(notes, ''), url""")
def ruled_out_order(t: Tables):
    dead = t.tracker.where(~rules.is_live(F.col("status")))
    return dead.orderBy(F.coalesce("notes", F.lit("")), "url").select("url", "notes")
