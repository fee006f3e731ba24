"""The tracker: upsert, verdicts, clusters, buildings, counts and the daily delta."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from adledger.catalog import sqlparts as q
from adledger.catalog.ads_queries import HELD, LABEL, ORDER_BY, order, pending_table
from adledger.catalog.registry import query
from adledger.catalog.views import CRIT, REGISTRY, RUN_DATE, Tables
from adledger.functions import extract
from adledger.operators import cluster, quality, report, rules, search, upsert, verdicts
from adledger.plans import daily
from adledger.schemas import AD, RECORD
from adledger.session import work_dir
from adledger.sources import tables
from adledger.sources.state import Baselines, State
from adledger.sources.tables import as_ads

DAY = "DATE '1998-06-05'"


def day():
    return F.lit(RUN_DATE)


# --- upsert -----------------------------------------------------------------------

def run_upsert(t: Tables, refresh: bool = False) -> upsert.Upsert:
    t.stage("ads")
    batch = daily.with_retries(t.batch, pending_table(t), t.tracker)
    checked = verdicts.validate_verdicts(t.ad_verdicts, t.ad_pages)
    return upsert.upsert(batch, t.tracker.select(*RECORD.names), pending_table(t), checked,
                         t.ad_pages, CRIT, RUN_DATE, order(), refresh)


def upsert_sql(refresh: bool) -> str:
    """CTEs ending in ``wide`` (one row per URL of batch or tracker, with its outcome)."""
    carry = "false" if refresh else "w.v = 'unchecked' AND t.aircon IN ('yes', 'likely', 'no', 'unstated')"
    cols = ", ".join(c for c in ("url title platform area postcode price_pcm bills_included available_from furnished "
                                 "bed_count bathrooms size_sqft floor_level floor_number lift concierge condition contact "
                                 "notes bathrooms_verified_by_search area_trusted region_district region_name retry "
                                 "size_sqft_plan size_plan_confident").split())
    return f"""WITH
retries AS (SELECT * FROM {{pending_flat}} p WHERE NOT EXISTS (SELECT 1 FROM {{batch}} b WHERE b.url = p.url)),
b0 AS (SELECT {cols.replace('retry', 'false AS retry')}, {ORDER_BY} FROM {{batch}}
  UNION ALL SELECT {cols.replace('retry', 'true AS retry')}, {ORDER_BY} FROM retries),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {ORDER_BY}) AS k FROM b0) WHERE k = 1),
v1 AS (SELECT v.url, p.url AS pu, CAST(p.fetched_at AS DATE) AS pd, lower(trim(v.verdict)) AS word, lower(trim(v.scope)) AS sc, trim(v.evidence) AS ev,
  contains(lower(trim(regexp_replace(p.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(v.evidence, '\\s+', ' ', 'g')))) AS quoted
  FROM {{ad_verdicts}} v LEFT JOIN {{ad_pages}} p ON p.url = v.url),
v2 AS (SELECT url, CASE WHEN pu IS NULL THEN 'unchecked' WHEN quoted THEN word ELSE 'unstated' END AS v,
  CASE WHEN pu IS NOT NULL AND quoted AND word IN ('yes', 'likely') THEN CASE WHEN sc IN ('in_unit', 'communal_only', 'unclear') THEN sc ELSE 'unclear' END ELSE '' END AS s,
  CASE WHEN pu IS NOT NULL AND quoted THEN ev ELSE '' END AS e, CASE WHEN pu IS NOT NULL THEN pd END AS c FROM v1),
w0 AS (SELECT b.*, coalesce(v2.v, 'unchecked') AS v, coalesce(v2.s, '') AS s, coalesce(v2.e, '') AS e, v2.c AS c,
  p.url IS NOT NULL AS page_read, w.first_seen, w.attempts AS tries, w.last_tried, w.last_sighted,
  {q.rule_code(CRIT)} AS rule_code, {q.rule_code(CRIT, True)} AS reason
  FROM b1 b LEFT JOIN v2 ON v2.url = b.url LEFT JOIN {{ad_pages}} p ON p.url = b.url LEFT JOIN (SELECT url, first_seen, attempts, last_tried, last_sighted FROM {{pending_flat}}) w ON w.url = b.url),
w1 AS (SELECT w.* EXCLUDE (v, s, e, c), t.url IS NOT NULL AS tracked,
  CASE WHEN {carry} THEN t.aircon ELSE w.v END AS aircon,
  CASE WHEN {carry} THEN coalesce(t.aircon_scope, '') ELSE w.s END AS aircon_scope,
  CASE WHEN {carry} THEN coalesce(t.aircon_evidence, '') ELSE w.e END AS aircon_evidence,
  CASE WHEN {carry} THEN t.aircon_checked ELSE w.c END AS aircon_checked,
  coalesce(w.tries, 0) + CASE WHEN w.last_tried = {DAY} THEN 0 ELSE 1 END AS attempts
  FROM w0 w LEFT JOIN {{tracker}} t ON t.url = w.url),
w2 AS (SELECT *, CASE WHEN reason IS NOT NULL AND tracked THEN 'rejected' WHEN reason IS NOT NULL THEN 'dropped'
  WHEN NOT tracked AND NOT page_read AND coalesce(date_diff('day', first_seen, {DAY}), 0) < 7 THEN 'parked'
  WHEN NOT tracked AND NOT page_read THEN 'released' WHEN tracked THEN 'updated' ELSE 'added' END AS outcome FROM w1),
{q.ranked('w2', CRIT)},
wide AS (SELECT *, concat_ws('; ', nullif(notes, ''), nullif(rank_notes, ''),
  CASE WHEN outcome = 'released' THEN concat('detail page never loaded (', attempts, ' attempts) - unread') END,
  CASE WHEN coalesce(size_sqft_plan, 0) <> 0 AND coalesce(size_sqft, 0) = 0 THEN concat('size ', size_sqft_plan, ' sq ft read off the floorplan',
   CASE WHEN size_plan_confident THEN '' ELSE ' (AMBIGUOUS)' END, ' - verify') END) AS all_notes FROM ranked)
"""


def _merged(name: str, refresh: bool, new: str | None = None) -> str:
    new = new or f"w.{name}"
    if refresh:
        return new
    kind = {f.name: f.dataType.simpleString() for f in RECORD.fields}[name]
    if name in ("floor_level", "floor_number"):
        return f"CASE WHEN coalesce(trim(w.floor_level), '') = '' AND w.floor_number IS NULL THEN t.{name} ELSE {new} END"
    if name.startswith("aircon"):
        return new
    if kind == "string":
        blank = "coalesce({0} IN ('', 'Unknown', 'unchecked') OR trim({0}) = '', true)"
        return (f"CASE WHEN {blank.format(new)} AND NOT {blank.format('t.' + name)} THEN t.{name} ELSE {new} END")
    return f"coalesce({new}, t.{name})"


def tracker_sql(refresh: bool) -> str:
    def pick(name: str, rejected: str | None = None, new: str | None = None) -> str:
        value = new or f"w.{name}"
        return (f"CASE WHEN w.url IS NULL THEN t.{name} WHEN w.outcome = 'rejected' THEN {rejected or 't.' + name} "
                f"WHEN w.outcome = 'updated' THEN {_merged(name, refresh, new)} ELSE {value} END AS {name}")

    base = ("list_filter(string_split(coalesce(t.notes, ''), '; '), "
            "lambda x: x <> '' AND NOT (coalesce(w.size_sqft, 0) <> 0 AND contains(x, 'size not stated')))")
    edited = (f"array_to_string(CASE WHEN list_contains({base}, concat('rejected on detail: ', w.reason)) THEN {base} "
              f"ELSE list_append({base}, concat('rejected on detail: ', w.reason)) END, '; ')")
    return upsert_sql(refresh) + f"""
SELECT coalesce(w.url, t.url) AS url, {pick('title')}, {pick('price_pcm')}, {pick('furnished')}, {pick('bathrooms')},
 {pick('bedrooms', None, 'w.bed_count')}, {pick('size_sqft', 'coalesce(nullif(w.size_sqft, 0), t.size_sqft)')},
 {pick('size_sqft_plan', 'coalesce(nullif(w.size_sqft_plan, 0), t.size_sqft_plan)')}, {pick('floor_level')}, {pick('floor_number')},
 {pick('lift', "coalesce(nullif(w.lift, ''), t.lift)")}, {pick('concierge', "coalesce(nullif(w.concierge, ''), t.concierge)")},
 {pick('condition')}, {pick('aircon')}, {pick('aircon_scope')}, {pick('aircon_evidence')}, {pick('priority')},
 {pick('notes', edited, 'w.all_notes')},
 CASE WHEN w.outcome IN ('added', 'released') THEN 'NEW' WHEN w.outcome = 'rejected' AND upper(coalesce(t.status, '')) IN ('', 'NEW') THEN 'REJECTED' ELSE t.status END AS status,
 CAST(CASE WHEN w.outcome IN ('added', 'released') THEN coalesce(w.first_seen, {DAY}) ELSE t.found_on END AS VARCHAR) AS found_on,
 CAST(CASE WHEN w.outcome IN ('added', 'released') THEN coalesce(CASE WHEN w.retry THEN w.last_sighted END, {DAY})
   WHEN w.outcome = 'updated' THEN {DAY} ELSE t.last_seen END AS VARCHAR) AS last_seen
FROM (SELECT * FROM wide WHERE outcome NOT IN ('dropped', 'parked')) w FULL OUTER JOIN {{tracker}} t ON t.url = w.url"""


TRACKER_OUT = ("url title price_pcm furnished bathrooms bedrooms size_sqft size_sqft_plan floor_level floor_number "
               "lift concierge condition aircon aircon_scope aircon_evidence priority notes status found_on last_seen").split()


def tracker_out(df):
    return df.withColumns({c: F.col(c).cast("string") for c in ("found_on", "last_seen")}
                          ).select(*TRACKER_OUT)


@query("upsert", tracker_sql(False))
def upsert_merge(t: Tables):
    return tracker_out(run_upsert(t).tracker)


@query("upsert_refresh", tracker_sql(True))
def upsert_refresh(t: Tables):
    return tracker_out(run_upsert(t, refresh=True).tracker)


@query("upsert_outcome", upsert_sql(False) + "SELECT url, outcome, rule_code FROM wide")
def upsert_outcome(t: Tables):
    return run_upsert(t).outcome.select("url", "outcome", "rule_code")


@query("park", upsert_sql(False) + f"""
SELECT url, CAST(coalesce(first_seen, {DAY}) AS VARCHAR) AS first_seen, CAST(attempts AS INT) AS attempts, CAST({DAY} AS VARCHAR) AS last_tried,
 CAST(CASE WHEN retry THEN last_sighted ELSE {DAY} END AS VARCHAR) AS last_seen, title FROM wide WHERE outcome = 'parked'
UNION ALL
SELECT p.url, CAST(p.first_seen AS VARCHAR), p.attempts, CAST(p.last_tried AS VARCHAR), CAST(p.last_sighted AS VARCHAR), p.title
FROM {{pending_flat}} p WHERE NOT EXISTS (SELECT 1 FROM b1 WHERE b1.url = p.url)""")
def park(t: Tables):
    p = run_upsert(t).pending
    return p.select("url", *[F.col(c).cast("string").alias(c) for c in ("first_seen", "last_tried", "last_seen")],
                    "attempts", F.col("row.title").alias("title"))


@query("carry_stored", upsert_sql(False) + """
SELECT url, aircon, aircon_scope, aircon_evidence FROM wide WHERE tracked""")
def carry_stored(t: Tables):
    wide = run_upsert(t).wide
    return wide.where("in_batch AND old IS NOT NULL").select(
        "url", "aircon", "aircon_scope", "aircon_evidence")


@query("write_state", tracker_sql(False))
def write_state(t: Tables):
    """Two runs: the tracker as it stands, then this run's merge; reads the newest."""
    t.stage("ads")
    state = State(t.spark, work_dir(t.spark, "state"))
    state.write(t.tracker.select(*RECORD.names), pending_table(t), "before", dt.datetime(1998, 6, 4))
    batch = daily.with_retries(t.batch, state.pending(), state.tracker())
    daily.commit(state, batch, t.ad_verdicts, t.ad_pages, CRIT, RUN_DATE, order(), "run-1")
    return tracker_out(state.tracker())


def _corrected(name: str, value: str) -> str:
    return f"CASE WHEN url LIKE '%-1' THEN '{value}' ELSE {name} END AS {name}"


@query("fold_verdicts", f"""SELECT url, {_corrected('verdict', 'unstated')}, {_corrected('scope', '')}, {_corrected('evidence', '')} FROM {{ad_verdicts}}""")
def fold_verdicts(t: Tables):
    """Two runs, the second with corrections of some verdicts; the store as it is then."""
    t.stage("ads")
    state = State(t.spark, work_dir(t.spark, "verdicts"))
    corrections = t.ad_verdicts.where("url LIKE '%-1'").select(
        "url", F.lit("unstated").alias("verdict"), F.lit("").alias("scope"), F.lit("").alias("evidence"))
    for run_id, said in (("first", t.ad_verdicts), ("second", corrections)):
        daily.commit(state, t.batch, said, t.ad_pages, CRIT, RUN_DATE, order(), run_id)
    return state.verdicts().select("url", "verdict", "scope", "evidence")


@query("scan_state", "SELECT url, status, CAST(found_on AS VARCHAR) AS found_on FROM {tracker}")
def scan_state(t: Tables):
    state = State(t.spark, work_dir(t.spark, "state"))
    state.write(t.tracker.select(*RECORD.names), pending_table(t), "only", dt.datetime(1998, 6, 4))
    return state.tracker().select("url", "status", F.col("found_on").cast("string").alias("found_on"))


# --- decisions ---------------------------------------------------------------------

DECISIONS = ("concat('- [', CASE ok % 4 WHEN 0 THEN 'viewed' WHEN 1 THEN '' ELSE 'Dismissed' END, '] ', url, ' — note ', ln)")


@query("scan_decisions", """
SELECT url, CASE ok % 4 WHEN 0 THEN 'VIEWED' WHEN 1 THEN 'SEEN' ELSE 'DISMISSED' END AS status, concat('note ', ln) AS note
FROM {ads} WHERE ok % 6 <> 5 UNION ALL SELECT url, 'OLD' AS status, 'earlier' AS note FROM {ads} WHERE ok % 6 = 5 AND ok % 2 = 1""")
def scan_decisions(t: Tables):
    """Two folders of files, the second one later: what it says again overrides the first."""
    path = work_dir(t.spark, "decisions")
    t.stage("ads")
    t.ads.where("ok % 2 = 1").select(F.expr("concat('- [old] ', url, ' — earlier')")).write.text(path + "/1", compression="gzip")
    t.ads.select(F.expr(f"CASE WHEN ok % 6 = 5 THEN concat('prose about ', url) ELSE {DECISIONS} END")).write.text(path + "/2", compression="gzip")
    return tables.scan_decisions(t.spark, path + "/*")


@query("apply_decisions", """
SELECT t.url, CASE WHEN t.price_pcm % 50 = 0 THEN 'VIEWED' ELSE t.status END AS status,
 CASE WHEN t.price_pcm % 50 = 0 THEN 'mine' ELSE t.decision_note END AS decision_note FROM {tracker} t""")
def apply_decisions(t: Tables):
    own = t.tracker.where("price_pcm % 50 = 0").select(
        "url", F.lit("VIEWED").alias("status"), F.lit("mine").alias("note"))
    return tables.apply_decisions(t.tracker, own).select("url", "status", "decision_note")


# --- clusters and buildings -----------------------------------------------------------

LIVE_RECORDS = f"SELECT * FROM {{records}} WHERE {q.LIVE}"
ADDR = ("left(array_to_string(list_filter(string_split(regexp_replace(lower(coalesce(nullif(postcode, ''), area, '')), '[^a-z0-9 ]', ' ', 'g'), ' '), "
        r"lambda x: x <> '' AND NOT regexp_full_match(x, '[a-z]{1,2}\d{1,2}[a-z]?') AND NOT regexp_full_match(x, '\d[a-z]{2}') "
        "AND x NOT IN ('london', 'the', 'uk', 'greater')), ' '), 40)")
PC = r"nullif(regexp_extract(upper(coalesce(nullif(postcode, ''), area, '')), '\b([A-Z]{1,2}\d{1,2}[A-Z]?)(?:\s+(\d[A-Z]{2}))?\b', %d), '')"

CLUSTERS = f"""WITH RECURSIVE
live AS ({LIVE_RECORDS}),
k AS (SELECT *, {ADDR} AS akey, {PC % 1} AS oc, {PC % 2} AS ic,
  coalesce(nullif(floor_level, ''), CAST(nullif(floor_number, 0) AS VARCHAR)) AS fl, nullif(size_sqft, 0) AS sz, nullif(size_sqft_plan, 0) AS pl FROM live),
k2 AS (SELECT *, row_number() OVER (PARTITION BY price_pcm, bedrooms, bathrooms, akey ORDER BY {q.RANK_ORDER}) AS pos,
  row_number() OVER (ORDER BY {q.RANK_ORDER}) AS rnk,
  hash(price_pcm, bedrooms, bathrooms, akey) AS h FROM k WHERE coalesce(price_pcm, 0) <> 0 AND akey <> ''),
blk AS (SELECT *, concat_ws('|', price_pcm, coalesce(CAST(bedrooms AS VARCHAR), '?'), coalesce(CAST(bathrooms AS VARCHAR), '?'), akey) AS b,
  struct_pack(u := url, oc := oc, ic := ic, fl := fl, sz := sz, pl := pl) AS me FROM k2),
fold AS (
 SELECT b, pos, url, [me] AS reps, url AS cluster_id FROM blk WHERE pos = 1
 UNION ALL
 SELECT n.b, n.pos, n.url,
  CASE WHEN len(list_filter(f.reps, lambda r: {{ok}})) > 0 THEN f.reps ELSE list_append(f.reps, n.me) END,
  coalesce(list_filter(f.reps, lambda r: {{ok}})[1].u, n.url)
 FROM fold f JOIN blk n ON n.b = f.b AND n.pos = f.pos + 1),
clusters AS (SELECT url, cluster_id FROM fold
 UNION ALL SELECT url, url FROM k WHERE coalesce(price_pcm, 0) = 0 OR akey = ''),
members AS (SELECT r.*, c.cluster_id, {q.HIT} AS hit FROM k r JOIN clusters c ON c.url = r.url),
best AS (SELECT * FROM members WHERE url = cluster_id),
summary AS (SELECT m.cluster_id, b.priority, b.price_pcm, count(*) AS n_ads, count(*) FILTER (m.hit) AS n_hits, bool_or(m.hit) AS in_unit,
  b.aircon, b.aircon_scope, b.url
  FROM members m JOIN best b ON b.cluster_id = m.cluster_id GROUP BY ALL)
""".replace("{ok}", "coalesce(r.oc = n.me.oc, true) AND coalesce(r.ic = n.me.ic, true) AND coalesce(r.fl = n.me.fl, true) "
            "AND coalesce(r.sz = n.me.sz, true) AND coalesce(r.pl = n.me.pl, true)")


MERGED = f"""SELECT url, title, platform, concat('Block ', price_pcm % 3000) AS area,
 CASE WHEN price_pcm % 7 < 4 THEN concat('SW', 1 + price_pcm % 7) END AS postcode, CAST(CASE WHEN price_pcm > 0 THEN 1000 END AS INT) AS price_pcm,
 2 AS bedrooms, 2 AS bathrooms, size_sqft, size_sqft_plan, floor_level, floor_number, lift, concierge, condition, furnished, aircon,
 aircon_scope, priority, status FROM {{records}} WHERE {q.LIVE}"""


def clustered(t: Tables, *columns: str):
    """The clusters of the live records with some of their columns, all if none is named."""
    t.stage("ads")
    return cluster.cluster_ads(t.records.where(rules.is_live(F.col("status"))), columns=columns or None)


def summary_of(t: Tables):
    return cluster.summarise(clustered(t, *cluster.SUMMED))


@query("cluster_ads", CLUSTERS + "SELECT url, cluster_id FROM members")
def cluster_ads(t: Tables):
    return clustered(t, "url").select("url", "cluster_id")


@query("cluster_ads_in_rounds", CLUSTERS.replace(LIVE_RECORDS, MERGED) + "SELECT url, cluster_id FROM members")
def cluster_ads_in_rounds(t: Tables):
    """Addresses and prices run together, so that blocks hold hundreds of signatures and take many rounds."""
    t.stage("ads")
    return cluster.cluster_ads(t.sql(MERGED), columns=["url"], fold=1).select("url", "cluster_id")


@query("cluster_summary", CLUSTERS + "SELECT cluster_id, priority, price_pcm, n_ads, n_hits, in_unit FROM summary")
def cluster_summary(t: Tables):
    return summary_of(t).drop("ad_rank")


@query("flats_and_ads", CLUSTERS + "SELECT count(*) FILTER (in_unit) AS flats, CAST(sum(n_hits) AS BIGINT) AS ads FROM summary")
def flats_and_ads(t: Tables):
    return cluster.flats_and_ads(summary_of(t))


@query("tier_sections", CLUSTERS + "SELECT priority, count(*) AS clusters, CAST(sum(n_ads) AS BIGINT) AS ads FROM summary GROUP BY 1")
def tier_sections(t: Tables):
    return cluster.tier_sections(summary_of(t))


@query("cluster_facts", CLUSTERS + f""",
l AS (SELECT cluster_id, url, {q.furnishing('part', 'either')} AS label, row_number() OVER (ORDER BY {q.RANK_ORDER}) AS seen FROM members),
f AS (SELECT cluster_id, label, min(seen) AS seen FROM l WHERE label IS NOT NULL GROUP BY ALL)
SELECT c.cluster_id, c.n_ads, c.links, coalesce(g.furnishing, '?') AS furnishing FROM (SELECT cluster_id, count(*) AS n_ads,
 string_agg(concat('[', CASE WHEN trim(platform) <> '' THEN platform ELSE 'link' END, '](', url, ')'), ', ' ORDER BY {q.RANK_ORDER}) AS links FROM members GROUP BY 1) c
LEFT JOIN (SELECT cluster_id, string_agg(label, ' / ' ORDER BY seen) AS furnishing FROM f GROUP BY 1) g ON g.cluster_id = c.cluster_id""")
def cluster_facts(t: Tables):
    return cluster.cluster_facts(clustered(t, "furnished", "platform"))


@query("cluster_links", CLUSTERS + "SELECT cluster_id, concat('[', platform, '](', url, ')') AS link FROM members")
def cluster_links(t: Tables):
    return cluster.cluster_links(clustered(t, "platform")).select("cluster_id", "link")


@query("shortlist", CLUSTERS + f"""
SELECT cluster_id, priority, n_ads FROM summary WHERE priority <> 'Low'
UNION ALL (SELECT cluster_id, priority, n_ads FROM summary WHERE priority = 'Low' ORDER BY {q.RANK_ORDER} LIMIT 60)""")
def shortlist(t: Tables):
    return cluster.shortlist(summary_of(t), 60).select(
        "cluster_id", "priority", "n_ads")


@query("more_than_shown", CLUSTERS + """
SELECT priority, count(*) AS total, CASE WHEN priority = 'Low' THEN least(count(*), 60) ELSE count(*) END AS shown,
 count(*) - CASE WHEN priority = 'Low' THEN least(count(*), 60) ELSE count(*) END AS more FROM summary GROUP BY 1""")
def more_than_shown(t: Tables):
    return cluster.more_than_shown(summary_of(t), 60)


BUILDINGS = f"""bc AS (SELECT {ADDR} AS addr_key, {PC % 1} AS outcode, count(*) AS n FROM {{tracker}}
 WHERE {q.LIVE} AND {ADDR} <> '' GROUP BY 1, 2),
ub AS (SELECT r.url, r.a AS addr_key, r.o AS outcode, coalesce((SELECT sum(n) FROM bc WHERE addr_key = r.a AND outcode IS NULL), 0)
  + CASE WHEN r.o IS NOT NULL THEN coalesce((SELECT sum(n) FROM bc WHERE addr_key = r.a AND outcode = r.o), 0)
    ELSE coalesce((SELECT max(n) FROM bc WHERE addr_key = r.a AND outcode IS NOT NULL), 0) END AS units
 FROM (SELECT url, {ADDR} AS a, {PC % 1} AS o FROM {{records}}) r)"""


@query("building_counts", f"WITH {BUILDINGS} SELECT addr_key, outcode, n FROM bc")
def building_counts(t: Tables):
    return cluster.building_counts(t.tracker)


@query("units_in_building", f"WITH {BUILDINGS} SELECT url, CAST(units AS BIGINT) AS units FROM ub")
def units_in_building(t: Tables):
    return cluster.units_in_building(
        t.records.select("url", "postcode", "area"), cluster.building_counts(t.tracker)
    ).select("url", "units")


CELLS = f"""
CASE WHEN price_pcm IS NULL THEN '?' ELSE concat('£', format('{{:,}}', price_pcm)) END AS price,
CASE WHEN nm IS NOT NULL AND NOT list_bool_or(list_transform(string_split(nm, '/'), lambda p: contains(lower(adr), lower(trim(p)))))
  THEN concat(adr, ' · _', nm, '_') ELSE adr END AS area,
CASE WHEN coalesce(size_sqft, 0) <> 0 THEN CAST(size_sqft AS VARCHAR) WHEN coalesce(size_sqft_plan, 0) <> 0 THEN concat('~', size_sqft_plan, '*') ELSE '–' END AS sqft,
coalesce(nullif(floor_level, ''), CAST(nullif(floor_number, 0) AS VARCHAR), '–') AS floor,
concat(coalesce(CAST(bedrooms AS VARCHAR), '?'), '/', coalesce(CAST(bathrooms AS VARCHAR), '?')) AS beds_bath,
coalesce(nullif(concat_ws(', ', CASE WHEN {q.HIT} THEN '**A/C**' WHEN aircon IN ('yes', 'likely') THEN
  CASE WHEN aircon_scope = 'communal_only' THEN 'A/C communal only' ELSE 'A/C, not clearly in the unit' END END,
  CASE WHEN concierge <> '' THEN 'concierge' END, CASE WHEN lower(lift) = 'yes' THEN 'lift' END,
  CASE WHEN condition LIKE '%refurb%' THEN condition WHEN condition = 'new_build' THEN 'new build' END), ''), '–') AS flags"""


def cells_sql(src: str) -> str:
    from adledger.catalog.ads_queries import AREA_ROWS
    return f"""names(district, name) AS (VALUES {AREA_ROWS}),
cell0 AS (SELECT s.*, coalesce(nullif(replace(coalesce(nullif(s.postcode, ''), s.area), '|', '/'), ''), '–') AS adr, n.name AS nm
  FROM {src} s LEFT JOIN names n ON n.district = {q.district('s.postcode', 's.area')}),
cells AS (SELECT url, {CELLS} FROM cell0)"""


@query("display_cells", "WITH " + cells_sql("{records}") + " SELECT * FROM cells")
def display_cells(t: Tables):
    return report.display_cells(t.records)


@query("listing_table", CLUSTERS + "," + BUILDINGS + "," + cells_sql("best") + f""",
l AS (SELECT cluster_id, {q.furnishing('part', 'either')} AS label, row_number() OVER (ORDER BY {q.RANK_ORDER}) AS seen FROM members),
f AS (SELECT cluster_id, label, min(seen) AS seen FROM l WHERE label IS NOT NULL GROUP BY ALL),
g AS (SELECT cluster_id, string_agg(label, ' / ' ORDER BY seen) AS furnishing FROM f GROUP BY 1),
x AS (SELECT s.cluster_id, s.priority, s.n_ads, c.*, coalesce(g.furnishing, '?') AS furnishing,
  concat_ws('; ', CASE WHEN s.n_ads > 1 THEN concat(s.n_ads, ' near-identical ads') END,
   CASE WHEN u.units > s.n_ads THEN concat(CAST(u.units AS BIGINT), ' units in this building') END) AS extra
  FROM summary s JOIN cells c ON c.url = s.cluster_id JOIN ub u ON u.url = s.cluster_id LEFT JOIN g ON g.cluster_id = s.cluster_id)
SELECT cluster_id, priority, price, area, sqft, floor, beds_bath, furnishing, n_ads,
 CASE WHEN extra = '' THEN flags WHEN flags = '–' THEN extra ELSE concat(flags, ' · ', extra) END AS notable FROM x""")
def listing_table(t: Tables):
    return report.listing_table(clustered(t, *report.SHOWN), cluster.building_counts(t.tracker)).drop("ad_rank")


# --- counts and reports ----------------------------------------------------------------

@query("tally", "SELECT coalesce(nullif(status, ''), '(blank)') AS key, count(*) AS n FROM {tracker} GROUP BY 1")
def tally(t: Tables):
    return report.field_tally(t.tracker, "status")


SNAP = f"""SELECT count(*) AS tracked, count(*) FILTER ({q.LIVE}) AS live, count(*) FILTER (NOT ({q.LIVE})) AS ruled_out,
 count(*) FILTER ({q.LIVE} AND {q.HIT}) AS aircon_in_unit, count(*) FILTER ({q.LIVE} AND reported_on IS NULL) AS unreported FROM """


@query("snapshot", SNAP + "{tracker}")
def snapshot(t: Tables):
    return report.snapshot(t.tracker).drop("aircon_live")


@query("snapshot_verdicts", f"SELECT coalesce(nullif(aircon, ''), '(blank)') AS verdict, count(*) AS n FROM {{tracker}} WHERE {q.LIVE} GROUP BY 1")
def snapshot_verdicts(t: Tables):
    return report.verdict_counts(report.snapshot(t.tracker))


@query("baseline_delta", f"""WITH a AS ({SNAP} {{tracker}}), b AS ({SNAP} (SELECT * FROM {{tracker}} WHERE found_on < DATE '1999-01-01')),
au AS (UNPIVOT a ON COLUMNS(*) INTO NAME measure VALUE after), bu AS (UNPIVOT b ON COLUMNS(*) INTO NAME measure VALUE before)
SELECT measure, before, after, after - before AS diff, true AS stale, 'earlier' AS basis FROM au JOIN bu USING (measure) WHERE after <> before""")
def baseline_delta(t: Tables):
    return _since_baseline(t, dt.date(1999, 1, 2), {dt.date(1999, 1, 1): "1999-01-01"})


def _since_baseline(t: Tables, today: dt.date, *taken: dict):
    """Today's counts beside the baselines kept, in order, of the tracker as it was before some days."""
    kept = Baselines(t.spark, work_dir(t.spark, "baselines"))
    now = report.snapshot(t.tracker).drop("aircon_live")
    for one in taken:
        for on, before in one.items():
            kept.keep(report.snapshot(t.tracker.where(f"found_on < DATE '{before}'")).drop("aircon_live"), on)
    return report.baseline_delta(now, kept.newest(today, now.schema), F.lit(today))


# a second snapshot of the day, taken after a repair, does not move where the day started
@query("baseline_kept", f"""WITH a AS ({SNAP} {{tracker}}), b AS ({SNAP} (SELECT * FROM {{tracker}} WHERE found_on < DATE '1998-01-01')),
au AS (UNPIVOT a ON COLUMNS(*) INTO NAME measure VALUE after), bu AS (UNPIVOT b ON COLUMNS(*) INTO NAME measure VALUE before)
SELECT measure, before, after, after - before AS diff, false AS stale, 'today' AS basis FROM au JOIN bu USING (measure) WHERE after <> before""")
def baseline_kept(t: Tables):
    day = dt.date(1999, 1, 2)
    return _since_baseline(t, day, {dt.date(1999, 1, 1): "1997-01-01"}, {day: "1998-01-01"}, {day: "1999-01-01"})


@query("baseline_missing", f"""WITH a AS ({SNAP} {{tracker}}), au AS (UNPIVOT a ON COLUMNS(*) INTO NAME measure VALUE after)
SELECT measure, CAST(NULL AS BIGINT) AS before, after, CAST(NULL AS BIGINT) AS diff, CAST(NULL AS BOOLEAN) AS stale, 'missing' AS basis FROM au""")
def baseline_missing(t: Tables):
    return _since_baseline(t, dt.date(1999, 1, 2))


@query("report_tallies", f"""
SELECT 'priority' AS field, {q.LIVE} AS is_live, coalesce(nullif(priority, ''), '(blank)') AS key, count(*) AS n FROM {{tracker}} GROUP BY ALL
UNION ALL SELECT 'verdict', {q.LIVE}, {LABEL}, count(*) FROM {{tracker}} GROUP BY ALL
UNION ALL SELECT 'status', NULL, coalesce(nullif(status, ''), '(blank)'), count(*) FROM {{tracker}} GROUP BY ALL""")
def report_tallies(t: Tables):
    return report.report_tallies(t.tracker)


@query("waiting_counts", f"""SELECT count(*) FILTER (aircon = 'unchecked' AND {q.LIVE}) AS unread_live,
 count(*) FILTER (aircon = 'unchecked' AND NOT ({q.LIVE})) AS unread_ruled_out, count(*) FILTER ({q.LIVE} AND reported_on IS NULL) AS unreported,
 (SELECT count(*) FROM {{pending_flat}}) AS waiting FROM {{tracker}}""")
def waiting_counts(t: Tables):
    return report.waiting_counts(t.tracker, t.pending_flat)


@query("daily_index", f"SELECT CAST(reported_on AS VARCHAR) AS reported_on, count(*) FILTER ({q.LIVE}) AS n_live FROM {{tracker}} WHERE reported_on IS NOT NULL GROUP BY 1")
def daily_index(t: Tables):
    return report.daily_index(t.tracker).select(
        F.col("reported_on").cast("string").alias("reported_on"), "n_live")


TODAYS = f"((reported_on IS NULL AND NOT {HELD}) OR coalesce(reported_on = {DAY}, false))"


@query("todays_rows", f"SELECT url, status FROM {{tracker}} WHERE {TODAYS}")
def todays_rows(t: Tables):
    return report.todays_rows(t.tracker, day()).select("url", "status")


DAILY_CLUSTERS = CLUSTERS.replace(LIVE_RECORDS, f"SELECT * FROM {{tracker}} WHERE {TODAYS} AND {q.LIVE}")


# a person's decisions count before the day is reported
DECIDED = "SELECT * REPLACE (CASE WHEN price_pcm % 50 = 0 THEN 'DISMISSED' WHEN price_pcm % 70 = 0 THEN 'VIEWED' ELSE status END AS status) FROM {tracker}"
DECIDED_CLUSTERS = CLUSTERS.replace(LIVE_RECORDS, f"SELECT * FROM decided WHERE {TODAYS} AND {q.LIVE}").replace(
    "WITH RECURSIVE\n", f"WITH RECURSIVE\ndecided AS ({DECIDED}),\n", 1)


def decisions_of(t: Tables):
    status = F.when(F.col("price_pcm") % 50 == 0, "DISMISSED").when(F.col("price_pcm") % 70 == 0, "VIEWED")
    return t.tracker.select("url", status.alias("status"), F.lit("mine").alias("note")).where("status IS NOT NULL")


@query("daily_delta_decided", DECIDED_CLUSTERS + f"""
SELECT (SELECT count(*) FROM decided WHERE {TODAYS} AND {q.LIVE}) AS n_new,
 (SELECT count(*) FROM decided WHERE {TODAYS} AND NOT ({q.LIVE})) AS n_ruled_out,
 (SELECT count(*) FROM summary) AS distinct_flats, (SELECT count(*) FROM summary WHERE in_unit) AS flats_in_unit,
 (SELECT CAST(sum(n_hits) AS BIGINT) FROM summary) AS ads_in_unit,
 (SELECT count(*) FROM decided WHERE {HELD}) + (SELECT count(*) FROM {{pending_flat}}) AS waiting""")
def daily_delta_decided(t: Tables):
    t.stage("ads")
    return daily.daily_report(t.tracker, t.pending_flat, decisions_of(t), RUN_DATE).counts


@query("daily_delta", DAILY_CLUSTERS + f"""
SELECT (SELECT count(*) FROM {{tracker}} WHERE {TODAYS} AND {q.LIVE}) AS n_new,
 (SELECT count(*) FROM {{tracker}} WHERE {TODAYS} AND NOT ({q.LIVE})) AS n_ruled_out,
 (SELECT count(*) FROM summary) AS distinct_flats, (SELECT count(*) FROM summary WHERE in_unit) AS flats_in_unit,
 (SELECT CAST(sum(n_hits) AS BIGINT) FROM summary) AS ads_in_unit,
 (SELECT count(*) FROM {{tracker}} WHERE {HELD}) + (SELECT count(*) FROM {{pending_flat}}) AS waiting""")
def daily_delta(t: Tables):
    t.stage("ads")
    none = t.tracker.where("false").select("url", "status", F.col("notes").alias("note"))
    return daily.daily_report(t.tracker, t.pending_flat, none, RUN_DATE).counts


@query("daily_tiers", DAILY_CLUSTERS + "SELECT cluster_id, priority, n_ads FROM summary")
def daily_tiers(t: Tables):
    t.stage("ads")
    none = t.tracker.where("false").select("url", "status", F.col("notes").alias("note"))
    return daily.daily_report(t.tracker, t.pending_flat, none, RUN_DATE).table.select(
        "cluster_id", "priority", "n_ads")


@query("stamp_reported", f"""SELECT url, CAST(CASE WHEN reported_on IS NULL AND NOT {HELD} THEN {DAY} ELSE reported_on END AS VARCHAR) AS reported_on FROM {{tracker}}""")
def stamp_reported(t: Tables):
    return report.stamp_reported(t.tracker, day()).select(
        "url", F.col("reported_on").cast("string").alias("reported_on"))


@query("write_daily", f"SELECT url, status, '1998-06-05' AS reported_on FROM {{tracker}} WHERE {TODAYS}")
def write_daily(t: Tables):
    """The day is written twice; the second write replaces the first."""
    path = work_dir(t.spark, "daily")
    rows = report.todays_rows(t.tracker, day()).select("url", "status").withColumn(
        "reported_on", day())
    for _ in range(2):
        tables.write_daily(rows, path)
    return t.spark.read.parquet(path).withColumn("reported_on", F.col("reported_on").cast("string"))


# --- quality -------------------------------------------------------------------------------

def _pct(cond: str, name: str) -> str:
    return f"CAST(floor(100 * count(*) FILTER ({cond}) / count(*)) AS INT) AS pct_{name}"


@query("field_coverage", f"""SELECT platform, count(*) AS n, {_pct('coalesce(price_pcm, 0) <> 0', 'price')}, {_pct('coalesce(bed_count, 0) <> 0', 'beds')},
 {_pct('coalesce(bathrooms, 0) <> 0 OR bathrooms_verified_by_search', 'baths')}, {_pct('coalesce(size_sqft, 0) <> 0', 'size')},
 {_pct(q.district() + ' IS NOT NULL', 'district')} FROM {{ads}} GROUP BY 1""")
def field_coverage(t: Tables):
    return quality.field_coverage(t.ads)


# amenities read in the pages of ads (see the view) per field
@query("run_counters", """WITH c AS (SELECT count(*) FILTER (o2 % 5 = 1) AS floor_level, count(*) FILTER (o2 % 5 = 0) AS floor_number,
 count(*) FILTER (o1 % 4 < 2) AS lift, count(*) FILTER (o2 % 3 = 0) AS concierge, count(*) FILTER (o1 % 6 < 2) AS condition, CAST(0 AS BIGINT) AS size_sqft
 FROM {ads} WHERE (ok + ln) % 4 <> 0) SELECT field AS key, hits AS n FROM (UNPIVOT c ON COLUMNS(*) INTO NAME field VALUE hits)""")
def run_counters(t: Tables):
    read = t.ad_pages.select(extract.amenities(F.col("text")).alias("amenities"))
    return quality.run_counters(read).select(F.col("field").alias("key"), F.col("hits").alias("n"))


@query("platform_tally", "SELECT platform AS key, count(*) AS n FROM {batch} GROUP BY 1")
def platform_tally(t: Tables):
    return quality.tally(t.batch, F.col("platform"))


@query("resolve_source", """
WITH p AS (SELECT url, 1 AS x FROM {ad_pages} UNION ALL SELECT concat('https://elsewhere.invalid/', doc_id), 1 FROM {documents}),
b AS (SELECT url, CASE WHEN ok % 5 = 0 THEN '?' ELSE platform END AS platform FROM {ads} WHERE ok % 2 = 0),
t AS (SELECT url, CASE WHEN price_pcm % 30 = 0 THEN '' ELSE concat(platform, '*') END AS platform FROM {tracker})
SELECT p.url, CASE WHEN coalesce(CASE WHEN b.url IS NOT NULL THEN b.platform ELSE t.platform END, '') NOT IN ('', '?')
  THEN CASE WHEN b.url IS NOT NULL THEN b.platform ELSE t.platform END
  ELSE CASE WHEN contains(p.url, 'alpha.example') THEN 'Alpha' WHEN contains(p.url, 'beta.example') THEN 'Beta'
   WHEN contains(p.url, 'gamma.example') THEN 'Gamma' WHEN contains(p.url, 'delta.example') THEN 'Delta' ELSE '?' END END AS source_name
FROM p LEFT JOIN b ON b.url = p.url LEFT JOIN t ON t.url = p.url""")
def resolve_source(t: Tables):
    pages = t.ad_pages.select("url").unionByName(t.documents.select(
        F.concat(F.lit("https://elsewhere.invalid/"), F.col("doc_id").cast("string")).alias("url")))
    batch = t.ads.where("ok % 2 = 0").select(
        "url", F.expr("CASE WHEN ok % 5 = 0 THEN '?' ELSE platform END").alias("platform"))
    known = t.tracker.select("url", F.expr(
        "CASE WHEN price_pcm % 30 = 0 THEN '' ELSE concat(platform, '*') END").alias("platform"))
    return search.resolve_source(pages, batch, known, REGISTRY)


def wrapped(rows, batch):
    """Ads as one row per batch; ``batch`` is an id that grows with the data, so a row stays bounded."""
    return rows.groupBy(batch.alias("batch")).agg(F.collect_list(F.struct(*AD.names)).alias("listings"))


@query("scan_batch", "SELECT url, title, price_pcm, CAST(available_from AS VARCHAR) AS available_from, '1998-06-05' AS run_date FROM {ads}")
def scan_batch(t: Tables):
    """All ads, half of them written as wrapped batches and half as bare ads, read back as one table."""
    path = work_dir(t.spark, "batch")
    t.stage("ads")
    rows = as_ads(t.ads).select(*AD.names, "ok")
    batches = wrapped(rows.where("ok % 4 < 2"), F.floor(F.col("ok") / 400)).select(
        F.lit("1998-06-05").alias("run_date"), "listings")
    batches.write.json(path + "/wrapped", compression="gzip")
    rows.where("ok % 4 >= 2").select(F.lit("1998-06-05").alias("run_date"), *AD.names
                                    ).write.json(path + "/bare", compression="gzip")
    return tables.scan_batch(t.spark, path + "/wrapped", path + "/bare").select(
        "url", "title", "price_pcm", F.col("available_from").cast("string").alias("available_from"),
        F.col("run_date").cast("string").alias("run_date"))


@query("write_stage", "SELECT url, price_pcm FROM {ads}")
def write_stage(t: Tables):
    return tables.write_stage(t.ads.select("url", "price_pcm"), work_dir(t.spark, "stage"))


# a run is stopped while a flagged row has no verdict, and publishes once all have one
@query("finish_gate", f"""SELECT step, CAST(CASE step WHEN 'stopped' THEN 0 ELSE 1 END AS BIGINT) AS runs,
 CASE step WHEN 'stopped' THEN 0 ELSE (SELECT count(*) FROM {{ads}} WHERE ln = 1 AND ({q.rule_code(CRIT)}) IS NULL AND (ok + ln) % 4 <> 0) END AS tracked
 FROM (VALUES ('stopped'), ('published')) AS s(step)""")
def finish_gate(t: Tables):
    t.stage("ads")
    state = State(t.spark, work_dir(t.spark, "gate"))
    batch = t.ads.where("ln = 1")
    review = t.ad_pages.where(F.contains("text", F.lit("Air conditioning")))
    quiet = review.select("url", F.lit("unstated").alias("verdict"), F.lit("").alias("scope"), F.lit("").alias("evidence"))
    said = []
    for step, judged in (("stopped", quiet.where("url NOT LIKE '%-1'")), ("published", quiet)):
        try:
            daily.commit(state, batch, judged, t.ad_pages, CRIT, RUN_DATE, order(), step, review=review)
        except verdicts.UnjudgedError:
            pass
        runs = state.runs().agg(F.count("*").alias("runs"))
        kept = state.tracker().agg(F.count("*").alias("tracked"))
        said.append(runs.select(F.lit(step).alias("step"), "runs", kept.scalar().alias("tracked")))
    return said[0].unionByName(said[1])


# the batch of one run is gated on every flagged row having a verdict
@query("unjudged_gate", "SELECT p.url FROM {ad_pages} p WHERE p.text LIKE '%Air conditioning%' AND NOT EXISTS (SELECT 1 FROM {ad_verdicts} v WHERE v.url = p.url AND v.scope <> 'somewhere')")
def unjudged_gate(t: Tables):
    review = t.ad_pages.where(F.contains("text", F.lit("Air conditioning")))
    judged = t.ad_verdicts.where("scope <> 'somewhere'")
    return verdicts.unjudged(review, judged).select("url")
