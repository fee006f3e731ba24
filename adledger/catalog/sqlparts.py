"""SQL pieces the checks share, written for DuckDB."""

from __future__ import annotations

from adledger.criteria import Criteria

DISTRICT_RE = r"\b([A-Z]{1,2}\d{1,2}[A-Z]?)\b"


def first_match(expr: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({expr}, '{pattern}', {group}), '')"


def district(postcode: str = "postcode", area: str = "area") -> str:
    return (f"coalesce({first_match(f'upper({postcode})', DISTRICT_RE)}, "
            f"{first_match(f'upper({area})', DISTRICT_RE)})")


def _in(expr: str, words) -> str:
    return f"{expr} IN ({', '.join(repr(w) for w in words)})" if words else "false"


def tier_of(d: str, c: Criteria) -> str:
    stem = f"lower(regexp_extract(upper({d}), '^([A-Z]{{1,2}}\\d{{1,2}})[A-Z]$', 1))"
    arms = " ".join(f"WHEN {_in(f'lower({d})', names)} OR {_in(stem, names)} THEN {i}"
                    for i, names in enumerate((c.prime, c.affluent, c.fringe)))
    return f"CASE {arms} END"


FLEXIBLE = "(lower(coalesce(furnished, '')) LIKE '%or unfurnished%' OR lower(coalesce(furnished, '')) LIKE '%unfurnished or%')"


def furnishing(part: str, flexible: str) -> str:
    return (f"CASE WHEN {FLEXIBLE} THEN '{flexible}' WHEN lower(trim(furnished)) LIKE 'part%' THEN '{part}' "
            "WHEN lower(trim(furnished)) IN ('no', 'unfurnished') THEN 'unfurnished' "
            "WHEN lower(trim(furnished)) IN ('yes', 'furnished') THEN 'furnished' END")


def rule_code(c: Criteria, reason: bool = False) -> str:
    latest = (f"(DATE '{c.move_in}' + {c.move_in_slack_days})" if c.move_in
              else "CAST(NULL AS DATE)")
    d = district()
    rules = [
        ("budget", f"price_pcm > {c.budget_pcm}",
         f"concat('price ', price_pcm, ' above {c.budget_pcm}')"),
        ("beds_min", f"{c.min_bedrooms} > 0 AND bed_count < {c.min_bedrooms}",
         f"concat('beds ', bed_count, ' below {c.min_bedrooms}')"),
        ("beds_max", f"{c.max_bedrooms} > 0 AND bed_count > {c.max_bedrooms}",
         f"concat('beds ', bed_count, ' above {c.max_bedrooms}')"),
        ("baths", f"{c.min_bathrooms} > 0 AND bathrooms < {c.min_bathrooms}",
         f"concat('baths ', bathrooms, ' below {c.min_bathrooms}')"),
        ("size", f"{c.min_sqft} > 0 AND size_sqft < {c.min_sqft}",
         f"concat('square feet ', size_sqft, ' below {c.min_sqft}')"),
        ("date", f"available_from > {latest}",
         f"concat('free on ', CAST(available_from AS VARCHAR), ', needed by ', CAST({latest} AS VARCHAR))"),
        ("floor", "lower(trim(floor_level)) IN ('lower_ground', 'basement')",
         "'floor below street level'"),
        ("district", f"{str(c.districts_only).lower()} AND NOT coalesce(area_trusted, false) "
         f"AND {d} IS NOT NULL AND ({tier_of(d, c)}) IS NULL",
         f"concat('unwanted district ', {d})"),
    ]
    arms = " ".join(f"WHEN {cond} THEN {text if reason else repr(code)}" for code, cond, text in rules)
    return f"CASE {arms} END"


def ranked(src: str, c: Criteria) -> str:
    """CTEs ending in ``ranked``: the source with tier, priority, rank_notes."""
    pref = c.furnishing
    picky = str(pref in ("unfurnished", "furnished")).lower()
    porter = "(lower(coalesce(concierge, '')) = 'yes')"
    lvl = "lower(trim(coalesce(floor_level, '')))"
    lft = "lower(trim(coalesce(lift, '')))"
    hit = "(coalesce(aircon IN ('yes', 'likely') AND aircon_scope = 'in_unit', false))"
    strict = str(c.furnishing_strict).lower()
    yes = "true" if c.move_in else "false"
    return f"""
r0 AS (SELECT *, {district()} AS d FROM {src}),
r1 AS (SELECT *, {tier_of('d', c)} AS own,
  CASE WHEN d IS NULL AND trim(region_district) <> '' THEN {tier_of('region_district', c)} END AS reg,
  {furnishing('part furnished', pref)} AS got FROM r0),
r2 AS (SELECT *, coalesce(own, reg) IS NULL AND d IS NULL AND (coalesce(area_trusted, false) OR {str(c.districts_only).lower()}) AS unplaced,
  coalesce({picky} AND got <> '{pref}', false) AS clash FROM r1),
r3 AS (SELECT *, least(2, coalesce(own, reg, 2) + CASE WHEN clash THEN 1 ELSE 0 END) AS t0,
  concat_ws('; ', CASE WHEN reg IS NOT NULL THEN concat('area from ', coalesce(nullif(region_name, ''), 'region'), ' search') END,
   CASE WHEN unplaced THEN 'district unconfirmed - verify area' END,
   CASE WHEN coalesce(own, reg) IS NULL AND NOT unplaced THEN 'outside target areas' END,
   CASE WHEN {yes} THEN CASE WHEN available_from IS NULL THEN 'availability not stated (assumed available now)'
        ELSE concat('available ', CAST(available_from AS VARCHAR)) END END,
   CASE WHEN {c.min_bathrooms} > 0 AND bathrooms IS NULL THEN CASE WHEN bathrooms_verified_by_search
        THEN 'bathrooms >= min (verified by search filter)' ELSE 'bathroom count unconfirmed' END END,
   CASE WHEN {FLEXIBLE} THEN 'landlord flexible on furnishing' END,
   CASE WHEN {picky} AND got IS NULL THEN 'furnishing unconfirmed' END,
   CASE WHEN clash THEN concat(got, ', prefer {pref}') END) AS n0 FROM r2),
r4 AS (SELECT *, CASE WHEN {lvl} = 'ground' THEN least(2, t0 + 1) WHEN {lvl} IN ('top', 'penthouse') THEN greatest(0, t0 - 1)
   WHEN floor_number >= {c.good_floor_from} THEN greatest(0, t0 - 1) ELSE t0 END AS t1 FROM r3),
r5 AS (SELECT *, CASE WHEN floor_number >= {c.lift_required_from_floor} AND {lft} <> 'yes' THEN least(2, t1 + 1) ELSE t1 END AS t2 FROM r4),
r6 AS (SELECT *, CASE WHEN '{c.concierge}' <> 'ignored' AND {porter} THEN greatest(0, t2 - 1) ELSE t2 END AS t3 FROM r5),
r7 AS (SELECT *, CASE WHEN condition IN ('refurbished', 'new_build') THEN greatest(0, t3 - 1) WHEN condition = 'needs_work' THEN least(2, t3 + 1) ELSE t3 END AS t4,
  concat_ws('; ', CASE WHEN {lvl} = 'ground' THEN 'ground floor' WHEN {lvl} IN ('top', 'penthouse') THEN 'top floor'
    WHEN floor_number >= {c.good_floor_from} THEN concat('floor ', floor_number) END,
   CASE WHEN floor_number >= {c.lift_required_from_floor} THEN CASE WHEN {lft} = 'yes' THEN 'lift confirmed'
     ELSE concat('floor ', floor_number, ' and lift ', coalesce(nullif({lft}, ''), 'unstated')) END WHEN {lft} = 'yes' THEN 'lift' END,
   CASE WHEN '{c.concierge}' <> 'ignored' AND {porter} THEN 'concierge/porter' END,
   CASE condition WHEN 'refurbished' THEN 'refurbished/renovated' WHEN 'new_build' THEN 'new build' WHEN 'needs_work' THEN 'needs refurbishment' END,
   CASE WHEN size_sqft IS NULL THEN CASE WHEN {c.min_sqft} > 0 THEN 'size not stated - verify' END ELSE concat(size_sqft, ' sq ft') END) AS n1 FROM r6),
r8 AS (SELECT *, CASE '{c.aircon}' WHEN 'ignored' THEN t4 WHEN 'required' THEN CASE WHEN aircon <> 'unchecked' AND NOT {hit} THEN 2 ELSE t4 END
    ELSE CASE WHEN {hit} THEN greatest(0, t4 - 1) ELSE t4 END END AS t5,
  concat_ws('; ', CASE WHEN aircon IN ('yes', 'likely') AND aircon_scope = 'communal_only' THEN 'A/C is communal only, not in the unit' END,
   CASE WHEN '{c.aircon}' = 'required' AND aircon = 'unchecked' THEN 'A/C not yet checked - detail page unread' END,
   CASE WHEN '{c.aircon}' = 'required' AND aircon <> 'unchecked' AND NOT {hit} THEN concat('A/C not confirmed in unit (', aircon, ')') END,
   CASE WHEN '{c.aircon}' = 'preferred' AND {hit} THEN 'A/C in unit' END) AS n2 FROM r7),
r9 AS (SELECT *, coalesce(t5 = 0 AND {strict} AND {picky} AND got IN ('unfurnished', 'furnished') AND got <> '{pref}', false) AS cap1,
  t5 = 0 AND '{c.concierge}' = 'expected' AND NOT {porter} AS cap2,
  coalesce(t5 = 0 AND {c.min_sqft} > 0 AND size_sqft_plan < {c.min_sqft} AND coalesce(size_sqft, 0) = 0, false) AS cap3 FROM r8),
ranked AS (SELECT *, CASE WHEN cap1 OR cap2 OR cap3 THEN 1 ELSE t5 END AS tier,
  CASE CASE WHEN cap1 OR cap2 OR cap3 THEN 1 ELSE t5 END WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS priority,
  concat_ws('; ', CASE WHEN cap1 THEN concat(got, ' - never High') END, CASE WHEN cap2 THEN 'no concierge mentioned - never High' END,
   CASE WHEN cap3 THEN concat('floorplan reads ', size_sqft_plan, ' sq ft (min {c.min_sqft}) - never High') END) AS n3,
  concat_ws('; ', nullif(n0, ''), nullif(n1, ''), nullif(n2, ''), nullif(concat_ws('; ', CASE WHEN cap1 THEN concat(got, ' - never High') END,
   CASE WHEN cap2 THEN 'no concierge mentioned - never High' END,
   CASE WHEN cap3 THEN concat('floorplan reads ', size_sqft_plan, ' sq ft (min {c.min_sqft}) - never High') END), '')) AS rank_notes FROM r9)"""


HIT = "coalesce(aircon IN ('yes', 'likely') AND aircon_scope = 'in_unit', false)"
LIVE = "upper(coalesce(status, '')) NOT IN ('REJECTED', 'DISMISSED', 'GONE')"
RANK_ORDER = ("CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END, "
              f"CASE WHEN {HIT} THEN 0 ELSE 1 END, coalesce(nullif(price_pcm, 0), 1000000000), url")
