"""Typed facts out of prose and payloads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adledger import fixed
from adledger.functions.text import let, mentions, squash, strip, unescape_items


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, or null when the pattern does not match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def to_int(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("int")


# --- money and size ----------------------------------------------------------

def money(c: Column) -> Column:
    """First pound amount."""
    return to_int(found(c, fixed.AMOUNT))


def weekly_to_monthly(c: Column) -> Column:
    return F.rint(c * 52 / 12).cast("int")


def monthly_price(c: Column) -> Column:
    """A monthly figure, else a weekly one converted, else any amount beside a monthly word."""
    def first(pattern: str) -> Column:
        return let(F.regexp_extract(c, pattern, 1), lambda x: F.nullif(x, F.lit("")))

    weekly = F.replace(first(fixed.WEEKLY), F.lit(","), F.lit("")).try_cast("double")
    return F.when(mentions(c, "£"), F.coalesce(
        to_int(first(fixed.MONTHLY)),
        weekly_to_monthly(weekly),
        F.when(c.rlike(fixed.MONTH_WORD), to_int(first(fixed.BARE_AMOUNT)))))


def area_sqft(c: Column) -> Column:
    """Largest plausible "N sq ft"."""
    low, high = fixed.SQFT_RANGE
    sizes = F.transform(F.regexp_extract_all(c, F.lit(fixed.SQFT), F.lit(1)), to_int)
    return F.when(mentions(F.lower(c), "sq"),
                  F.array_max(F.filter(sizes, lambda v: v.between(low, high))))


def size_from_payload(c: Column, *patterns: str) -> Column:
    """A plausible size under a named key; the patterns are tried in order."""
    low, high = fixed.PAYLOAD_SIZE_RANGE

    def one(pattern: str) -> Column:
        v = F.replace(found(c, pattern), F.lit(","), F.lit("")).try_cast("double")
        v = F.when(v < 1e9, v).cast("int")
        return F.when(v.between(low, high), v)

    return F.coalesce(*[one(p) for p in patterns])


def fact_labels(c: Column, block: str, item: str) -> Column:
    """Labels inside a named array of the page's payload."""
    raw = F.regexp_extract_all(F.regexp_extract(c, block, 1), F.lit(item), F.lit(1))
    plain = F.transform(raw, lambda x: F.replace(
        F.replace(x, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    return F.filter(F.transform(unescape_items(plain), lambda x: strip(x)), lambda x: x != "")


# --- furnishing --------------------------------------------------------------

def furnishing_from_labels(labels: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in fixed.FURNISHING_LABELS.items() for x in kv])
    read = F.transform(labels, lambda x: F.when(
        x.rlike(fixed.FLEXIBLE_PHRASE), F.lit(fixed.FLEXIBLE)
    ).otherwise(F.element_at(names, F.lower(strip(x)))))
    return F.get(F.filter(read, lambda x: x.isNotNull()), F.lit(0))


def furnishing_in_text(c: Column) -> Column:
    def word(found_word: Column) -> Column:
        return F.concat(F.upper(F.substring(found_word, 1, 1)),
                        F.lower(found_word.substr(F.lit(2), F.length(found_word))))

    return F.when(mentions(F.lower(c), "furnished"), F.when(
        c.rlike(fixed.FLEXIBLE_PHRASE), F.lit(fixed.FLEXIBLE)
    ).otherwise(let(found(c, fixed.FURNISHING_WORD), word)))


def is_flexible(furnished: Column) -> Column:
    raw = F.lower(F.coalesce(furnished, F.lit("")))
    return F.contains(raw, F.lit("or unfurnished")) | F.contains(raw, F.lit("unfurnished or"))


def _furnishing(furnished: Column, flexible, part: str) -> Column:
    raw = F.lower(strip(furnished))
    return (F.when(is_flexible(furnished), flexible)
            .when(raw.startswith("part"), part)
            .when(raw.isin("no", "unfurnished"), "unfurnished")
            .when(raw.isin("yes", "furnished"), "furnished"))


def furnishing_of(furnished: Column, preference: Column) -> Column:
    """What the ad states; a flexible landlord meets any preference."""
    return _furnishing(furnished, preference, "part furnished")


def furnishing_label(furnished: Column) -> Column:
    return _furnishing(furnished, F.lit("either"), "part")


# --- dates -------------------------------------------------------------------

def _month_number(name: Column) -> Column:
    pairs = {m: i for i, m in enumerate(fixed.MONTHS, 1)}
    pairs.update({m[:3]: i for i, m in enumerate(fixed.MONTHS, 1)})
    lookup = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.element_at(lookup, F.lower(name))


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """A real calendar date, or null."""
    return F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"),
                       F.lpad(day, 2, "0")).try_cast("date")


def _written(v: Column, year: str) -> list[Column]:
    """The four full spellings of a date in ``v``."""
    def g(pattern, i):
        return found(v, pattern, i)

    worded = rf"^(\d{{1,2}})\s+([A-Za-z]+)\s+({year})$"
    slashed = rf"^(\d{{1,2}})/(\d{{1,2}})/({year})$"
    iso = rf"^({year})-(\d{{1,2}})-(\d{{1,2}})$"
    month = _month_number(g(worded, 2))
    return [
        F.when(month.isNotNull(), _ymd(g(worded, 3), month, g(worded, 1))),
        F.when(v.rlike(slashed), _ymd(g(slashed, 3), g(slashed, 2), g(slashed, 1))),
        F.when(v.rlike(iso), _ymd(g(iso, 1), g(iso, 2), g(iso, 3))),
    ]


def parse_date(c: Column) -> Column:
    """ISO, "1 December 2026", "1 Dec 2026" or "01/12/2026"; anything else is null."""
    return F.coalesce(*_written(strip(c), r"\d{4}"))


def one_date(value: Column, as_of: Column) -> Column:
    """The date inside one label value, read against ``as_of``."""
    month_year, day_month = r"^([A-Za-z]+) (20\d\d)$", r"^(\d{1,2}) ([A-Za-z]+)$"

    def yearless(inside: Column, month: Column, offset: int) -> Column:
        year = (F.year(as_of) + offset).cast("string")
        return let(_ymd(year, month, found(inside, day_month, 1)), lambda d: F.when(
            F.datediff(as_of, d) <= fixed.YEARLESS_PAST_DAYS, d))

    def dated(inside: Column) -> Column:
        m1 = _month_number(found(inside, month_year, 1))
        m2 = _month_number(found(inside, day_month, 2))
        return F.coalesce(
            *_written(inside, r"20\d\d"),
            let(m1, lambda m: F.when(m.isNotNull(), _ymd(
                found(inside, month_year, 2), m, F.lit("1")))),
            let(m2, lambda m: F.when(m.isNotNull(), F.coalesce(
                yearless(inside, m, 0), yearless(inside, m, 1)))))

    def read(v: Column) -> Column:
        plain = F.regexp_replace(
            F.regexp_extract(v, fixed.DATE_IN_VALUE, 1), fixed.ORDINAL, "$1")
        return F.when(v.rlike(fixed.IMMEDIATE), as_of).otherwise(
            let(squash(F.replace(plain, F.lit(","), F.lit(" "))), dated))

    return let(strip(strip(strip(value), "-")), read)


def availability(c: Column, as_of: Column) -> Column:
    """First availability phrase whose value is a date."""
    values = F.regexp_extract_all(c, F.lit(fixed.AVAILABLE_PHRASE), F.lit(1))
    dates = F.transform(values, lambda v: one_date(v, as_of))
    return F.when(mentions(F.lower(c), "availab"),
                  F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0)))


# --- addresses ---------------------------------------------------------------

def district(postcode: Column, area: Column | None = None) -> Column:
    """Outward code in the postcode, else in the address."""
    fields = [postcode] if area is None else [postcode, area]
    return F.upper(F.coalesce(*[found(f, fixed.DISTRICT) for f in fields]))


def district_stem(d: Column) -> Column:
    """SW1X -> SW1; null when there is no trailing letter."""
    return F.upper(found(d, r"^([A-Za-z]{1,2}\d{1,2})[A-Za-z]$"))


def _address(postcode: Column, area: Column) -> Column:
    return F.coalesce(F.nullif(postcode, F.lit("")), area, F.lit(""))


def addr_key(postcode: Column, area: Column) -> Column:
    """The address without its postcode and filler words, at most 40 characters."""
    words = F.regexp_replace(F.lower(_address(postcode, area)), "[^a-z0-9 ]", " ")
    spaced = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), " +", " ")
    dropped = (r"(?<= )(?:[a-z]{1,2}\d{1,2}[a-z]?(?: \d[a-z]{2})?|"
               + "|".join(fixed.ADDRESS_STOP_WORDS) + r")(?= )")
    kept = F.trim(F.regexp_replace(F.regexp_replace(spaced, dropped, ""), " +", " "))
    return F.substring(kept, 1, fixed.ADDRESS_KEY_CHARS)


def outcode(postcode: Column, area: Column) -> Column:
    return F.upper(found(_address(postcode, area), fixed.POSTCODE, 1))


def incode(postcode: Column, area: Column) -> Column:
    return F.upper(found(_address(postcode, area), fixed.POSTCODE, 2))


def host(url: Column) -> Column:
    """The host part of a URL; never fails on a malformed one."""
    return found(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)")


# --- amenities in prose ------------------------------------------------------

def prose_floor_number(low: Column) -> Column:
    """First floor phrase that resolves to a number; 0 is the ground floor."""
    floors = F.create_map(*[F.lit(x) for kv in fixed.WORD_FLOOR.items() for x in kv])
    phrases = F.regexp_extract_all(low, F.lit(fixed.FLOOR_PHRASE), F.lit(0))

    def resolve(phrase: Column) -> Column:
        words = F.coalesce(*[found(phrase, fixed.FLOOR_PHRASE, i) for i in (1, 2, 3)])
        return let(words, lambda w: F.coalesce(w.try_cast("int"), F.element_at(floors, w)))

    return F.get(F.filter(F.transform(phrases, resolve), lambda n: n.isNotNull()), F.lit(0))


def amenities(c: Column) -> Column:
    """Floor, lift, concierge, condition and stated size, as one struct.

    Each pattern only runs on texts that hold one of the words it needs.
    """
    def read(low: Column) -> Column:
        def has(pattern: str, *words: str) -> Column:
            return mentions(low, *words) & low.rlike(pattern)

        work = ("refurbish", "renovat", "modernis")
        below = has(fixed.LOWER_GROUND, "lower", "basement", "garden")
        top = has(fixed.TOP_FLOOR, "floor", "penthouse")
        lift = (F.when(has(fixed.LIFT_NO, "lift", "walk", "elevator"), "no")
                .when(has(fixed.LIFT_YES, "lift", "elevator"), "yes"))
        condition = (
            F.when(has(fixed.NEEDS_WORK, *work, "updating", "work", "tlc"), "needs_work")
            .when(has(fixed.NEW_BUILD, "build"), "new_build")
            .when(has(fixed.REFURBISHED, *work, "redecorat", "brand"), "refurbished"))
        level = F.when(below, "lower_ground").when(top, "top")
        number = F.when(level.isNull() & mentions(low, "floor"), prose_floor_number(low))
        stated = F.when(mentions(low, "floorplan "),
                        F.regexp_replace(low, fixed.PLAN_LINE, "")).otherwise(low)
        return let(number, lambda n: F.struct(
            F.coalesce(level, F.when(n == 0, "ground")).alias("floor_level"),
            F.when(n != 0, n).alias("floor_number"), lift.alias("lift"),
            F.when(has(fixed.CONCIERGE, "concierge", "porter", "door"), "yes").alias("concierge"),
            condition.alias("condition"), area_sqft(stated).alias("size_sqft")))

    return let(F.lower(F.coalesce(c, F.lit(""))), read)


def any_amenity(a: Column) -> Column:
    names = ("floor_level", "floor_number", "lift", "concierge", "condition", "size_sqft")
    return F.coalesce(*[a[n].cast("string") for n in names]).isNotNull()


# --- plan text ---------------------------------------------------------------

def _readings(flat: Column, unit: str, low: int, high: int) -> Column:
    """Plausible areas in one unit, each with the text just before it.

    Spark has no "all match positions", so a look-behind captures the label
    text; it only runs where the number and unit already match.
    """
    chars = fixed.PLAN_LABEL_CHARS
    area = fixed.PLAN_NUMBER + r"\s*" + unit
    behind = rf"(?<=(^.{{0,{chars - 1}}}|.{{{chars}}}))"
    pattern = rf"(?isU)(?=\d)(?={area}){behind}({area})"

    def every(group: int) -> Column:
        return F.regexp_extract_all(flat, F.lit(pattern), F.lit(group))

    number = "^" + fixed.PLAN_NUMBER
    rows = F.transform(
        F.arrays_zip(every(2).alias("before"), every(3).alias("match")),
        lambda r: F.struct(
            F.replace(F.regexp_extract(r["match"], number, 1), F.lit(","), F.lit(""))
            .try_cast("double").alias("value"),
            r["before"].rlike(fixed.PLAN_TOTAL).alias("total"),
            r["before"].rlike(fixed.PLAN_GROSS).alias("gross"),
            F.right(F.trim(F.concat(r["before"], r["match"])), F.lit(chars)).alias("evidence")))
    return F.filter(rows, lambda r: r["value"].between(low, high))


def _best(rows: Column) -> Column:
    """The first row with the largest value."""
    return let(F.array_max(F.transform(rows, lambda r: r["value"])), lambda top: F.get(
        F.filter(rows, lambda r: r["value"] == top), F.lit(0)))


def _pick(rows: Column, scale: float, suffix: str, plain: str) -> Column:
    def result(best: Column, basis: str, confident: Column) -> Column:
        return let(best, lambda b: F.when(b.isNotNull(), F.struct(
            F.rint(b["value"] * scale).cast("int").alias("sqft"),
            F.lit(basis).alias("basis"), b["evidence"].alias("evidence"),
            confident.alias("confident"))))

    return F.coalesce(
        result(_best(F.filter(rows, lambda r: r["total"])), "total" + suffix, F.lit(True)),
        result(_best(F.filter(rows, lambda r: r["gross"])), "gross" + suffix, F.lit(True)),
        result(_best(rows), plain, F.size(rows) == 1))


def parse_area(c: Column) -> Column:
    """Area stated on a plan: (sqft, basis, evidence, confident).

    Feet beat metres; a total beats a gross internal area, which beats an
    unlabelled number. Several unlabelled numbers are not trusted.
    """
    def feet_then_metres(flat: Column) -> Column:
        feet = _readings(flat, fixed.PLAN_FEET, *fixed.PLAN_FEET_RANGE)
        metres = _readings(flat, fixed.PLAN_METRES, *fixed.PLAN_METRES_RANGE)
        return F.when(mentions(F.lower(flat), "sq"), F.coalesce(
            let(feet, lambda r: _pick(r, 1.0, "", "stated")),
            let(metres, lambda r: _pick(r, fixed.SQM_TO_SQFT, "/converted", "converted"))))

    nothing = F.struct(F.lit(None).cast("int").alias("sqft"), F.lit("").alias("basis"),
                       F.lit("").alias("evidence"), F.lit(False).alias("confident"))
    return F.coalesce(let(squash(F.coalesce(c, F.lit(""))), feet_then_metres), nothing)


def plan_floors(c: Column) -> Column:
    """Distinct floor labels on a plan, in order."""
    labels = F.regexp_extract_all(
        F.coalesce(c, F.lit("")), F.lit(fixed.PLAN_FLOOR_LABEL), F.lit(1))
    return F.array_distinct(F.transform(labels, lambda x: F.lower(squash(x))))


def is_plan_text(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return let(F.regexp_count(text, F.lit(fixed.PLAN_DIMENSION)), lambda dims: (dims >= 2) | (
        (dims >= 1) & text.rlike(fixed.PLAN_FLOOR_LABEL)))


def floor_from_plan(floors: Column) -> Column:
    """(floor_level, floor_number) a plan's labels give; several levels give neither."""
    words = F.create_map(*[F.lit(x) for kv in fixed.WORD_FLOOR.items() for x in kv if kv[1]])
    below = F.arrays_overlap(floors, F.array(F.lit("lower ground"), F.lit("basement")))
    only = F.when(~below & (F.size(floors) == 1), F.get(floors, F.lit(0)))
    number = F.coalesce(found(only, r"^(\d{1,2})").try_cast("int"), F.element_at(words, only))
    return F.struct(
        F.when(below, "lower_ground")
        .when(only.isin("ground", "upper ground"), "ground").alias("floor_level"),
        F.nullif(number, F.lit(0)).alias("floor_number"))


def plan_urls(page: Column, source: Column) -> Column:
    """Floorplan images a page names, per source; full-size ones are preferred."""
    def every(pattern: str) -> Column:
        # a capturing group when the pattern has one, else the whole match
        group = 0 if pattern == fixed.PLAN_URL_DIRECT else 1
        return F.regexp_extract_all(page, F.lit(pattern), F.lit(group))

    named = every(fixed.PLAN_URL_DIRECT)
    full = F.filter(named, lambda u: ~F.contains(u, F.lit(fixed.PLAN_THUMB_MARK)))
    files = F.transform(every(fixed.PLAN_URL_FILE),
                        lambda f: F.concat(F.lit(fixed.PLAN_URL_CDN), f))
    return F.array_distinct(
        F.when(source == "Rightmove", F.when(F.size(full) > 0, full).otherwise(named))
        .when(source == "Zoopla", files)
        .when(source == "OnTheMarket", every(fixed.PLAN_URL_LARGE))
        .otherwise(F.array().cast("array<string>")))
