"""Ads out of search pages: embedded payloads and card texts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger import fixed
from adledger.functions import extract
from adledger.functions.blanks import some_text
from adledger.functions.text import strip
from adledger.schemas import AD

NESTED_AD = """STRUCT<displayAddress: STRING, propertyUrl: STRING,
 propertyTypeFullDescription: STRING, bedrooms: INT, bathrooms: INT, displaySize: STRING,
 letAvailableDate: STRING, price: STRUCT<amount: DOUBLE, frequency: STRING>,
 customer: STRUCT<branchDisplayName: STRING>>"""
NESTED_PAYLOAD = f"""STRUCT<props: STRUCT<pageProps: STRUCT<searchResults: STRUCT<
 resultCount: STRING, properties: ARRAY<{NESTED_AD}>>>>>"""
REDUX_AD = """STRUCT<`details-url`: STRING, `property-title`: STRING, address: STRING,
 price: STRING, bedrooms: INT, bathrooms: INT, agent: STRING, features: ARRAY<STRING>>"""
REDUX_RESULTS = f"STRUCT<results: STRUCT<totalResults: STRING, list: ARRAY<{REDUX_AD}>>>"
REDUX_PAYLOAD = f"""STRUCT<props: STRUCT<initialReduxState: {REDUX_RESULTS},
 pageProps: STRUCT<initialReduxState: {REDUX_RESULTS}>>>"""


def _payload(page: Column, schema: str) -> Column:
    return F.from_json(F.nullif(F.regexp_extract(page, fixed.NEXT_DATA, 1), F.lit("")), schema)


def _absolute(url: Column, base: str) -> Column:
    return F.when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


def _title(title: Column, otherwise: Column) -> Column:
    return F.substring(F.coalesce(some_text(title), otherwise, F.lit("")), 1, fixed.TITLE_CHARS)


def nested_parsed(page: Column) -> Column:
    return _payload(page, NESTED_PAYLOAD)["props"]["pageProps"]["searchResults"]


def nested_ads(found: Column) -> tuple[Column, Column]:
    """The stated total and the ads of a nested payload, parsed.

    The total is null when the page could not be read and 0 when it states zero.
    """
    count = F.replace(found["resultCount"], F.lit(","), F.lit(""))
    total = F.when(found["properties"].isNotNull() & count.rlike(r"^\d+$"), count.try_cast("int"))
    return total, found["properties"]


def nested_facts(ad: Column, as_of: Column, base: str) -> dict[str, Column]:
    address = strip(F.replace(F.coalesce(ad["displayAddress"], F.lit("")), F.lit("\n"), F.lit(" ")))
    url = F.substring_index(F.coalesce(ad["propertyUrl"], F.lit("")), "#", 1)
    amount = F.nullif(ad["price"]["amount"], F.lit(0.0))
    price = F.when(ad["price"]["frequency"] == "weekly", extract.weekly_to_monthly(amount)
                   ).otherwise(amount.cast("int"))
    return {"url": _absolute(url, base), "title": _title(ad["propertyTypeFullDescription"], address),
            "area": address, "postcode": address, "price_pcm": price,
            "available_from": F.substring(ad["letAvailableDate"], 1, 10).try_cast("date"),
            "bed_count": ad["bedrooms"], "bathrooms": ad["bathrooms"],
            "size_sqft": extract.area_sqft(ad["displaySize"]), "contact": ad["customer"]["branchDisplayName"]}


def alt_path_parsed(page: Column) -> Column:
    return _payload(page, REDUX_PAYLOAD)["props"]


def alt_path_ads(props: Column) -> tuple[Column, Column]:
    """The total and the ads of a payload, parsed, that sits under either of two paths.

    The total is the stated integer, else the number of ads on the page.
    """
    found = F.coalesce(props["pageProps"]["initialReduxState"], props["initialReduxState"])["results"]
    ads, said = found["list"], found["totalResults"]
    stated = F.when(ads.isNotNull() & said.rlike(r"^-?\d+$"), said.try_cast("int"))
    on_page = F.when(ads.isNotNull(), F.size(ads)).otherwise(0)
    return F.coalesce(F.nullif(stated, F.lit(0)), on_page), ads


def alt_path_facts(ad: Column, as_of: Column, base: str) -> dict[str, Column]:
    features = F.substring(F.array_join(ad["features"], " / "), 1, fixed.FEATURE_CHARS)
    return {"url": _absolute(F.coalesce(ad["details-url"], F.lit("")), base),
            "title": _title(ad["property-title"], ad["address"]),
            "area": ad["address"], "postcode": ad["address"], "price_pcm": extract.monthly_price(ad["price"]),
            "bed_count": ad["bedrooms"], "bathrooms": ad["bathrooms"],
            "contact": F.get_json_object(ad["agent"], "$.name"), "notes": F.nullif(features, F.lit(""))}


def pipe_card_facts(card: Column, as_of: Column, base: str) -> dict[str, Column]:
    """What an "a | b | c" card states."""
    t = card["txt"]
    address = strip(extract.found(t, fixed.CARD_ADDRESS))
    return {"url": card["href"],
            "title": F.substring(F.regexp_replace(t, fixed.CARD_PROMO, ""), 1, fixed.TITLE_CHARS),
            "area": address, "postcode": address, "price_pcm": extract.monthly_price(t),
            "bed_count": extract.to_int(extract.found(t, fixed.CARD_BEDS)),
            "bathrooms": extract.to_int(extract.found(t, fixed.CARD_BATHS)), "size_sqft": extract.area_sqft(t)}


def flagged_card_facts(card: Column, as_of: Column, base: str) -> dict[str, Column]:
    """As above, with furnishing and availability; bathrooms count as verified by the search."""
    t = card["txt"]
    address = strip(extract.found(t, fixed.FLAG_CARD_ADDRESS))
    title = F.coalesce(extract.found(t, fixed.FLAG_CARD_TITLE), t)
    return {"url": _absolute(card["href"], base), "title": F.substring(title, 1, fixed.TITLE_CHARS),
            "area": address, "postcode": address, "price_pcm": extract.monthly_price(t),
            "bed_count": extract.to_int(extract.found(t, fixed.FLAG_CARD_BEDS)),
            "furnished": extract.found(t, fixed.FLAG_CARD_FURNISHING),
            "available_from": extract.availability(t, as_of), "size_sqft": extract.area_sqft(t),
            "bathrooms_verified_by_search": F.lit(True)}


def _payload_rows(pages: DataFrame, page: str, base: str, platform: str, keep, parsed, ads, facts) -> DataFrame:
    # parsed in a step of its own, so once, however many of its parts are read
    total, each = ads(F.col("_r"))
    rows = pages.select(*keep, parsed(F.col(page)).alias("_r")).select(
        *keep, total.alias("total"), F.explode_outer(each).alias("_ad"))
    ad = F.col("_ad")
    found = {"platform": F.lit(platform), **facts(ad, F.lit(None).cast("date"), base)}
    return rows.select(*keep, "total", *[F.when(ad.isNotNull(), v).alias(n) for n, v in found.items()])


def payload_search_nested(pages: DataFrame, page: str = "html", base: str = "",
                          platform: str = "Rightmove", keep=("search_url", "page_no")) -> DataFrame:
    """Ads of a nested search payload, one row each; an empty page keeps one row."""
    return _payload_rows(pages, page, base, platform, keep, nested_parsed, nested_ads, nested_facts)


def payload_search_alt_path(pages: DataFrame, page: str = "html", base: str = "",
                            platform: str = "OnTheMarket",
                            keep=("search_url", "page_no")) -> DataFrame:
    """Ads of a payload that sits under either of two paths, one row each; an empty page keeps one row."""
    return _payload_rows(pages, page, base, platform, keep, alt_path_parsed, alt_path_ads, alt_path_facts)


def _has_href(card: Column) -> Column:
    return ~F.coalesce(card["href"] == "", F.lit(True))


def _card_rows(cards: DataFrame, as_of: Column, base: str, platform: str, keep, facts) -> DataFrame:
    rows = cards.select(*keep, F.struct("href", "txt").alias("_ad")).where(_has_href(F.col("_ad")))
    found = {"platform": F.lit(platform), **facts(F.col("_ad"), as_of, base)}
    return rows.select(*keep, *[v.alias(n) for n, v in found.items()])


def card_search_pipe(cards: DataFrame, platform: str = "Zoopla",
                     keep=("search_url",)) -> DataFrame:
    """Ads out of "a | b | c" card texts (``href``, ``txt``)."""
    return _card_rows(cards, F.lit(None).cast("date"), "", platform, keep, pipe_card_facts)


def card_search_flagged(cards: DataFrame, as_of: Column, base: str = "",
                        platform: str = "OpenRent", keep=("search_url",)) -> DataFrame:
    """As above, with furnishing and availability; bathrooms count as verified by the search."""
    return _card_rows(cards, as_of, base, platform, keep, flagged_card_facts)


CARD = "STRUCT<href: STRING, txt: STRING>"


class Search(NamedTuple):
    """How a source's search pages are read; without ``parsed`` it is by their cards."""

    facts: Callable[[Column, Column, str], dict[str, Column]]
    ad: str = CARD
    parsed: Callable[[Column], Column] | None = None
    ads: Callable[[Column], tuple[Column, Column]] = lambda cards: (F.lit(None), cards)


SEARCHES: dict[str, Search] = {
    "Rightmove": Search(nested_facts, NESTED_AD, nested_parsed, nested_ads), "Zoopla": Search(pipe_card_facts),
    "OnTheMarket": Search(alt_path_facts, REDUX_AD, alt_path_parsed, alt_path_ads), "OpenRent": Search(flagged_card_facts),
}
FACTS = ("url", "title", "platform", "area", "postcode", "price_pcm", "available_from", "furnished", "bed_count",
         "bathrooms", "size_sqft", "contact", "notes", "bathrooms_verified_by_search")


def read_searches(pages: DataFrame, as_of: Column, bases: Mapping[str, str] | None = None,
                  searches: Mapping[str, Search] = SEARCHES, source: str = "source_name",
                  keep=("search_url",)) -> DataFrame:
    """Ads of every search page (``html``, ``cards``) through its source's reader, one row each.

    The pages are read once and unfolded once: each reader leaves its own array of ads, null
    for pages of other sources, and a row after the unfolding holds the ad of one source.
    A payload page without ads keeps one row with its total, a page of cards none; a card
    without a link is dropped. Pages of other sources are left out.
    """
    c, kinds = F.col, {f.name: f.dataType for f in AD}
    df, numbered = pages.where(c(source).isin(*searches)), list(enumerate(searches.items()))
    df = df.select(source, *keep, *[
        F.when(c(source) == name, s.parsed(c("html")) if s.parsed else c("cards")).alias(f"_p{i}") for i, (name, s) in numbered])
    totals, arrays = [], []
    for i, (name, s) in numbered:
        total, ads = s.ads(c(f"_p{i}"))
        totals.append(F.when(c(source) == name, total).cast("int"))
        arrays.append(F.coalesce(ads, F.array().cast(f"array<{s.ad}>")).alias(f"_a{i}"))
    df = df.select(source, *keep, F.coalesce(*totals).alias("total"), *arrays)
    df = df.select(source, *keep, "total", F.explode_outer(F.arrays_zip(*[f"_a{i}" for i, _ in numbered])).alias("_one"))
    df = df.select(source, *keep, "total", *[c("_one").getField(f"_a{i}").alias(f"_a{i}") for i, _ in numbered])
    found, wanted = [], F.lit(False)
    for i, (name, s) in numbered:
        here, ad = c(source) == name, c(f"_a{i}")
        facts = {"platform": F.lit(name), **s.facts(ad, as_of, (bases or {}).get(name, ""))}
        row = F.struct(*[facts.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in FACTS])
        found.append(F.when(here & ad.isNotNull(), row))
        wanted = wanted | (here & (F.lit(True) if s.parsed else _has_href(ad)))
    return df.where(wanted).withColumn("_ad", F.coalesce(*found)).select(source, *keep, "total", "_ad.*")
