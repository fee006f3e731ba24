import random

import pytest
from pyspark.sql import functions as F

from adledger.operators import cluster
from adledger.schemas import RECORD


def first_fit(ads):
    """The clustering rule on plain dicts, one ad at a time."""
    def agree(a, b):
        return all(not a[k] or not b[k] or a[k] == b[k] for k in ("oc", "floor_level", "size_sqft", "size_sqft_plan"))

    out, reps = {}, []
    for ad in ads:
        key = (ad["price_pcm"], ad["bedrooms"], ad["bathrooms"], ad["street"])
        home = None if not ad["price_pcm"] else next((r for k, r in reps if k == key and agree(r, ad)), None)
        if home is None:
            reps.append((key, ad))
            home = ad
        out[ad["url"]] = home["url"]
    return out


def random_ads(seed, n, streets=2):
    rnd = random.Random(seed)
    ads = []
    for i in range(n):
        oc, street = rnd.choice([None, "SW3", "SW6"]), f"mill lane {rnd.randrange(streets)}"
        ads.append(dict(url=f"u{i:04d}", price_pcm=rnd.choice([None, 0, 2000, 2000, 2000]), bedrooms=rnd.choice([None, 2]),
                        bathrooms=1, street=street, oc=oc, area=street + (f" {oc}" if oc else ""),
                        floor_level=rnd.choice([None, "", "top", "ground"]), size_sqft=rnd.choice([None, 0, 700, 720, 740]),
                        size_sqft_plan=rnd.choice([None, 690, 701]), priority="High", status="NEW"))
    return ads


def clusters(df):
    return {r.url: r.cluster_id for r in cluster.cluster_ads(df, [F.col("url")]).select("url", "cluster_id").collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_clusters_as_one_at_a_time(rows, seed):
    ads = random_ads(seed, 160)
    assert clusters(rows(RECORD, *ads)) == first_fit(sorted(ads, key=lambda a: a["url"]))


def test_a_block_of_thousands_of_signatures(rows):
    rnd = random.Random(7)
    ads = []
    for i in range(4000):
        oc = rnd.choice([None, *(f"SW{n}" for n in range(1, 10))])
        ads.append(dict(url=f"u{i:04d}", price_pcm=2000, bedrooms=None, bathrooms=1, street="mill lane", oc=oc,
                        area="mill lane" + (f" {oc}" if oc else ""), floor_level=rnd.choice([None, "top", "ground", "first"]),
                        size_sqft=rnd.choice([None, *range(600, 640)]), size_sqft_plan=rnd.choice([None, *range(500, 540)]),
                        priority="High", status="NEW"))
    assert len({tuple(a.get(k) for k in ("oc", "floor_level", "size_sqft", "size_sqft_plan")) for a in ads}) > 3500
    assert clusters(rows(RECORD, *ads)) == first_fit(ads)


def test_a_null_is_a_value_of_its_own_in_a_key(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), (None, None)], "x string, y string")
    assert df.select(cluster._hashed(F.col("x"), F.col("y")).alias("h")).distinct().count() == 4


def test_a_block_of_copies_is_one_signature(rows):
    ads = [dict(url=f"u{i:05d}", price_pcm=2000, bedrooms=2, bathrooms=1, area="Mill Lane", priority="Low") for i in range(3000)]
    keyed = cluster.with_facts(rows(RECORD, *ads)).withColumns({"_rank": F.struct("url"), "_block": F.lit(1)})
    assert cluster.signatures(keyed).count() == 1
    summary = cluster.summarise(cluster.cluster_ads(rows(RECORD, *ads)))
    assert [(r.cluster_id, r.n_ads) for r in summary.collect()] == [("u00000", 3000)]


def test_units_in_a_building(rows):
    def ad(url, area, status="NEW"):
        return dict(url=url, area=area, status=status)

    df = rows(RECORD, ad("a", "Kings Road SW3"), ad("b", "Kings Road SW3"), ad("c", "Kings Road SW6"), ad("d", "Kings Road"),
              ad("e", "Kings Road SW3", "GONE"), ad("f", None))
    got = {r.url: r.units for r in cluster.units_in_building(df, cluster.building_counts(df)).collect()}
    assert got == {"a": 3, "b": 3, "c": 2, "d": 3, "e": 3, "f": 0}


def test_facts_and_sections(rows):
    base = dict(price_pcm=2000, bedrooms=2, bathrooms=1, area="Mill Lane", aircon="yes", aircon_scope="in_unit")
    df = cluster.cluster_ads(rows(RECORD, {**base, "url": "a", "priority": "High", "furnished": "Furnished or unfurnished"},
                                  {**base, "url": "b", "priority": "Low", "furnished": "Furnished"},
                                  {**base, "url": "c", "priority": "Low", "price_pcm": 2100}))
    facts = {r.cluster_id: (r.n_ads, r.furnishing) for r in cluster.cluster_facts(df).collect()}
    assert facts == {"a": (2, "either / furnished"), "c": (1, "?")}
    summary = cluster.summarise(df)
    assert {(r.priority, r.clusters, r.ads) for r in cluster.tier_sections(summary).collect()} == {("High", 1, 2), ("Low", 1, 1)}
    assert cluster.flats_and_ads(summary).first() == (2, 3)


def test_facts_hold_all_links_the_best_first(rows):
    base = dict(price_pcm=2000, bedrooms=2, bathrooms=1, area="Mill Lane")
    df = cluster.cluster_ads(rows(RECORD, {**base, "url": "a", "priority": "Low", "platform": "Beta", "furnished": "Furnished"},
                                  {**base, "url": "b", "priority": "High", "platform": " "},
                                  {**base, "url": "c", "priority": "Medium", "platform": "Alpha", "furnished": "Furnished"},
                                  {**base, "url": "d", "priority": "Low", "price_pcm": 2100, "platform": "Beta"}))
    facts = {r.cluster_id: (r.n_ads, r.links, r.furnishing) for r in cluster.cluster_facts(df).collect()}
    assert facts == {"b": (3, "[link](b), [Alpha](c), [Beta](a)", "furnished"), "d": (1, "[Beta](d)", "?")}
    unlinked = cluster.cluster_facts(df).drop("links")._jdf.queryExecution().optimizedPlan().toString()
    assert "[link](" not in unlinked and "](" not in unlinked


def test_shortlist_cuts_only_the_last_tier(rows):
    ads = [dict(url=f"{p}{i}", price_pcm=1000 + i, bedrooms=1, bathrooms=1, area=f"{p} {i} Mill Lane", priority=p)
           for p in ("High", "Low") for i in range(5)]
    summary = cluster.summarise(cluster.cluster_ads(rows(RECORD, *ads)))
    kept = {r.cluster_id for r in cluster.shortlist(summary, 2).collect()}
    assert kept == {f"High{i}" for i in range(5)} | {"Low0", "Low1"}
    more = {r.priority: r.more for r in cluster.more_than_shown(summary, 2).collect()}
    assert more == {"High": 0, "Low": 3}


@pytest.mark.parametrize("fold", [0, 40, 10_000])
def test_folded_in_turn_or_settled_in_rounds(rows, fold):
    """Blocks under the bound, crowded blocks of few signatures, and crowded blocks of many give the same clusters."""
    ads = random_ads(11, 400, streets=5)
    df = cluster.cluster_ads(rows(RECORD, *ads), [F.col("url")], columns=["platform"], fold=fold)
    assert df.columns == ["url", "platform", "ad_rank", "cluster_id"]
    assert {r.url: r.cluster_id for r in df.collect()} == first_fit(sorted(ads, key=lambda a: a["url"]))


def test_a_block_is_not_joined_with_itself(spark, rows, monkeypatch):
    """A block under the bound costs one shuffle: no round, no join."""
    monkeypatch.setattr(cluster, "_round", None)
    df = cluster.cluster_ads(rows(RECORD, *random_ads(3, 200)), [F.col("url")])
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
