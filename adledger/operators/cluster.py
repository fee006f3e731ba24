"""Duplicate ads and the buildings they stand in.

Ads in one block (same price, beds, baths and address) are clustered first-fit:
in rank order, an ad joins the first cluster whose first ad it does not
contradict, else it opens one. Two ads that state the same optional facts are
treated alike by that rule: the later one always lands where the earlier one
did. So only the distinct *signatures* of a block need to take part.

Blocks of up to ``FOLD`` ads are shuffled once by block, sorted by rank and folded as
they stream by. Larger ones are first reduced to their signatures, so a block with
millions of equal ads is a few rows before its shuffle; where more than ``FOLD`` are
left, they are settled in rounds of joins. All three give the same clusters.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adledger.functions import extract
from adledger.functions.blanks import blank_number, blank_text, some_number, some_text
from adledger.operators import rules
from adledger.session import work_dir
from adledger.sources.tables import write_stage

BLOCK = ["price_pcm", "bedrooms", "bathrooms", "addr_key"]
FACTS = ["outcode", "incode", "floor", "size", "plan"]
FOLD = 20_000  # ads or signatures of a block that one task takes in turn


def with_address(df: DataFrame) -> DataFrame:
    p, a = F.col("postcode"), F.col("area")
    return df.withColumns({"addr_key": extract.addr_key(p, a),
                           "outcode": extract.outcode(p, a), "incode": extract.incode(p, a)})


def with_facts(df: DataFrame) -> DataFrame:
    """Block key and the facts that must not differ; blank facts are null."""
    level, number = some_text(F.col("floor_level")), some_number(F.col("floor_number"))
    return with_address(df).withColumns({
        "floor": F.coalesce(level, number.cast("string")),
        "size": some_number(F.col("size_sqft")).cast("string"),
        "plan": some_number(F.col("size_sqft_plan")).cast("string")})


def _rank(order: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(f"r{i}") for i, c in enumerate(order)], F.col("url").alias("url"))


def signatures(keyed: DataFrame) -> DataFrame:
    """Distinct fact combinations per block with their best-ranked ad."""
    return keyed.groupBy(F.col("_block").alias("block"), *FACTS).agg(F.min("_rank").alias("rank"))


def _mask() -> Column:
    """Which facts are stated, as bits."""
    bits = [F.when(F.col(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(FACTS)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def _hashed(*values: Column) -> Column:
    """128 bits of some values; a null is a value of its own and keeps its place."""
    told = [x for v in values for x in (v.isNull(), v)]
    return F.struct(F.xxhash64(F.lit(1), *told).alias("h1"), F.xxhash64(F.lit(2), *told).alias("h2"))


def _shared_key(both: Column) -> Column:
    """The block and the facts that a mask selects; no shared fact leaves the block alone."""
    return _hashed(F.col("block.h1"), F.col("block.h2"), both,
                   *[F.when(F.getbit(both, F.lit(i)) == 1, F.col(f)) for i, f in enumerate(FACTS)])


def _least_agreeing(asking: DataFrame, live: DataFrame, stated: Sequence[int]) -> DataFrame:
    """Per asking signature the best-ranked live one that it does not contradict.

    Two signatures agree when they are equal on the facts both state. For a pair of
    masks that is an equi-join on the block and those facts, and one minimum per key is
    all that is needed; masks without a shared fact meet in one minimum per block.
    ``stated`` are the masks that occur, 32 at most.
    """
    masks = F.array(*map(F.lit, stated))
    both = F.col("mask").bitwiseAND(F.col("other"))
    # a live signature once per set of facts that an asking mask may share with it
    shared = F.array_distinct(F.transform(masks, lambda m: F.col("mask").bitwiseAND(m)))
    keys = (live.join(asking.select("block").distinct(), "block", "left_semi").withColumn("both", F.explode(shared))
            .select(F.col("mask").alias("other"), _shared_key(F.col("both")).alias("key"), "rank", "first")
            .groupBy("other", "key").agg(F.min(F.struct("rank", "first")).alias("best")))
    return (asking.withColumn("other", F.explode(masks)).select("url", "other", _shared_key(both).alias("key")).join(keys, ["other", "key"])
            .groupBy("url").agg(F.min("best").alias("best")))


WAITING = ("block", *FACTS, "mask", "rank", "url")


def _round(waiting: DataFrame, settled: DataFrame, firsts: DataFrame, stated: Sequence[int]) -> DataFrame:
    """One round over the unsettled signatures.

    Each waits for one better-ranked signature, its blocker. If the last round made the
    blocker the first of a cluster, the signature joins it; if the blocker joined another,
    the signature asks again; else it goes on waiting and is not joined with anything.
    """
    news = settled.select(F.col("url").alias("blocker"), F.col("cluster_id").alias("via"), F.col("cluster_rank").alias("via_rank"))
    told = waiting.join(news, "blocker", "left")
    joins = F.col("via") == F.col("blocker")
    told = told.withColumns({"cluster_id": F.when(joins, F.col("via")), "cluster_rank": F.when(joins, F.col("via_rank")),
                             "blocker": F.when(F.col("via").isNull(), F.col("blocker"))}).drop("via", "via_rank")
    open_ = told.where("cluster_id IS NULL")
    live = open_.select("block", *FACTS, "mask", "rank", F.lit(False).alias("first")).unionByName(
        firsts.select("block", *FACTS, "mask", "rank", F.lit(True).alias("first")))
    best = _least_agreeing(open_.where("blocker IS NULL"), live, stated)
    out = told.join(best, "url", "left")
    own = F.col("best.rank.url") == F.col("url")
    found = F.col("best.first") | own
    return out.withColumns({
        "cluster_id": F.when(found, F.col("best.rank.url")).otherwise(F.col("cluster_id")),
        "cluster_rank": F.when(found, F.col("best.rank")).otherwise(F.col("cluster_rank")),
        "blocker": F.when(found, None).when(F.col("best").isNotNull(), F.col("best.rank.url")).otherwise(F.col("blocker")),
    }).select(*WAITING, "blocker", "cluster_id", "cluster_rank")


class _Block:
    """The clusters of one block so far: first fit in the order of the calls."""

    def __init__(self):
        self.firsts: list[tuple[tuple, str]] = []
        self.masks: dict[int, list[int]] = {}  # stated facts -> places in firsts
        self.index: dict[tuple[int, int], dict[tuple, int]] = {}  # (mask, shared) -> shared facts -> first place

    @staticmethod
    def _on(facts: tuple, shared: int) -> tuple:
        return tuple([x for i, x in enumerate(facts) if shared >> i & 1])

    def _by_index(self, facts: tuple, mask: int) -> int | None:
        places = []
        for other, members in self.masks.items():
            shared = mask & other
            known = self.index.get((other, shared))
            if known is None:
                known = self.index[other, shared] = {}
                for at in members:
                    known.setdefault(self._on(self.firsts[at][0], shared), at)
            if (at := known.get(self._on(facts, shared))) is not None:
                places.append(at)
        return min(places, default=None)

    def join(self, facts: tuple, url: str) -> str:
        """The cluster of the next ad."""
        a, b, c, d, e = facts
        if len(self.firsts) <= 32:  # so few are compared faster one by one
            for (v, w, x, y, z), first in self.firsts:
                if ((a == v or a is None or v is None) and (b == w or b is None or w is None) and (c == x or c is None or x is None)
                        and (d == y or d is None or y is None) and (e == z or e is None or z is None)):
                    return first
            mask = None
        else:
            mask = sum([1 << i for i, x in enumerate(facts) if x is not None])
            if not self.masks:
                for at, (theirs, _) in enumerate(self.firsts):
                    self.masks.setdefault(sum([1 << i for i, x in enumerate(theirs) if x is not None]), []).append(at)
            if (at := self._by_index(facts, mask)) is not None:
                return self.firsts[at][1]
        at = len(self.firsts)
        self.firsts.append((facts, url))
        if mask is not None:
            self.masks.setdefault(mask, []).append(at)
            for (other, shared), known in self.index.items():
                if other == mask:
                    known.setdefault(self._on(facts, shared), at)
        return url


def _fold(rows: DataFrame, block: str) -> DataFrame:
    """Adds ``cluster_id`` to rows with a block, facts, ``_rank`` and ``url``, block by block in rank order.

    A task holds the first ads of one block's clusters, and no more of its partition.
    """
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        last, state = None, None
        for batch in batches:
            ids = batch.column(names.index(block))
            h1, h2 = (ids.field(n).to_numpy(zero_copy_only=False) for n in ("h1", "h2"))
            same = [False, *((h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])).tolist()]
            if len(h1):
                same[0] = last == (h1[0], h2[0])
                last = (h1[-1], h2[-1])
            facts = zip(*[batch.column(names.index(f)).to_pylist() for f in FACTS])
            homes = []
            for joined, own, url in zip(same, facts, batch.column(names.index("url")).to_pylist()):
                if not joined:
                    state = _Block()
                homes.append(state.join(own, url))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes, pa.string())], [*names, "cluster_id"])

    return (rows.repartition(block).sortWithinPartitions(block, "_rank")
            .mapInArrow(run, kinds + ", cluster_id string"))


def assign_signatures(sigs: DataFrame, fold: int = FOLD) -> DataFrame:
    """block, facts, ``cluster_id`` of every signature: first-fit inside its block, for blocks of any size.

    Signatures of a block of at most ``fold`` are taken in turn by one task. The others are
    settled in rounds of equi-joins over what is still unsettled, each round written out; no
    such block is ever gathered in one task. Rounds grow with the longest chain of blockers.
    """
    spark = sigs.sparkSession
    few = F.count("*").over(Window.partitionBy("block")) <= fold
    state = write_stage(sigs.withColumns({
        "url": F.col("rank.url"), "mask": _mask(), "blocker": F.lit(None).cast("string"), "few": few,
        "cluster_id": F.lit(None).cast("string"), "cluster_rank": F.lit(None).cast(sigs.schema["rank"].dataType)}).select(
            *WAITING, "blocker", "cluster_id", "cluster_rank", "few"), work_dir(spark, "signatures"))
    turns = state.where("few").select("block", *FACTS, F.col("rank").alias("_rank"), "url")
    parts = [_fold(turns, "block")]
    state = state.where("NOT few").drop("few")
    done = state.where("false")
    firsts = state.where("false")
    stated = sorted(r.mask for r in state.select("mask").distinct().collect())
    while not (waiting := state.where("cluster_id IS NULL")).isEmpty():
        state = write_stage(_round(waiting, done, firsts, stated), work_dir(spark, "round"))
        done = state.where("cluster_id IS NOT NULL")
        parts.append(done)
        firsts = firsts.unionByName(done.where("cluster_id = url"))
    out = parts[0].select("block", *FACTS, "cluster_id")
    for part in parts[1:]:
        out = out.unionByName(part.select("block", *FACTS, "cluster_id"))
    return out


def cluster_ads(rows: DataFrame, order: Sequence[Column] | None = None, columns: Sequence[str] | None = None,
                fold: int = FOLD) -> DataFrame:
    """Adds ``cluster_id`` (URL of the cluster's best ad) and ``ad_rank``.

    Rows need unique URLs. An ad without a price or an address is a block of its own.
    ``columns`` names what the result shall hold beside ``url``; by default all, and the
    facts. ``fold`` is the most ads of a block that one task takes.
    """
    order = order if order is not None else rules.rank_order()[:-1]
    keyed = with_facts(rows).withColumn("_rank", _rank(order))
    columns = [*dict.fromkeys(["url", *(keyed.columns if columns is None else columns), "_rank"])]
    alone = blank_number(F.col("price_pcm")) | blank_text(F.col("addr_key"))
    block = F.when(alone, _hashed(F.col("url"))).otherwise(_hashed(*map(F.col, BLOCK)))
    keyed = keyed.withColumn("_block", block).select(*dict.fromkeys([*columns, "_block", *FACTS]))
    # fewer than the rows over ``fold``, two numbers each
    large = write_stage(keyed.groupBy("_block").agg(F.count("*").alias("n")).where(F.col("n") > fold).select("_block"),
                        work_dir(rows.sparkSession, "large-blocks"))
    if large.isEmpty():
        return _fold(keyed, "_block").select(*columns, "cluster_id").withColumnRenamed("_rank", "ad_rank")
    small = _fold(keyed.join(F.broadcast(large), "_block", "left_anti"), "_block").select(*columns, "cluster_id")
    crowd = keyed.join(F.broadcast(large), "_block", "left_semi")
    crowd = crowd.withColumn("_sig", _hashed(F.col("_block.h1"), F.col("_block.h2"), *map(F.col, FACTS)))
    found = assign_signatures(signatures(crowd), fold).select(
        _hashed(F.col("block.h1"), F.col("block.h2"), *map(F.col, FACTS)).alias("_sig"), "cluster_id")
    joined = crowd.join(found, "_sig").select(*columns, "cluster_id")
    return small.unionByName(joined).withColumnRenamed("_rank", "ad_rank")


SUMMED = ("priority", "price_pcm", "platform", "aircon", "aircon_scope")


def summarise(clustered: DataFrame) -> DataFrame:
    """One row per cluster: its best ad's facts, sizes and in-unit hits.

    Counts are combined before the shuffle; links are ``cluster_links``.
    """
    hit = rules.in_unit(F.col("aircon"), F.col("aircon_scope"))
    best = F.struct("ad_rank", "priority", "price_pcm", "platform", "url")
    return (clustered.groupBy("cluster_id").agg(
        F.min(best).alias("best"), F.count("*").alias("n_ads"),
        F.count_if(hit).alias("n_hits"))
        .select("cluster_id", "best.priority", "best.price_pcm", "n_ads", "n_hits",
                (F.col("n_hits") > 0).alias("in_unit"), F.col("best.ad_rank").alias("ad_rank")))


def flats_and_ads(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count_if("in_unit").alias("flats"),
                       F.coalesce(F.sum("n_hits"), F.lit(0)).alias("ads"))


def tier_sections(summary: DataFrame) -> DataFrame:
    return summary.groupBy("priority").agg(
        F.count("*").alias("clusters"), F.sum("n_ads").alias("ads"))


def _link(rows: DataFrame) -> Column:
    platform = some_text(F.col("platform")) if "platform" in rows.columns else F.lit(None).cast("string")
    return F.concat(F.lit("["), F.coalesce(platform, F.lit("link")), F.lit("]("), F.col("url"), F.lit(")"))


def cluster_links(clustered: DataFrame) -> DataFrame:
    """One row per link; ``ad_rank`` gives the order inside a cluster.

    Links stay rows, so a cluster of any size is never gathered into one value.
    """
    return clustered.select("cluster_id", "ad_rank", _link(clustered).alias("link"))


def cluster_facts(clustered: DataFrame) -> DataFrame:
    """Per cluster: size, links, the best first, and the distinct furnishing labels, first seen first.

    The links of a cluster are one text, so its length grows with the cluster; who does not
    read it does not pay for it, and ``cluster_links`` has them as rows.
    """
    linked = F.when(_link(clustered).isNotNull(), F.struct(F.col("ad_rank").alias("at"), _link(clustered).alias("link")))
    labelled = clustered.withColumns({"label": extract.furnishing_label(F.col("furnished")), "_linked": linked})
    per_label = labelled.groupBy("cluster_id", "label").agg(
        F.min("ad_rank").alias("at"), F.count("*").alias("n"), F.collect_list("_linked").alias("_linked"))
    # at most five rows per cluster: four labels and none
    entry = F.when(F.col("label").isNotNull(), F.struct("at", "label"))
    cell = F.array_join(F.transform(
        F.array_sort(F.collect_list(entry)), lambda x: x["label"]), " / ")
    links = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("_linked"))), lambda x: x["link"]), ", ")
    return per_label.groupBy("cluster_id").agg(
        F.sum("n").alias("n_ads"), links.alias("links"),
        F.coalesce(F.nullif(cell, F.lit("")), F.lit("?")).alias("furnishing"))


def shortlist(summary: DataFrame, limit_low: int) -> DataFrame:
    """All clusters of the upper tiers and the best ``limit_low`` of the last one.

    The cut is a top-k over the last tier alone, so no tier is gathered whole.
    """
    low = F.col("priority") == "Low"
    best = summary.where(low).orderBy("ad_rank").limit(limit_low)
    return summary.where(~low).unionByName(best)


def more_than_shown(summary: DataFrame, limit_low: int) -> DataFrame:
    """Per tier: how many clusters there are, are shown and are left out."""
    shown = F.when(F.col("priority") == "Low", F.least("total", F.lit(limit_low))).otherwise(
        F.col("total"))
    return (summary.groupBy("priority").agg(F.count("*").alias("total"))
            .withColumn("shown", shown.cast("bigint"))
            .withColumn("more", F.col("total") - F.col("shown")))


# --- buildings ---------------------------------------------------------------

def building_counts(tracker: DataFrame) -> DataFrame:
    """Live ads per address and stated outcode."""
    live = with_address(tracker.where(rules.is_live(F.col("status"))))
    return (live.where(F.col("addr_key") != "").groupBy("addr_key", "outcode")
            .agg(F.count("*").alias("n")))


def units_in_building(rows: DataFrame, buildings: DataFrame) -> DataFrame:
    """Adds ``units``: live ads at the address under the row's outcode.

    An ad without an outcode counts toward every block at its address, and
    itself joins the largest of them.
    """
    stated = buildings.where("outcode IS NOT NULL").select("addr_key", "outcode", "n")
    per_address = buildings.groupBy("addr_key").agg(
        F.coalesce(F.max(F.when(F.col("outcode").isNull(), F.col("n"))), F.lit(0)).alias("_loose"),
        F.coalesce(F.max(F.when(F.col("outcode").isNotNull(), F.col("n"))),
                   F.lit(0)).alias("_largest"))
    out = rows if "addr_key" in rows.columns else with_address(rows)
    out = (out.join(per_address, "addr_key", "left")
           .join(stated.withColumnRenamed("n", "_own"), ["addr_key", "outcode"], "left"))
    own = F.when(F.col("outcode").isNull(), F.col("_largest")).otherwise(
        F.coalesce("_own", F.lit(0)))
    return out.withColumn(
        "units", F.coalesce(F.col("_loose") + own, F.lit(0))).drop("_loose", "_largest", "_own")
