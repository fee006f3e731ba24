"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Documents are cut into pieces of at most `capacity` characters. Pieces are dealt by hash to
packing shards of bounded size, so a hot source or a large group of copies is spread over
all of them, and each shard packs its pieces by falling size. Its open bins are kept in
order of residual space; each carries a bitmap of the sources it is full of and a bitmap of
the duplicate clusters it holds. From the smallest residual that holds a piece the search
goes on to its successors until a bin has no conflict: that is the tightest compatible one.

Rules: a bin holds no two documents of one duplicate cluster (equal texts, A-Z lower-cased)
and at most `max_per_source` pieces of one source. Null and empty texts take no space and
are one cluster; a null source is a source. Ties go to the smaller id and the older bin.
Equal rows are packed one by one, in different bins. The shard count grows with the input,
so the work of a shard does not.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adledger.llm.exact_dedup import normalised


class Bins:
    """The open bins of a shard, in order of residual space."""

    def __init__(self, capacity: int, max_per_source: int):
        self.capacity, self.limit = capacity, max_per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.full: list[int] = []  # bitmap of the sources a bin takes no more of
        self.clusters: list[int] = []  # bitmap of duplicate clusters
        self.held: list[dict[int, int]] = []  # pieces by source

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin that a piece goes to; cluster -1 conflicts with nothing."""
        mask = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            residual, b = self.order[at]
            if not (self.full[b] >> source & 1 or self.clusters[b] & mask):
                del self.order[at]
                break
            at += 1
        else:
            residual, b = self.capacity, len(self.full)
            self.full.append(0)
            self.clusters.append(0)
            self.held.append({})
        self.clusters[b] |= mask
        n = self.held[b][source] = self.held[b].get(source, 0) + 1
        if n >= self.limit:
            self.full[b] |= 1 << source
        insort(self.order, (residual - size, b))
        return b


def pack_shard(pieces: pd.DataFrame, capacity: int, max_per_source: int) -> pd.DataFrame:
    """pieces: id, piece, size, source, cluster. Adds bin, position and bin_used."""
    pieces = pieces.sort_values(["size", "id", "piece"], ascending=[False, True, True], kind="stable")
    sources = pd.factorize(pieces["source"])[0]
    # a cluster with one member here cannot conflict and needs no bit
    shared = pieces["cluster"].map(pieces["cluster"].value_counts()) > 1
    clusters = pd.factorize(pieces["cluster"].where(shared))[0]
    bins = Bins(capacity, max_per_source)
    placed = [bins.place(*x) for x in zip(pieces["size"].tolist(), sources.tolist(), clusters.tolist())]
    pieces = pieces.assign(bin=placed)
    by = pieces.groupby("bin")["size"]
    return pieces.assign(position=pieces.groupby("bin").cumcount(), bin_used=by.transform("sum"))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         capacity: int = 65_536, max_per_source: int = 16, shard_chars: int = 1 << 25,
         shard_rows: int = 16_384) -> DataFrame:
    """One row per piece: id, piece, start, stop (characters), bin_id, position, bin_used, source, cluster.

    Only ids, sizes and hashes are shuffled, never texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = (df.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("chars"),
                        F.coalesce(F.xxhash64(F.col(source_col)), F.lit(0)).alias("source"),
                        F.xxhash64(normalised(text)).alias("cluster"))
              .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(
                  F.lit(0), F.ceil(F.col("chars") / capacity) - 1).cast("long"))))
              .withColumn("start", F.col("piece") * capacity)
              .withColumn("stop", F.least("chars", F.col("start") + capacity))
              .withColumn("size", F.col("stop") - F.col("start")).drop("chars"))
    total = pieces.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total[0] // shard_chars), -(-total[1] // shard_rows))
    id_type = pieces.schema["id"].dataType.simpleString()

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(shard, capacity, max_per_source)
        out["bin_id"] = out["shard"].astype("int64") * 2**32 + out["bin"]
        return out[["id", "piece", "start", "stop", "bin_id", "position", "bin_used", "source", "cluster"]]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.lit(7)), F.lit(shards)).cast("int"))
    return (dealt.repartition(shards, "shard").groupBy("shard")
            .applyInPandas(run, f"id {id_type}, piece long, start long, stop long, bin_id long, position long, "
                                "bin_used long, source long, cluster long")
            .withColumnRenamed("id", id_col))
