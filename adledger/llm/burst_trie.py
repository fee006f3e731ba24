"""A trie of conversation prefixes, built as burst tries.

A turn's id is 128 bits of the SHA-256 of its role and text. Conversations of equal turn ids are
taken as one sequence with a count. All sequences start in one container under the root. A
container that holds more than `burst` turns bursts: its next turn ids become trie heads, each
with a container of the suffixes behind it. What is left are small containers (or single
sequences). They are dealt to shards by head, and a shard sorts one container at a time and
sweeps the sorted suffixes into nodes: a stack holds the nodes of the current path, and a node is
complete once the next suffix leaves it. Totals of containers are added to the heads above them.

A single sequence that occurs once needs no sweep: its nodes are a chain and stay rows of Spark.
Rounds grow with the depth to which more than `burst` turns share a prefix. Memory in a task is
one container, at most `burst` turns or one sequence.

Rows are ordered by turn (null first), rows of one turn by role and turn id; null roles and texts
count as empty; rows of a null id take no part, since their ids have no decimal; repeated rows are
turns of their own; other columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adledger.llm.common import arrow_map, staged

BURST = 50_000
ROOT = bytes(16)
NODE = ("head binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends long")


def _short(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv, pos (from 1), tid, size: the turns of each conversation in order, without their texts.

    Positions come from a range sort and the counts of its parts, so one huge conversation is
    dealt over many tasks like many small ones.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    tid = _short(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = (df.where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("conv"), "turn", role.alias("role"), tid.alias("tid"),
                    F.octet_length(text).cast("long").alias("size")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tid")]
    parts = staged(rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "turns")
    counts = parts.groupBy("conv", "part").agg(F.count("*").alias("n"))
    # few rows: a conversation has one for each part of the sort it reaches into
    ahead = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n"))
    local = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    return (parts.withColumn("local", local).join(ahead.where("ahead > 0").drop("n"), ["conv", "part"], "left")
            .select("conv", (F.col("local") + F.coalesce("ahead", F.lit(0))).alias("pos"), "tid", "size"))


def grafted(rows: DataFrame, group: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share a start: (rows, ids) where c begins with the first h turns of c - c % group.

    h is the checksum of c modulo `modulus`; c's own turns after its first h follow. Rows are those of `turns`.
    """
    def shared(conv: Column) -> Column:
        return F.crc32(conv.cast("string")) % modulus

    conv = F.col("conv")
    ids = rows.select("conv").distinct()
    base = rows.where((F.col("pos") < modulus) & (conv % group == 0))
    others = F.when(conv > 0, F.sequence(conv, conv + group - 1)).when(
        conv < 0, F.sequence(conv - group + 1, conv)).otherwise(F.sequence(conv - group + 1, conv + group - 1))
    heads = (base.withColumn("conv", F.explode(others)).where(F.col("pos") <= shared(conv))
             .join(ids, "conv", "left_semi").withColumn("own", F.lit(False)))
    tails = rows.where(F.col("pos") > shared(conv)).withColumn("own", F.lit(True))
    lengths = heads.groupBy("conv").agg(F.count("*").alias("taken"))
    tails = (tails.join(lengths, "conv", "left")
             .withColumn("pos", F.col("pos") - shared(conv) + F.coalesce("taken", F.lit(0))))
    return heads.select(*rows.columns).unionByName(tails.select(*rows.columns)), ids


def _sequences(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences: seq, convs, length; members: seq, conv). A sequence is named by its smallest conversation."""
    # sums of hashes of (position, id) do not depend on order, so they add up before the shuffle
    def total(seed: int) -> Column:
        return F.sum(F.xxhash64("pos", "tid", F.lit(seed)).cast("decimal(20,0)"))

    marks = rows.groupBy("conv").agg(F.count("*").alias("length"), total(1).alias("m1"), total(2).alias("m2"))
    marks = ids.join(marks, "conv", "left").select("conv", F.coalesce("length", F.lit(0)).alias("length"),
                                                   *[F.coalesce(c, F.lit(0)).alias(c) for c in ("m1", "m2")])
    marks = staged(marks, "marks")
    same = ["length", "m1", "m2"]
    found = staged(marks.groupBy(*same).agg(F.min("conv").alias("seq"), F.count("*").alias("convs")), "sequences")
    return found.select("seq", "convs", "length"), marks.join(found, same).select("seq", "conv")


def _ends(members: DataFrame) -> DataFrame:
    """seq, ends_sha256: the hash of the ids of its conversations in order, read as a sorted stream."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, digest, out = None, None, ([], [])
        for batch in batches:
            for s, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != seq:
                    if digest:
                        out[0].append(seq)
                        out[1].append(digest.hexdigest())
                    seq, digest = s, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["seq", "ends_sha256"])
            out = ([], [])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([digest.hexdigest()])], ["seq", "ends_sha256"])

    alone = members.groupBy("seq").agg(F.count("*").alias("n"))
    many = members.join(alone.where("n > 1"), "seq", "left_semi").repartition("seq").sortWithinPartitions("seq", "conv")
    single = alone.where("n = 1").select("seq", F.sha2(F.col("seq").cast("string"), 256).alias("ends_sha256"))
    return single.unionByName(arrow_map(many.select("seq", "conv"), run, "seq long, ends_sha256 string"))


def sweep(suffixes: list[tuple[list[bytes], list[int], int, int]], depth: int) -> Iterator[tuple]:
    """Nodes of one container: suffixes are (turn ids, sizes, sequence, conversations), depth is the head's.

    Yields (depth, least conversation, parent's or None under the head, conversations, children, leaves,
    saved, sequence that ends there or None). Suffixes that are empty end at the head and are not given.
    """
    class Node:
        __slots__ = ("size", "conv", "convs", "children", "leaves", "saved", "ends", "waiting")

        def __init__(self, size):
            self.size, self.conv, self.convs, self.children, self.leaves, self.saved = size, None, 0, 0, 0, 0
            self.ends, self.waiting = None, []

    path: list[Node] = []
    last: list[bytes] = []

    def close(to: int):
        while len(path) > to:
            node = path.pop()
            node.leaves = node.leaves or 1
            node.saved += (node.convs - 1) * node.size
            for row in node.waiting:  # children learn their parent's name once it is known
                yield row[0], row[1], node.conv, *row[2:]
            row = (depth + len(path) + 1, node.conv, node.convs, node.children, node.leaves, node.saved, node.ends)
            if path:
                up = path[-1]
                up.children += 1
                up.leaves += node.leaves
                up.saved += node.saved
                up.waiting.append(row)
            else:
                yield row[0], row[1], None, *row[2:]

    for ids, sizes, seq, convs in sorted(suffixes):
        common = 0
        while common < min(len(ids), len(last)) and ids[common] == last[common]:
            common += 1
        yield from close(common)
        for i in range(common, len(ids)):
            path.append(Node(sizes[i]))
        for node in path:
            node.conv = seq if node.conv is None else min(node.conv, seq)
            node.convs += convs
        path[-1].ends = seq
        last = ids
    yield from close(0)


def _swept(rows: DataFrame) -> DataFrame:
    """Nodes of all containers; rows: head, depth, seq, convs, pos, tid, size."""
    names = [c.split()[0] for c in NODE.split(", ")]
    types = [pa.binary(), *[pa.int64()] * 8]

    def run(batches):
        head, depth, container = None, 0, {}

        def nodes():
            done = list(sweep(list(container.values()), depth))
            container.clear()
            return [(head, d, conv, up, n, kids, leaves, saved, ends) for d, conv, up, n, kids, leaves, saved, ends in done]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            out = []
            for h, d, seq, convs, _, tid, size in zip(*(b.column(i).to_pylist() for i in range(7))):
                if h != head:
                    if container:
                        out += nodes()
                    head, depth = h, d
                entry = container.setdefault(seq, ([], [], seq, convs))
                entry[0].append(tid)
                entry[1].append(size)
            if out:
                yield batch(out)
        if container:
            yield batch(nodes())

    dealt = rows.repartition("head").sortWithinPartitions("head", "seq", "pos")
    return arrow_map(dealt.select("head", "depth", "seq", "convs", "pos", "tid", "size"), run, NODE)


def trie(rows: DataFrame, ids: DataFrame, burst: int = BURST) -> DataFrame:
    """The nodes of all prefixes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows are those of `turns`; ids (conv) names every conversation, those without turns too.
    """
    rows = staged(rows, "rows")
    sequences, members = _sequences(rows, ids)
    # the turns of each sequence once, that is those of its smallest conversation
    rows = staged(rows.join(sequences.where("length > 0"), F.col("conv") == F.col("seq"), "left_semi")
                  .withColumnRenamed("conv", "seq"), "suffixes")
    at = sequences.select("seq", "convs", "length", F.lit(ROOT).alias("head"))
    heads, settled, depth = [], [], 0
    head = at.groupBy("head").agg(F.min("seq").alias("conv_id"), F.sum("convs").alias("n_convs"), F.sum("length").alias("turns"),
                                  F.count("*").alias("seqs"), F.max(F.when(F.col("length") == 0, F.col("seq"))).alias("ends"))
    head = staged(head.withColumns({"parent": F.lit(None).cast("binary"), "parent_conv_id": F.lit(None).cast("long"),
                                    "size": F.lit(0).cast("long"), "above": F.array(F.col("head"))}), "heads")
    while True:
        heads.append(head.withColumn("depth", F.lit(depth).cast("long")))
        large = head.where((F.col("turns") > burst) & (F.col("seqs") > 1))
        small = at.join(head.where((F.col("turns") > 0) & ~((F.col("turns") > burst) & (F.col("seqs") > 1)))
                        .select("head", "seqs"), "head")
        settled.append(small.withColumn("depth", F.lit(depth).cast("long")))
        if large.isEmpty():
            break
        depth += 1
        step = rows.where(F.col("pos") == depth).select("seq", "tid", "size")
        going = (at.join(large.select("head"), "head", "left_semi").join(step, "seq")
                 .select("seq", "convs", "length", F.col("head").alias("parent"), "size",
                         F.unhex(F.substring(F.sha2(F.concat("head", "tid"), 256), 1, 32)).alias("head")))
        at = staged(going, "at")
        counted = at.groupBy("head", "parent").agg(
            F.min("seq").alias("conv_id"), F.sum("convs").alias("n_convs"), F.sum(F.col("length") - depth).alias("turns"),
            F.count("*").alias("seqs"), F.max(F.when(F.col("length") == depth, F.col("seq"))).alias("ends"), F.max("size").alias("size"))
        up = large.select(F.col("head").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "above")
        head = staged(counted.join(up, "parent").withColumn("above", F.concat("above", F.array("head"))), "heads")
        at = at.drop("parent", "size")
    return _nodes(rows, _union(heads), _union(settled), _ends(members))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _nodes(rows: DataFrame, heads: DataFrame, settled: DataFrame, ends: DataFrame) -> DataFrame:
    suffixes = (settled.join(rows, "seq").where(F.col("pos") > F.col("depth"))
                .select("head", "depth", "seq", "convs", "length", "seqs", "pos", "tid", "size"))
    lone = (F.col("seqs") == 1) & (F.col("convs") == 1)
    chain = suffixes.where(lone).select(
        "head", F.col("pos").alias("depth"), F.col("seq").alias("conv_id"),
        F.when(F.col("pos") > F.col("depth") + 1, F.col("seq")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (F.col("pos") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("pos") == F.col("length"), F.col("seq")).alias("ends"))
    inner = staged(chain.unionByName(_swept(suffixes.where(~lone))), "nodes")
    # what hangs under a head: its containers' top nodes (their totals reach every head above) and lower heads
    tops = inner.where("parent_conv_id IS NULL").groupBy("head").agg(
        F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    lower = heads.where("parent IS NOT NULL").groupBy(F.col("parent").alias("head")).agg(F.count("*").alias("heads_under"))
    own = heads.join(tops, "head", "left").join(lower, "head", "left").na.fill(0, ["kids", "leaves", "saved", "heads_under"])
    own = own.withColumn("n_children", F.col("kids") + F.col("heads_under"))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves"))
    sums = own.select(F.explode("above").alias("head"), leaf.alias("leaves"),
                      (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved")).groupBy("head").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    upper = own.drop("leaves", "saved").join(sums, "head").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
    named = heads.select("head", F.col("conv_id").alias("head_conv"))
    below = inner.join(named, "head").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "head_conv"))
    return (below.select(*upper.columns).unionByName(upper)
            .join(ends, F.col("ends") == F.col("seq"), "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).drop("ends", "seq"))


def prefix_trie(df: DataFrame, id_col: str = "conv_id", **options) -> DataFrame:
    """The trie of the conversations as they are."""
    rows = turns(df, id_col)
    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv")).distinct()
    return trie(rows, ids, **options)


def grafted_trie(df: DataFrame, id_col: str = "conv_id", **options) -> DataFrame:
    """The trie of the conversations with shared starts (see `grafted`)."""
    rows, ids = grafted(staged(turns(df, id_col), "turns"))
    return trie(rows, ids, **options)
