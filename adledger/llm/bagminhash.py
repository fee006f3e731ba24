"""MinHash near-dedup with BagMinHash signatures of weighted five-word shingles.

A document is the multiset of its five-word shingles (words split at white space, lower
case; a shorter text is one shingle). For each shingle the weight axis is cut into dyadic
blocks [0,1), [1,2), [2,4), ...; each block is a Poisson process over time with a rate in
proportion to its length, whose points have a register and a position on the weight axis.
A point counts if its position is below the shingle's weight. A register keeps its first
time; points later than the last register's time are never made. Registers of two
documents agree with probability equal to their weighted Jaccard similarity.

Signatures are banded. Documents of equal words are one node. In the buckets of the first bands
each node is compared with the bucket's smallest; then, in rounds over all bands, nodes outside
of the bucket's main component with a few of that component, chosen by hash; at last those that are
still outside with all nodes of other components in the bucket. So no link between components
is left out, while a large group of near copies costs a few comparisons for each member.
Every comparison that counts is the exact weighted Jaccard similarity.

Texts without a word (null, empty, blank) are copies of each other and near nothing else.
Ids may repeat or be null; rows of equal words share the class of the smallest id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adledger.llm.common import arrow_map, slices, sieve_split, staged, without
from adledger.llm.components import components, merged

WORDS = 5
BANDS, ROWS = 25, 5
SLICE = 1 << 20  # bytes of text hashed at once; arrays take some 100 times that
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
U = np.uint64
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = U(pow(int(BASE), -1, 1 << 64))
        _POWERS[size] = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, p, U)])) for p in (BASE, inverse))
    return _POWERS[size]


def bags(texts: list[str | None], words: int = WORDS):
    """(doc, shingle hash of 48 bits, weight), by doc and hash, and the joined words of each text."""
    clean = [" ".join((t or "").lower().split()) for t in texts]
    data = np.frombuffer("\n".join(clean).encode() + b"\n", np.uint8)
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * power[:len(data)])])
    breaks = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate([[0], breaks[:-1] + 1])
    doc = np.cumsum(data[breaks] == 10) - (data[breaks] == 10)
    real = breaks > starts
    starts, stops, doc = starts[real], breaks[real], doc[real]
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), clean
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    n = np.diff(np.concatenate([np.flatnonzero(first), [len(doc)]]))
    last = np.repeat(np.cumsum(n) - 1, n)
    at = np.arange(len(doc))
    begins = first | (at + words - 1 <= last)
    end = stops[np.minimum(at + words - 1, last)][begins]
    start, doc = starts[begins], doc[begins]
    hashes = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))
    key = np.sort(doc.astype(U) << U(48) | hashes >> U(16))
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.diff(np.concatenate([head, [len(key)]]))
    key = key[head]
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1), weight, clean


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Register times of each document, shape (docs, m); infinite where a document is empty."""
    top = int(weight.max()).bit_length() if len(weight) else 0
    who, seed, length, cover = [doc], [mix(element)], [np.ones(len(doc))], [np.ones(len(doc))]
    for j in range(1, top + 1):  # block [2^(j-1), 2^j)
        low = 1 << (j - 1)
        in_it = weight > low
        who.append(doc[in_it])
        seed.append(mix(element[in_it] + U(j * int(BASE) & MASK)))
        length.append(np.full(in_it.sum(), float(low)))
        cover.append(np.minimum(weight[in_it] - low, low).astype(float))
    who, seed, length, cover = map(np.concatenate, (who, seed, length, cover))
    registers = np.full(docs * m, np.inf)
    latest = np.full(docs, np.inf)
    time, k = np.zeros(len(who)), 0
    while len(who):
        k += 1
        r = mix(seed + U(k * int(BASE) & MASK))
        time = time - np.log(((r >> U(11)).astype(float) + 0.5) / (1 << 53)) / (m * length)
        r = mix(r)
        alive = time < latest[who]
        counts = alive & ((r >> U(32)).astype(float) * (length / 2**32) < cover)
        slot = who[counts] * m + (r[counts] & U(0xFFFFFFFF)).astype(np.int64) * m // (1 << 32)
        np.minimum.at(registers, slot, time[counts])
        touched = np.unique(who[alive])
        latest[touched] = registers.reshape(docs, m)[touched].max(axis=1)
        alive &= time < latest[who]
        who, seed, length, cover, time = (x[alive] for x in (who, seed, length, cover, time))
    return registers.reshape(docs, m)


def band_hashes(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = mix(registers.view(U)).reshape(len(registers), bands, rows)
    total = np.zeros(bits.shape[:2], U)
    for i in range(rows):
        total = mix(total * BASE + bits[:, :, i])
    return mix(total + np.arange(bands, dtype=U) * BASE).view(np.int64)


def _signed(df: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """id, key of the words, shingles, bands, sig (16 bits a register)."""
    m = bands * rows

    def run(batches):
        for part in slices(batches, 1, SLICE):
            texts = part.column(1).to_pylist()
            doc, element, weight, clean = bags(texts, words)
            docs = len(texts)
            registers = signatures(doc, element, weight, docs, m)
            n = np.bincount(doc, weight, docs).astype(np.int64)
            hashes = band_hashes(registers, bands, rows)
            short = (mix(registers.view(U)) >> U(48)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([hashlib.blake2b(c.encode(), digest_size=16).digest() for c in clean], pa.binary()),
                pa.array(n), pa.array([h.tolist() if k else [] for h, k in zip(hashes, n)], pa.list_(pa.int64())),
                pa.array([s.tobytes() for s in short], pa.binary())], ["id", "key", "n", "bands", "sig"])

    kind = df.schema["id"].dataType.simpleString()
    return arrow_map(df, run, f"id {kind}, key binary, n long, bands array<long>, sig binary")


def _bag_rows(df: DataFrame, words: int) -> DataFrame:
    """rep, bag: the sorted 32-bit shingle hashes of a document, each as often as it occurs."""
    def run(batches):
        for part in slices(batches, 1, SLICE):
            doc, element, weight, _ = bags(part.column(1).to_pylist(), words)
            cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
            out = [np.repeat((element[a:b] >> U(16)).astype(np.uint32), weight[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["rep", "bag"])

    return arrow_map(df, run, f"rep {df.schema['id'].dataType.simpleString()}, bag binary")


def bag_similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two sorted bags."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)

    def ranked(v):
        head = np.concatenate([[True], v[1:] != v[:-1]])
        at = np.arange(len(v))
        return v.astype(U) << U(32) | (at - np.maximum.accumulate(np.where(head, at, 0))).astype(U)

    if not len(x) or not len(y):
        return 0.0
    both = np.sort(np.concatenate([ranked(x), ranked(y)]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(x) + len(y) - shared)


def _verified(pairs: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) whose bags are similar enough, with the similarity."""
    both = (pairs.join(bag.withColumnsRenamed({"rep": "a", "bag": "bag_a"}), "a")
            .join(bag.withColumnsRenamed({"rep": "b", "bag": "bag_b"}), "b").select("a", "b", "bag_a", "bag_b"))

    def run(batches):
        for part in batches:
            s = [bag_similarity(x, y) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(s, pa.float64())], ["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType.simpleString()
    return arrow_map(both, run, f"a {kind}, b {kind}, similarity double").where(F.col("similarity") >= threshold)


def _across(apart: DataFrame, nodes: DataFrame, bag: DataFrame, threshold: float, block_bytes: int = 16 << 20) -> DataFrame:
    """Links (a, b, similarity) between nodes of a bucket that are in different components.

    A bucket with nodes outside of its main component is cut into blocks of about `block_bytes`
    of bags and signatures by hash. A node of the main component goes to its own block alone,
    the others to all blocks of the bucket, and only they are compared: with the main nodes of
    the block, and each pair of them in the own block of its smaller id. So rows grow with the
    bucket, not with its square, up to a block, and main nodes never meet each other. Two nodes
    meet in the first bucket they share. A comparison is left out if the two components are
    already known to be linked, or if the signatures agree in fewer registers than any pair of
    the threshold's similarity would, but for one in ten million.
    """
    apart = apart.withColumn("minor", F.col("comp") != F.col("main"))
    held = F.sum(4 * F.col("n") + 1000)  # a bag, a signature, bands and their overhead
    sized = (apart.groupBy("band").agg(F.ceil(held / block_bytes).cast("int").alias("blocks"), F.bool_or("minor").alias("any"))
             .where("any").drop("any"))
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = (apart.join(sized, "band").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("block", F.explode(F.when(F.col("minor"), everywhere).otherwise(F.array("own"))))
             .select("band", "block", "own", "minor", "rep", "n", "comp"))
    full = dealt.join(nodes, "rep").join(bag, "rep")
    kind = apart.schema["rep"].dataType.simpleString()
    least = threshold - 0.2

    def run(group: pd.DataFrame) -> pd.DataFrame:
        band, block = group["band"].iloc[0], group["block"].iloc[0]
        group = group.sort_values("rep", ignore_index=True)
        rep, comp, bag_of = group["rep"].tolist(), pd.factorize(group["comp"])[0], group["bag"].tolist()
        n, own, minor = group["n"].to_numpy(), group["own"].to_numpy(), group["minor"].to_numpy(dtype=bool)
        bands, sig = np.stack(group["bands"].to_numpy()), np.stack([np.frombuffer(x, np.uint16) for x in group["sig"]])
        at = np.flatnonzero(bands[0] == band)[0]
        top = list(range(int(comp.max()) + 1))

        def root(c):
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        out, place = [], np.arange(len(rep))
        for x in np.flatnonzero(minor).tolist():
            y = np.flatnonzero((~minor | ((place > x) & (own[x] == block))) & (comp != comp[x])
                               & (np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x])))
            y = y[(sig[y] == sig[x]).mean(axis=1) >= least]
            y = y[~(bands[y, :at] == bands[x, :at]).any(axis=1)]
            for k in y.tolist():
                if (p := root(comp[x])) != (q := root(comp[k])) and (s := bag_similarity(bag_of[x], bag_of[k])) >= threshold:
                    top[p] = q
                    out.append((rep[x], rep[k], s))
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    return full.groupBy("band", "block").applyInPandas(run, f"a {kind}, b {kind}, similarity double")


def _apart(members: DataFrame, comp: DataFrame) -> DataFrame:
    """band, rep, n, comp of the members of buckets, and the bucket's most frequent component as main."""
    placed = (members.select("band", "rep", "n").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
              .withColumn("comp", F.coalesce("comp", "rep")))
    main = (placed.groupBy("band", "comp").agg(F.count("*").alias("c"))
            .groupBy("band").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k"))
            .where("k > 1").select("band", "main"))
    return placed.join(main, "band")


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                 bands: int = BANDS, rows: int = ROWS, words: int = WORDS, rounds: int = 2, delegates: int = 4,
                 first: int = 5) -> DataFrame:
    """One row per row of df: id, class_id (the smallest id of its class), rep (the smallest id of equal words), links.

    links counts the verified partners of the row's words that were compared.
    With 25 bands of 5 a pair of similarity 0.8 is found with probability 0.99995.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    signed = staged(_signed(docs, bands, rows, words), "signatures")
    reps = staged(signed.groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"),
                                            F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    slots = reps.where("rep IS NOT NULL").select(F.posexplode("bands").alias("at", "band"), "rep", "n")
    crowded = slots.groupBy("band").agg(F.count("*").alias("c"), F.min("rep").alias("low")).where("c > 1").drop("c")
    members = staged(slots.join(crowded, "band"), "members")
    # what the first bands link needs no comparison in the others
    pairs = staged(members.where(F.col("at") < first).select(F.col("low").alias("a"), F.col("rep").alias("b"))
                   .where("a < b").distinct(), "pairs")

    wanted = members.select(F.col("rep").alias("id")).distinct()
    maybe, _ = sieve_split(docs, wanted, "id")
    bag = staged(_bag_rows(maybe.join(wanted, "id", "left_semi").dropDuplicates(["id"]), words), "bags")
    links = staged(_verified(pairs, bag, threshold), "verified")
    comp = components(links)

    # nodes that share a bucket and are still apart: first with a few of the bucket's main component, then with all
    compared = pairs
    for r in range(rounds + 1):
        apart = staged(_apart(members, comp), "apart")
        minor = apart.where("comp <> main")
        if r == rounds or minor.isEmpty():
            break
        few = [F.min_by("rep", F.xxhash64("rep", F.lit(r * delegates + j))) for j in range(delegates)]
        chosen = apart.where("comp = main").groupBy("band").agg(F.array_distinct(F.array(*few)).alias("few"))
        # a node shares many buckets with one component; it is compared with a few of it, not with a few for each bucket
        fresh = staged(minor.join(chosen, "band").select(F.col("rep").alias("x"), "main", F.explode("few").alias("y"))
                       .groupBy("x", "main", "y").agg(F.count("*").alias("shared"))
                       .withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).join(compared, ["a", "b"], "left_anti")
                       .withColumn("k", F.row_number().over(Window.partitionBy("x", "main").orderBy(F.desc("shared"), F.xxhash64("y"), "y")))
                       .where(F.col("k") <= delegates).select("a", "b").distinct(), "pairs")
        compared = compared.union(fresh)
        found = staged(_verified(fresh, bag, threshold), "verified")
        links = links.union(found)
        comp = merged(comp, found)
    more = staged(_across(apart, reps.where("rep IS NOT NULL").select("rep", "bands", "sig"), bag, threshold), "verified")
    if not more.isEmpty():
        links = links.union(more)
        comp = merged(comp, more)

    counts = (links.select("a").union(links.select("b")).groupBy("a").agg(F.count("*").alias("links"))
              .withColumnRenamed("a", "rep"))
    node = (reps.select("key", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").join(counts, "rep", "left")
            .select("key", "rep", F.coalesce("comp", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")))
    return (signed.select("id", "key").join(node, "key")
            .select(F.col("id").alias(id_col), "class_id", "rep", "links"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df less those in a class with a smaller id: one document of each class stays."""
    classes = near_classes(df, id_col, text_col, **options)
    dropped = classes.where(F.col(id_col) > F.col("class_id")).select(id_col)
    return without(df, staged(dropped, "dropped"), id_col)
