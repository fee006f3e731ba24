"""Secret scans with corpus-wide ownership frequency.

Every candidate is hashed and counted over the whole corpus by distinct repositories and
owners. A value that many owners hold is a widely copied example; a value of few owners
that looks random is a live credential of theirs. The scan of the method adds two kinds to
the base ones: `pem` (a private key block) and `loose` (a long mixed token standing alone,
kept only if it belongs to few owners). Base spans are always returned.

Null counts as empty; texts without a match give counts of 0 and empty spans. Positions
are code points, end exclusive, of the whole match. Ids may be null or repeated: every row
has the spans of its own text. A null owner is one owner; an empty table gives no rows; other
columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import arrow_map, sieve_split, slices, staged

# fixed values: what the base scan looks for
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# what the method adds
PEM = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----")
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
KINDS = ("assign", "access", "hex", "pem", "loose")
HINT = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk]")

FOUND = "kind int, start long, stop long, value string"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind number, start, stop, value) of the base scan."""
    found = []
    if HINT.search(text):
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return found


def _mixed(value: str) -> bool:
    """Letters of both cases and digits, in no long run of one character."""
    return (bool(re.search("[a-z]", value) and re.search("[A-Z]", value)) and sum(map(str.isdigit, value)) >= 3
            and len(set(value)) >= 12)


def all_spans(text: str) -> list[tuple[int, int, int, str]]:
    """The base spans, and the method's candidates outside of them."""
    found = base_spans(text)
    if "PRIVATE KEY-----" in text:
        found += [(3, m.start(), m.end(), m[0]) for m in PEM.finditer(text)]
    taken = [(a, b) for _, a, b, _ in found]
    # a token holds no white space, so it lies in a word at least as long
    if max(map(len, text.split()), default=0) >= 24:
        found += [(4, m.start(), m.end(), m[0]) for m in LOOSE.finditer(text)
                  if _mixed(m[0]) and not any(a < m.end() and m.start() < b for a, b in taken)]
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str | None = None) -> DataFrame:
    """id, owner, repo, text_hash and the candidates `found` (kind, start, stop, value hash) of every row.

    Without a repository column the owner stands for it. A null owner is one owner.
    """
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        for part in slices(batches, 4, 8 << 20):
            rows = []
            for t in part.column(4).to_pylist():
                rows.append([{"kind": k, "start": a, "stop": b, "value": hashlib.sha256(v.encode()).hexdigest()}
                             for k, a, b, v in all_spans(t or "")])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:4], pa.array(rows, pa.list_(pa.struct(
                    [("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string())])))],
                ["id", "owner", "repo", "text_hash", "found"])

    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = owner if repo_col is None else F.coalesce(F.col(repo_col).cast("string"), F.lit(""))
    return arrow_map(df.select(F.col(id_col).alias("id"), owner.alias("owner"), repo.alias("repo"),
                               _text_hash(text_col).alias("text_hash"), F.col(text_col).alias("t")), run,
                     f"id {id_type}, owner string, repo string, text_hash string, "
                     f"found array<struct<{FOUND.replace(' ', ':').replace(',:', ', ')}>>")


def _text_hash(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def ownership(scanned: DataFrame, max_owners: int = 3) -> DataFrame:
    """value, owners, repos, holders, live: how many hold each candidate hash.

    Two sums one after the other, (value, repo, owner) then value, so that a value in a
    third of all rows is added up before any shuffle.
    """
    each = scanned.select(F.explode("found").alias("f"), "owner", "repo").select("f.value", "owner", "repo")
    return (each.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
            .groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"),
                                  F.sum("n").alias("holders"))
            .withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_owners)))


def judged_spans(scanned: DataFrame, key: str, max_owners: int = 3) -> DataFrame:
    """key, kind, start, stop, live: one row per span that is returned, with the key of its row.

    A loose token stays only if it is live; the other kinds always stay.
    """
    each = scanned.select(key, F.explode("found").alias("f")).select(key, "f.*")
    return (each.join(ownership(scanned, max_owners), "value")
            .where((F.col("kind") != 4) | F.col("live")).select(key, "kind", "start", "stop", "live"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str | None = None, max_owners: int = 3) -> DataFrame:
    """One row per document with its spans and how many of them are live.

    Every row keeps the spans of its own text: ids may be null or repeated, with equal or
    other texts. Texts are read once; spans meet only the verdicts on their values.
    """
    numbered = scan(df, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id())
    scanned = staged(numbered, "secrets")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    one = F.struct("start", "kind", "stop", F.concat_ws(":", name, F.col("start"), F.col("stop")).alias("s"), "live")
    rolled = (judged_spans(scanned.where("size(found) > 0"), "row", max_owners).withColumn("one", one)
              .groupBy("row").agg(F.sort_array(F.collect_list("one")).alias("all")))
    base = F.filter("all", lambda x: x["kind"] < 3)
    count = lambda k: F.coalesce(F.size(F.filter("all", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    text = lambda xs: F.coalesce(F.array_join(F.transform(xs, lambda x: x["s"]), ","), F.lit(""))
    joined = scanned.select("id", "row").join(rolled, "row", "left")
    joined = joined.withColumn("all", F.coalesce("all", F.array().cast(rolled.schema["all"].dataType)))
    return joined.select(F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                         F.sha2(text(base), 256).alias("base_sha256"), text(F.col("all")).alias("spans"),
                         F.size(F.filter("all", lambda x: x["live"])).cast("long").alias("n_live"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
           repo_col: str | None = None, max_owners: int = 3, mark: str = "[SECRET]") -> DataFrame:
    """df with each live span replaced by `mark`; n_chars, where there is one, follows the text.

    Widely copied examples stay. Spans belong to a text and find it by its hash, whatever the
    row's id. Only rows that may hold a live span are shuffled.
    """
    key, live_spans = (_free(name, df) for name in ("text_hash", "live_spans"))
    scanned = staged(scan(df, id_col, text_col, owner_col, repo_col).where("size(found) > 0"), "secrets")
    live = staged(judged_spans(scanned, "text_hash", max_owners).where("live").groupBy("text_hash")
                  .agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias(live_spans))
                  .withColumnRenamed("text_hash", key), "live")
    maybe, clear = sieve_split(df.withColumn(key, _text_hash(text_col)), live.select(key), key)

    @F.pandas_udf("string")
    def masked(texts, spans):
        return texts.combine(spans, lambda t, s: t if s is None or t is None else _mask(t, s, mark))

    untouched = F.col(live_spans).isNull()
    hit = (maybe.join(live, key, "left")
           .withColumn(text_col, F.when(untouched, F.col(text_col)).otherwise(masked(text_col, live_spans))))
    if "n_chars" in df.columns:
        hit = hit.withColumn("n_chars", F.when(untouched, F.col("n_chars"))
                             .otherwise(F.length(text_col).cast(df.schema["n_chars"].dataType)))
    return clear.select(*df.columns).unionByName(hit.select(*df.columns))


def _free(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def _mask(text: str, spans, mark: str) -> str:
    out, at = [], 0
    for s in spans:
        start, stop = s["start"], s["stop"]
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join(out) + text[at:]
