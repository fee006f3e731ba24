"""Vocabulary scan and the slices of text around each hit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger import fixed


def terms_in(low: Column, terms) -> Column:
    """The terms that occur in a lower-cased text, in list order."""
    return F.array_compact(F.array(
        *[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]))


def term_scan(df: DataFrame, text: str = "text", terms=fixed.TERMS,
              decoys=fixed.DECOYS) -> DataFrame:
    """Adds ``terms`` and ``decoys`` found in each text."""
    return (df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
            .withColumn("terms", terms_in(F.col("_low"), terms))
            .withColumn("decoys", terms_in(F.col("_low"), decoys))
            .drop("_low"))


def context_windows(df: DataFrame, text: str = "text", terms=fixed.TERMS,
                    pad: int = fixed.WINDOW_PAD, gap: str = fixed.WINDOW_GAP,
                    out: str = "windows") -> DataFrame:
    """Adds verbatim slices of ``pad`` characters round every term occurrence.

    Touching slices merge; a text without a hit is kept whole. Every step is
    an expression on the row, so nothing is shuffled and no text is copied out
    into one row per hit. The look-ahead split cuts where any term begins, also
    where occurrences overlap; the longest term at a position sets its end.
    """
    longest_first = sorted(set(terms), key=lambda t: (-len(t), t))
    alternation = "|".join(re.escape(t) for t in longest_first)
    c = F.col(text)
    span = "struct<a:int,b:int>"

    def slot(a, b):
        return F.struct(a.alias("a"), b.alias("b")).cast(span)

    base = (df.withColumn("_low", F.lower(F.coalesce(c, F.lit(""))))
            .withColumn("_hits", F.transform(
                F.regexp_extract_all("_low", F.lit(f"(?=({alternation}))"), F.lit(1)), F.length))
            .withColumn("_pieces", F.when(F.size("_hits") > 0, F.transform(
                F.split("_low", f"(?={alternation})"), F.length)))
            .withColumn("_lead", F.when(F.size("_pieces") > F.size("_hits"),
                                        F.get("_pieces", F.lit(0))).otherwise(0))
            .withColumn("_steps", F.arrays_zip(
                F.when(F.size("_pieces") > F.size("_hits"),
                       F.slice("_pieces", 2, F.size("_hits") + 1))
                .otherwise(F.col("_pieces")).alias("piece"),
                F.col("_hits").alias("hit"))))

    start = F.struct(
        F.col("_lead").alias("pos"), slot(F.lit(None), F.lit(None)).alias("cur"),
        F.array().cast(f"array<{span}>").alias("done"))

    def step(acc, x):
        a = F.greatest(acc["pos"] - pad, F.lit(0))
        b = F.least(acc["pos"] + x["hit"] + pad, F.length("_low"))
        joins = a <= acc["cur"]["b"]
        cur = F.when(joins, slot(acc["cur"]["a"], F.greatest(acc["cur"]["b"], b))).otherwise(
            slot(a, b))
        done = F.when(joins | acc["cur"]["a"].isNull(), acc["done"]).otherwise(
            F.concat(acc["done"], F.array(acc["cur"])))
        return F.struct((acc["pos"] + x["piece"]).alias("pos"), cur.alias("cur"),
                        done.alias("done"))

    spans = F.aggregate("_steps", start, step,
                        lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    return (base.withColumn("_spans", spans)
            .withColumn(out, F.when(F.size("_hits") == 0, c).otherwise(F.array_join(
                F.transform("_spans", lambda s: c.substr(s["a"] + 1, s["b"] - s["a"])), gap)))
            .drop("_low", "_hits", "_pieces", "_lead", "_steps", "_spans"))
