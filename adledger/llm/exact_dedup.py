"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after lower-casing A-Z only; null counts as empty, so
null and empty texts are copies of each other. Of equal texts the largest id stays.
Equal rows (same id, same text) count one by one in group_size and all carry the id
that stays; a null id stays only where no copy has an id. Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import BITMAP_BITS, Sieve, without

SALTS = 32


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def full_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _prefix(text: Column, chars: int) -> Column:
    return F.xxhash64(normalised(F.substring(text, 1, chars)))


def copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = 64, bits: int = BITMAP_BITS) -> DataFrame:
    """Groups of two or more equal texts: text_sha256, keep_id, group_size.

    Lengths that occur once fall out first, then prefixes that occur once within a
    length. What survives is told to the last scan by a bitmap of 2**bits bits, so only
    surviving texts are hashed in full and no text is ever shuffled. A false hit of the
    bitmap costs one more hash and changes nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("t"), F.octet_length(text).alias("n"))
    lengths = docs.groupBy("n").count().where("count > 1").select("n")
    prefixes = (docs.select("n", _prefix(F.col("t"), prefix_chars).alias("p")).groupBy("n", "p").count()
                .where("count > 1").join(lengths, "n", "left_semi"))
    survivors = (Sieve(prefixes, "n", "p", bits=bits)
                 .marked(docs, F.col("n"), _prefix(F.col("t"), prefix_chars)).where("sieve_hit"))
    return (survivors.select("id", full_hash(F.col("t")).alias("text_sha256"))
            .groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
            .where("group_size > 1"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    groups = copy_groups(df, id_col, text_col, **options)
    # the rows of a large group meet its one row in SALTS tasks
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = df.select(F.col(id_col), full_hash(F.col(text_col)).alias("text_sha256"),
                     F.pmod(F.hash(id_col), F.lit(SALTS)).alias("salt"))
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return (docs.join(groups, ["text_sha256", "salt"], "left")
            .select(id_col, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                    F.col(id_col).eqNullSafe(keep).alias("kept"), "text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns.

    Equal rows of one id stay as they are: they are one document read twice.
    """
    groups = copy_groups(df, id_col, text_col, **options)
    docs = df.select(F.col(id_col).alias("id"), full_hash(F.col(text_col)).alias("text_sha256"))
    dropped = (docs.join(groups, "text_sha256").where("NOT id <=> keep_id AND id IS NOT NULL")
               .select(F.col("id").alias(id_col)))
    return without(df, dropped, id_col)
