"""What several of these operators need: bounded Arrow batches, row sieves, staging."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger.session import work_dir

BATCH_BYTES = 16 << 20
BITMAP_BITS = 26  # 8 MB once broadcast, whatever the input


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with batches bounded in bytes, so that long texts don't pile up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `most` bytes of one column, a row at least."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if size and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Sieve:
    """A bitmap of hashed keys: a key that misses it is surely not among them.

    Built by Spark's bitmap aggregates, 2**bits bits at most, so its broadcast is
    bounded by the parameter. Hits are only candidates; what follows decides exactly.
    """

    def __init__(self, keys: DataFrame, *names: str, bits: int = BITMAP_BITS):
        self.bits = bits
        slot = self._slot(*(F.col(n) for n in names))
        bits_of = keys.select(slot.alias("s")).selectExpr(
            "bitmap_bucket_number(s) AS sieve_bucket", "bitmap_bit_position(s) AS sieve_bit")
        self.table = (bits_of.groupBy("sieve_bucket")
                      .agg(F.expr("bitmap_construct_agg(sieve_bit)").alias("sieve_map")))

    def _slot(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(1 << self.bits)) + 1

    def marked(self, df: DataFrame, *keys: Column) -> DataFrame:
        """df with a boolean column sieve_hit."""
        df = df.withColumn("sieve_slot", self._slot(*keys))
        df = df.withColumn("sieve_bucket", F.expr("bitmap_bucket_number(sieve_slot)"))
        bit = "bitmap_bit_position(sieve_slot)"
        test = (f"coalesce(getbit(cast(conv(hex(substring(sieve_map, cast({bit} div 8 as int) + 1, 1)), 16, 10)"
                f" AS bigint), cast({bit} % 8 as int)) = 1, false)")
        return (df.join(F.broadcast(self.table), "sieve_bucket", "left")
                .withColumn("sieve_hit", F.expr(test))
                .drop("sieve_slot", "sieve_bucket", "sieve_map"))


def sieve_split(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key in ids, rows that surely have none); ids has one column `key`.

    Only the first part needs an exact join, so the rest is never shuffled.
    """
    marked = Sieve(ids, key).marked(df, F.col(key))
    return (marked.where("sieve_hit").select(*df.columns),
            marked.where("NOT sieve_hit").select(*df.columns))


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df less the rows whose key is in ids, exactly; a null key stays."""
    maybe, clear = sieve_split(df, ids, key)
    return clear.unionByName(maybe.join(ids.distinct(), key, "left_anti").select(*df.columns))
