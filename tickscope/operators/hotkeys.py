"""Cutting keys with very many rows into ordered chunks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tickscope.session import written

ROWS_PER_CHUNK = 1 << 21


def bucket_bits(rows_per_chunk: int) -> int:
    """Buckets of ``2 ** bits`` orders hold a sixteenth of a chunk at most."""
    return max(0, rows_per_chunk.bit_length() - 5)


def bucket_of(order: str, bits: int) -> Column:
    return F.shiftright(F.col(order).cast("bigint"), bits)


def chunk_hot_keys(
    rows: DataFrame, key: str, order: str, rows_per_chunk: int = ROWS_PER_CHUNK, **facts: Column
) -> tuple[DataFrame, int] | None:
    """Buckets of the keys above ``rows_per_chunk``: key, bucket, chunk and ``facts`` of each.

    ``order`` is an integer unique within a key. It is cut into equal buckets
    (`bucket_of`); one aggregation, combined map-side, counts rows and works out
    ``facts`` (aggregates) for each, and running counts give ascending chunk numbers:
    a chunk holds at most ``rows_per_chunk`` rows plus one bucket. Facts of chunks follow
    from those of buckets without another look at the rows. The second value is more
    than any chunk number. Returns None when no key is hot, so that ordinary data takes
    a plan with no extra join; to know that takes one count of the rows by key.
    """
    seen = Observation()
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > rows_per_chunk)
    hot = written(sizes.observe(seen, F.max("total").alias("most")).select(key))
    most = seen.get["most"]
    if most is None:
        return None

    bits = bucket_bits(rows_per_chunk)
    counts = (
        rows.join(hot, key, "left_semi")
        .groupBy(key, bucket_of(order, bits).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), *[fact.alias(name) for name, fact in facts.items()])
    )
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows_before = F.coalesce(F.sum("n").over(before), F.lit(0))
    chunk = F.floor(rows_before / rows_per_chunk)
    return counts.withColumn("chunk", chunk).drop("n"), most // rows_per_chunk + 1


def with_buckets(rows: DataFrame, buckets: DataFrame, key: str, order: str, rows_per_chunk: int, *names: str) -> DataFrame:
    """``rows`` with columns ``names`` of their bucket, null for keys left whole."""
    on = [key, "bucket"]
    marked = rows.withColumn("bucket", bucket_of(order, bucket_bits(rows_per_chunk)))
    return marked.join(buckets.select(*on, *names), on, "left").drop("bucket")
