"""Line deduplication across documents.

Lines are exploded with their place, reduced to a 128-bit hash of their key, and
counted by distinct documents. Keys over the threshold drop all their lines; the
places dropped go back to their document, which is put together without them.

Only built-in expressions. Null or empty text: one empty line, whose key is empty and
never dropped. Null ids count together as one document. Repeated rows (same id and
text) count once and are returned each. Rows with one id and different texts count as
one document and keep their own lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import ascii_lower, fresh, let, written

MIN_DOCUMENTS, MIN_CODE_POINTS = 10, 1
STRIPPED = " \t\n\x0b\x0c\r"


def line_key(line):
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def _key_hashes(key):
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def deduplicated(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """``docs`` with three columns more, last in the result: n_lines, n_dropped, kept_text."""
    row, places, n_lines, n_dropped, kept = fresh(docs, "_row", "_places", "n_lines", "n_dropped", "kept_text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    this_row = F.struct(F.xxhash64("doc_id", text).alias("a"), F.xxhash64(text, "doc_id").alias("b"))
    hashed = F.transform(lines, lambda x: let(line_key(x), lambda k: F.struct(
        *[h.alias(n) for h, n in zip(_key_hashes(k), "gh")], (F.length(k) >= min_code_points).alias("counts"))))
    placed = docs.select(F.col("doc_id").alias("doc"), this_row.alias("row"), F.posexplode(hashed).alias("place", "key"))
    placed = written(placed.where("key.counts").select("doc", "row.*", "place", "key.g", "key.h"))
    documents = placed.select("g", "h", "doc").distinct()
    frequent = written(documents.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= min_documents).select("g", "h"))
    dropped = placed.join(frequent, ["g", "h"], "left_semi").groupBy(
        F.col("a").alias(f"{row}a"), F.col("b").alias(f"{row}b")).agg(F.collect_set("place").alias(places))
    rows = docs.withColumn(row, this_row)
    joined = rows.join(
        dropped, (F.col(row)["a"] == F.col(f"{row}a")) & (F.col(row)["b"] == F.col(f"{row}b")), "left")
    # Texts that lose nothing are returned as they are, without taking them apart.
    none = F.col(places).isNull()
    left = let(lines, lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(places)), lambda i: F.get(x, i)), "\n"))
    return joined.select(
        *docs.columns,
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias(n_lines),
        F.when(none, F.lit(0)).otherwise(F.size(places)).cast("bigint").alias(n_dropped),
        F.when(none, text).otherwise(left).alias(kept),
    )


def line_dedup_table(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    rows = deduplicated(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), **limits)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def documents_without_repeats(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with the shortened texts; null stays null."""
    rows = deduplicated(docs, **limits)
    kept = F.when(F.col("text").isNotNull(), F.col(rows.columns[-1])).alias("text")
    return rows.select(*[kept if c == "text" else F.col(c) for c in docs.columns])
