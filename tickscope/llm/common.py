"""What the operators of this package share."""

from __future__ import annotations

import hashlib
import os
import sys
import types
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Spark's own place for the tables that a job writes in between.
from tickscope.session import apply_runtime_settings, written  # noqa: F401

BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
LRU_HALF = 100_000
KEY_LENGTH = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash; null texts are empty."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches small enough that long texts do not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that ``frame`` has no column of."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on the driver; its content travels with the job."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


class Memo:
    """A bounded memo of two generations; one holds at most ``half`` entries and a batch's keys.

    Keys longer than KEY_LENGTH are computed anew for each batch and not kept, so the
    entries are bounded in size and not in number alone.
    """

    def __init__(self, compute, half: int = LRU_HALF):
        self.compute, self.half = compute, half
        self.young: dict = {}
        self.old: dict = {}
        self.long: list = []

    def many(self, keys: set) -> dict:
        """A table with the value of each key, computing in one call those not remembered."""
        for key in self.long:
            del self.young[key]
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = keys.difference(young)
        again = missing.intersection(old)
        young.update((key, old[key]) for key in again)
        new = list(missing.difference(again))
        if new:
            young.update(zip(new, self.compute(new)))
        self.long = [key for key in new if len(key) > KEY_LENGTH]
        return young


class PreTokens:
    """Cuts texts for a pattern whose tokens take at most one leading space.

    A space before a character that is no white space always starts a pre-token, so
    a text may be cut there first, which is much faster than the pattern: every piece
    after such a space is a *spaced word*, and equal ones have equal pre-tokens.
    """

    def __init__(self, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.odd = regex.compile(r" (?:\s|\Z)").search

    def units(self, text: str) -> tuple[list[str], list[str]]:
        """Pre-tokens at the start, then the spaced words (without their space) that follow."""
        if self.odd(text):
            return self.split(text), []
        first, *rest = text.split(" ")
        return self.split(first), rest

    def words(self, spaced: list[str]) -> list[list[str]]:
        """The pre-tokens of each of these spaced words."""
        out: list[list[str]] = []
        for token in self.split(" " + " ".join(spaced)):
            if token[0] == " ":
                out.append([token])
            else:
                out[-1].append(token)
        return out


def hash_of(content: str | bytes) -> str:
    return hashlib.sha256(content.encode() if isinstance(content, str) else content).hexdigest()


def kept_by_worker(name: str, build):
    """``build()``, made once in each Python worker and kept for its later tasks.

    Vocabularies take seconds and memory to set up. One object is kept per ``name``.
    """
    place = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if name not in place:
        place[name] = build()
    return place[name]


def let(value, body):
    """``body(value)`` with ``value`` evaluated once, also where lambdas inside use it many times."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text):
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def numbered_within(frame: DataFrame, rows: int, keys: list[str], identity: list[str], name: str = "number",
                    group_rows: int = 50_000) -> DataFrame:
    """``name`` from 0, without gaps, within each value of ``keys``.

    Rows are dealt to hashed groups of about ``group_rows``. The counts of the groups
    tell where each begins, and only a group's own rows are numbered together, so a
    key may hold any share of all rows. ``rows``: how many rows there are.
    """
    groups = max(16, -(-rows // group_rows))
    dealt = frame.withColumn("_group", F.pmod(F.xxhash64(*identity), F.lit(groups)).cast("int"))
    counts = dealt.groupBy(*keys, "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_group").alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    within = Window.partitionBy(*keys, "_group").orderBy(*identity)
    ranked = dealt.withColumn("_place", F.row_number().over(within) - 1)
    same = F.col("_group") == F.col("_of")
    for key in keys:
        same &= F.col(key) == F.col(f"_{key}")
    joined = ranked.join(begins, same).withColumn(name, (F.col("_begin") + F.col("_place")).cast("bigint"))
    return joined.select(*frame.columns, name)
