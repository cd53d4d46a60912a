"""K-d tree partitioning into shards of nearly equal bytes.

Each node is split at the weighted median along the metadata dimension in which it is
widest, measured against the whole table, until there are as many leaves as shards.
The medians are exact and found without sorting: histograms of the weight are refined
around the target until one value is left. Only histograms (a few hundred rows a
node) reach the driver.

Dimensions depend on the text alone, ties are ordered by its checksum, and a split
prefers to keep rows of one text together: it goes through such a group only if
keeping it whole would move the split by more than ``slack`` of a shard. Null text:
size 1. Null ids are rows like others, and rows repeating id and text are spread like
others too. Only built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import numbered_within, written

SHARDS, BINS, SLACK = 8, 512, 0.02
DIMENSIONS = ("size", "lines", "wide", "spaces")
KEYS = ("value", "text_crc32", "ticket")


def metadata(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def occurrences(of):
        return F.length(text) - F.length(F.replace(text, F.lit(of), F.lit("")))

    # Rows equal in id and text differ in the last bits, so a cut can go through them too. The row's number is
    # only known where it is computed: the table is stored before it is used.
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 12))
    ticket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 28)) * (1 << 12) + own
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        occurrences("\n").cast("bigint").alias("lines"),
        (F.octet_length(text) - F.length(text)).cast("bigint").alias("wide"),
        occurrences(" ").cast("bigint").alias("spaces"),
        ticket.alias("ticket"),
    )


def _table(spark, schema: str, rows: list[tuple]) -> DataFrame:
    """A few rows (one per node, so at most the number of shards) as a table to broadcast."""
    names, kinds = zip(*(x.split() for x in schema.split(",")))
    structs = [F.struct(*[F.lit(v).cast(k).alias(n) for n, k, v in zip(names, kinds, row)]) for row in rows]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*structs))))


def cuts(rows: DataFrame, wanted: dict[int, dict], slack: float) -> dict[int, tuple]:
    """For each node the last key values on its left side, compared in order.

    ``rows``: node, weight and the KEYS. wanted[node]: target (weight of the left side)
    and low, high (range of the first key).
    """
    state = {n: {"prefix": (), "before": 0, "low": w["low"], "high": w["high"]} for n, w in wanted.items()}
    done: dict[int, tuple] = {}
    value, checksum, ticket = map(F.col, KEYS)
    while state:
        searched = _table(rows.sparkSession, "of int, level int, a bigint, b bigint, low bigint, high bigint, width bigint", [
            (n, len(s["prefix"]), *(*s["prefix"], 0, 0)[:2], s["low"], s["high"],
             max(1, -(-(s["high"] - s["low"] + 1) // BINS))) for n, s in state.items()])
        level = F.col("level")
        key = F.when(level == 0, value).when(level == 1, checksum).otherwise(ticket)
        tied = ((level < 1) | (value == F.col("a"))) & ((level < 2) | (checksum == F.col("b")))
        inside = rows.join(searched, F.col("node") == F.col("of")).withColumn("key", key).where(
            tied & F.col("key").between(F.col("low"), F.col("high")))
        bins = inside.groupBy("node", F.floor((F.col("key") - F.col("low")) / F.col("width")).alias("bin")).agg(
            F.sum("weight").alias("weight"), F.min("key").alias("first"), F.max("key").alias("last"))
        found: dict[int, list] = {}
        for r in bins.collect():  # at most BINS a node
            found.setdefault(r["node"], []).append(r)
        for n in list(state):
            s, target = state[n], wanted[n]["target"]
            for r in sorted(found[n], key=lambda r: r["bin"]):
                if s["before"] + r["weight"] >= target:
                    break
                s["before"] += r["weight"]
            # r is the bin that the target lies in.
            if r["first"] < r["last"]:
                s["low"], s["high"] = r["first"], r["last"]
                continue
            depth = len(s["prefix"])
            below, above = target - s["before"], s["before"] + r["weight"] - target
            if depth == 2 or depth == 1 and min(below, above) <= slack:
                # The value goes left, or it is the first on the right.
                done[n] = (*s["prefix"], r["first"] if above <= below else r["first"] - 1)
                del state[n]
            else:
                s["prefix"] = (*s["prefix"], r["first"])
                s["low"], s["high"] = 0, (1 << 32) - 1 if depth == 0 else (1 << 40) - 1
    return done


def _split(rows: DataFrame, found: dict[int, tuple], leaves: dict[int, int]) -> DataFrame:
    """``rows`` with the node that each cut moves them to."""
    end = (1 << 62,)
    table = _table(rows.sparkSession, "of int, a bigint, b bigint, c bigint, right int", [
        (n, *(cut + 2 * end)[:3], n + leaves[n] // 2) for n, cut in found.items()])
    value, checksum, ticket = map(F.col, KEYS)
    after = (value > F.col("a")) | (value == F.col("a")) & (
        (checksum > F.col("b")) | (checksum == F.col("b")) & (ticket > F.col("c")))
    joined = rows.join(table, F.col("node") == F.col("of"), "left")
    node = F.when(F.col("of").isNotNull() & after, F.col("right")).otherwise(F.col("node"))
    return joined.withColumn("node", node).drop("of", "a", "b", "c", "right")


def kd_leaves(rows: DataFrame, shards: int, slack: float, dimensions=DIMENSIONS) -> DataFrame:
    """``rows`` (with ``node`` 0 stored in them) with ``shard``; nodes are named by their first shard."""
    rows = rows.withColumn("weight", F.col("size"))
    leaves = {0: shards}  # first shard of a node: how many shards it will become
    whole = None
    while any(n > 1 for n in leaves.values()):
        facts = rows.groupBy("node").agg(F.sum("weight").alias("weight"), *[
            f(d).alias(f"{d}_{f.__name__}") for d in dimensions for f in (F.min, F.max)]).collect()
        facts = {r["node"]: r for r in facts}

        def width(r, d):
            return r[f"{d}_max"] - r[f"{d}_min"]

        whole = whole or facts.get(0)
        wanted, widest = {}, {}
        for n, parts in leaves.items():
            if parts > 1 and n in facts:
                r = facts[n]
                widest[n] = max(dimensions, key=lambda d: width(r, d) / max(1, width(whole, d)))
                wanted[n] = {"target": r["weight"] * (parts // 2) / parts,
                             "low": r[f"{widest[n]}_min"], "high": r[f"{widest[n]}_max"]}
        value = F.lit(0).cast("bigint")
        for d in set(widest.values()):
            value = F.when(F.col("node").isin([n for n in widest if widest[n] == d]), F.col(d)).otherwise(value)
        keyed = rows.withColumn("value", value)
        rows = _split(keyed, cuts(keyed, wanted, slack), leaves).drop("value") if wanted else rows
        leaves = {k: v for n, parts in leaves.items() for k, v in (
            ((n, parts // 2), (n + parts // 2, parts - parts // 2)) if parts > 1 else ((n, parts),))}
    return rows.withColumnRenamed("node", "shard").drop("weight")


def shard_table(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = written(metadata(docs).withColumn("node", F.lit(0)))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    placed = written(kd_leaves(rows, shards, slack * (total["size"] or 0) / shards))
    slots = numbered_within(placed, total["n"], ["shard"], ["doc_id", "text_crc32", "size", "ticket"], "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"))
