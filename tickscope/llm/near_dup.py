"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document is its set of word shingles. Its sketch has SIZE coordinates, filled in
rounds: in round i every shingle is thrown into one hashed bin with a value above those
of earlier rounds, and a bin keeps its smallest value. From round SIZE on, round
SIZE + j throws every shingle into bin j, so all coordinates are filled at the latest
then. Two sketches agree in about as many coordinates as their sets are similar, with
concentration around it, for sets of any size.

Documents of equal sets are one class. Classes are numbered in the order of their
smallest ids, and only the last step goes from numbers to ids. The bands of the classes
give buckets. Candidates are first the pairs of a bucket's smallest
member with each other one; what they verify joins classes into components. Only
buckets that still hold several components are then searched for pairs across
components, so a large group of copies or near copies costs its size, not its square.
Sketch agreement, far below what similar sets show, and set sizes are compared before
full sets are, and so are parity bitmaps: bit b of a set tells whether an odd number of
its shingles hash to b. Each differing bit needs a shingle that only one set has, so
bitmaps that differ too much rule a link out with certainty.

At similarity 0.8 a pair shares none of the BANDS bands with a probability of 4e-9.

Null or empty text: an empty set, linked with nothing. Rows without an id take part, a
component without any id has a null one, and each such row is kept. Repeated rows are
copies: same component, kept alike. Different texts under one id are told apart: each
is linked by its own set and kept or not on its own, and a shared id joins nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import Memo, bound_batches, fresh, written

BANDS, ROWS = 64, 6
SIZE = BANDS * ROWS
PERCENT = 80
# Two-bit sketches of sets of similarity 0.8 agree in 85 % of the coordinates, with a
# standard deviation of 1.8 %; pairs below this are 5.5 deviations away.
LEAST_AGREEMENT = int(0.75 * SIZE)
PLANE = SIZE // 64  # words of one bit of all coordinates
PARITY = 16  # 64-bit words of a parity bitmap; more would outgrow what the JVM compiles
NO_ID = 1 << 62
CHUNK = 1 << 20  # shingles sketched together
CHUNK_DOCS = 4096  # and at most so many documents, and a batch's, are sketched together
ALL_ONES = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, width: int):
        import xxhash

        self.width = width
        self.words = Memo(lambda words: [xxhash.xxh3_64_intdigest(w) for w in words])

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        # bytes.lower and bytes.split know A-Z and the six ASCII white spaces only.
        words = [t.encode().lower().split() for t in texts]
        known = self.words.many(set(chain.from_iterable(words)))
        lengths = [len(w) for w in words]
        ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, sum(lengths))
        out, at, k = [], 0, self.width
        for n in lengths:
            own, at = ids[at:at + n], at + n
            if not n:
                out.append(own)
                continue
            m = min(k, n)  # fewer words than a shingle: the whole sequence
            h = mix(own[:n - m + 1] + np.uint64(m))
            for j in range(1, m):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + own[j:n - m + 1 + j])
            out.append(np.unique(h))
        return out


def sketches(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """One row of ``size`` coordinates for each of these sets, none of which is empty."""
    lengths = np.array([len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), lengths)
    unset = np.uint64(ALL_ONES)
    out = np.full(len(sets) * size, unset, dtype=np.uint64)
    missing = np.full(len(sets), size)
    for round_ in range(2 * size):
        if not len(items):
            break
        h = mix(items + np.uint64(round_ * 0x9E3779B97F4A7C15 & ALL_ONES))
        value = np.uint64(round_ << 40) + (h >> np.uint64(24))
        if round_ < size:
            bin_ = ((h & np.uint64(0xFFFFFF)) * np.uint64(size) >> np.uint64(24)).astype(np.int64)
        else:
            bin_ = np.full(len(items), round_ - size)
        place = owner * size + bin_
        new = out[place] > np.uint64(round_ << 40)  # filled bins of earlier rounds keep their value
        place, value = place[new], value[new]
        np.minimum.at(out, place, value)
        missing = (out.reshape(-1, size) == unset).sum(axis=1) if round_ % 8 == 7 or round_ < 4 else missing
        if not missing.all():
            open_ = missing[owner] > 0
            items, owner = items[open_], owner[open_]
    return out.reshape(-1, size)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(len(sketch), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sketch), BANDS))
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return h.view(np.int64)


def two_bits(sketch: np.ndarray) -> np.ndarray:
    """Two hashed bits of each coordinate, in 64-bit words: all first bits, then all second ones."""
    h = mix(sketch)
    planes = [np.packbits((h >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1) for k in (0, 1)]
    return np.concatenate(planes, axis=1).view(np.int64)


def parity_bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of PARITY words for each set: its shingles flip the bits they hash to."""
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    word = (items >> np.uint64(6) & np.uint64(PARITY - 1)).astype(np.int64)
    out = np.zeros(len(sets) * PARITY, dtype=np.uint64)
    np.bitwise_xor.at(out, owner * PARITY + word, np.uint64(1) << (items & np.uint64(63)))
    return out.reshape(-1, PARITY).view(np.int64)


SKETCH_SCHEMA = (
    "node bigint, hash bigint, n_shingles bigint, class binary, bands array<bigint>, bits array<bigint>, parity array<bigint>")


def node_of(text):
    """The id, or where it is null one past all ids, made from the text."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_ID)))


def with_nodes(docs: DataFrame) -> DataFrame:
    """node, hash, text: the hash tells texts under one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(node_of(text).alias("node"), F.xxhash64(text).alias("hash"), text.alias("text"))


def sketched(nodes: DataFrame, width: int) -> DataFrame:
    bound_batches(nodes.sparkSession)

    def rows(ids: list, hashes: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        made = sketches([sets[i] for i in full]) if full else None  # empty texts alone
        bands, bits, parity = ([None] * len(sets) for _ in range(3))
        if full:
            flips = parity_bitmaps([sets[i] for i in full])
            for i, b, o, f in zip(full, band_keys(made), two_bits(made), flips):
                bands[i], bits[i], parity[i] = b, o, f
        classes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
             pa.array(classes, pa.binary()), *[pa.array(c, pa.list_(pa.int64())) for c in (bands, bits, parity)]],
            ["node", "hash", "n_shingles", "class", "bands", "bits", "parity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, ids, hashes, sets, held = Shingler(width), [], [], [], 0
        for batch in batches:
            ids += batch.column("node").to_pylist()
            hashes += batch.column("hash").to_pylist()
            new = shingler.sets(batch.column("text").to_pylist())
            sets += new
            held += sum(map(len, new))
            if held > CHUNK or len(ids) >= CHUNK_DOCS:
                yield rows(ids, hashes, sets)
                ids, hashes, sets, held = [], [], [], 0
        if ids:
            yield rows(ids, hashes, sets)

    return nodes.mapInArrow(run, SKETCH_SCHEMA)


def shingle_sets(nodes: DataFrame, width: int) -> DataFrame:
    bound_batches(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sets = [s.view(np.int64) for s in shingler.sets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return nodes.mapInArrow(run, "node bigint, shingles array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) for every node of ``links`` (a, b).

    Labels take the smallest one next to them, then that one's own label, until none
    changes; each round is written, so a lost executor costs one round.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
        "node", F.least("node", "near").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = written(stepped.join(jump, "label").select(
            "node", "was", F.least("label", "further").alias("label")))
        if labels.where("label <> was").isEmpty():
            return labels.select("node", "label")


class Search:
    """The links of one table: candidates from ``sketch``, confirmed on the sets of ``nodes``."""

    def __init__(self, nodes: DataFrame, sketch: DataFrame, width: int, percent: int):
        self.nodes, self.width, self.percent = nodes, width, percent
        full = sketch.where("n_shingles > 0")
        # From here on, a node is the number of a class; ``rep`` is its smallest id.
        reps = full.groupBy("class").agg(F.min("node").alias("rep")).orderBy("rep", "class")
        self.classes = written(reps.withColumn("node", F.monotonically_increasing_id()))
        own = full.withColumnRenamed("node", "rep").join(self.classes, ["rep", "class"]).dropDuplicates(["node"])
        self.facts = written(own.select("node", "rep", "hash", "n_shingles", "bits", "parity", "bands"))
        self.keys = self.facts.select("node", F.explode("bands").alias("key"))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and sketches allow the similarity."""
        for side in "ab":
            facts = self.facts.select(F.col("node").alias(side), *self.named(side, "n_shingles", "bits", "parity"))
            pairs = pairs.join(facts, side)
        return pairs.where(self.alike()).select("a", "b", "na", "nb")

    @staticmethod
    def named(side: str, *columns: str) -> list:
        return [F.col(c).alias(("n" if c == "n_shingles" else c) + side) for c in columns]

    def alike(self):
        """Sizes, sketches and parity bitmaps of sides a and b allow the similarity."""
        same = F.lit(SIZE)
        for i in range(PLANE):
            differ = [F.get("bitsa", F.lit(k)).bitwiseXOR(F.get("bitsb", F.lit(k))) for k in (i, i + PLANE)]
            same = same - F.bit_count(differ[0].bitwiseOR(differ[1]))
        small, large = F.least("na", "nb"), F.greatest("na", "nb")
        apart = F.lit(0)
        for i in range(PARITY):
            apart = apart + F.bit_count(F.get("paritya", F.lit(i)).bitwiseXOR(F.get("parityb", F.lit(i))))
        # At the similarity asked for, so many shingles at most are in one set alone.
        few = (100 + self.percent) * apart <= (100 - self.percent) * (F.col("na") + F.col("nb"))
        return (100 * small >= self.percent * large) & (same >= LEAST_AGREEMENT) & few

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        rows = self.facts.join(wanted, "node", "left_semi").select("node", "rep", "hash")
        texts = self.nodes.withColumnRenamed("node", "rep").join(rows, ["rep", "hash"]).select("node", "text")
        sets = written(shingle_sets(texts, self.width).dropDuplicates(["node"]))
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}")), side)
        shared = F.size(F.array_intersect("sa", "sb"))
        enough = 100 * shared >= self.percent * (F.col("na") + F.col("nb") - shared)
        return written(pairs.where(enough).select("a", "b"))

    def links(self) -> DataFrame:
        """Links that join what any link joins."""
        leaders = self.keys.groupBy("key").agg(
            F.min("node").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1")
        leaders = written(leaders)
        stars = self.keys.withColumnRenamed("node", "b").join(leaders.select("key", "a"), "key").where("a <> b")
        likely = written(self.likely(stars.select("a", "b").distinct()))
        # One leader for each member first: most other pairs are joined by then.
        first = likely.groupBy("b").agg(F.min(F.struct("a", "na", "nb")).alias("x")).select("x.a", "b", "x.na", "x.nb")
        links = self.confirmed(first)
        rest = self.apart(likely.join(first.select("a", "b"), ["a", "b"], "left_anti"), components(links))
        links = written(links.union(self.confirmed(written(rest))))
        return links.union(self.confirmed(written(self.across(leaders, likely, components(links)))))

    def labelled(self, rows: DataFrame, labels: DataFrame, side: str) -> DataFrame:
        named = labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
        return rows.join(named, side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))

    def apart(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        return self.labelled(self.labelled(pairs, labels, "a"), labels, "b").where("la <> lb").select("a", "b", "na", "nb")

    def across(self, leaders: DataFrame, tried: DataFrame, labels: DataFrame) -> DataFrame:
        """Likely pairs of different components in buckets of three and more, not tried yet."""
        large = self.keys.join(leaders.where("members > 2").select("key"), "key", "left_semi")
        rows = self.labelled(large.withColumnRenamed("node", "a"), labels, "a")
        mixed = rows.groupBy("key").agg(F.min("la").alias("low"), F.max("la").alias("high")).where("low <> high")
        rows = written(rows.join(mixed.select("key"), "key", "left_semi").join(
            self.facts.select(F.col("node").alias("a"), *self.named("a", "n_shingles", "bits", "parity", "bands")), "a"))
        other = rows.select(
            F.col("key").alias("other"), F.col("a").alias("b"), *[F.col(f"{n}a").alias(f"{n}b") for n in ("l", "n", "bits", "parity", "bands")])
        # A pair is met in the first bucket it shares, not in each.
        first = F.col("key") == F.array_min(F.array_intersect("bandsa", "bandsb"))
        met = rows.join(other, (F.col("key") == F.col("other")) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & self.alike() & first)
        return met.select("a", "b", "na", "nb").join(tried.select("a", "b"), ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """node, hash, n_shingles, component per row; see :func:`node_of` for what a node is."""
    nodes = with_nodes(docs)
    sketch = written(sketched(nodes, width))
    search = Search(nodes, sketch, width, percent)
    labels = components(search.links())
    # The smallest number of a component is that of its smallest id.
    smallest = search.classes.select(F.col("node").alias("label"), F.col("rep").alias("component"))
    found = search.classes.join(labels.join(smallest, "label"), "node", "left")
    of_class = found.select("class", F.coalesce("component", "rep").alias("component"))
    rows = sketch.select("node", "hash", "n_shingles", "class").join(of_class, "class", "left")
    return rows.select("node", "hash", "n_shingles", F.coalesce("component", "node").alias("component"))


def near_dup_table(docs: DataFrame, width: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = near_duplicates(docs.select("doc_id", "text"), width, percent)

    def shown(c):
        return F.when(F.col(c) < NO_ID, F.col(c))

    return rows.select(
        shown("node").alias("doc_id"), "n_shingles", shown("component").alias("component_id"),
        (shown("node").eqNullSafe(shown("component"))).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows whose id is the smallest of their component; repeated rows of it all stay."""
    node, own, lost, theirs = fresh(docs, "_node", "_hash", "_lost", "_theirs")
    found = near_duplicates(docs.select("doc_id", "text"), width, percent)
    dropped = found.where("node <> component").select(F.col("node").alias(lost), F.col("hash").alias(theirs)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn(node, node_of(text)).withColumn(own, F.xxhash64(text))
    return rows.join(dropped, (F.col(node) == F.col(lost)) & (F.col(own) == F.col(theirs)), "left_anti").select(*docs.columns)
