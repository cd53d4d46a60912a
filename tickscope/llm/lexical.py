"""Ranked lexical search: MaxScore with bounds for pairs of terms.

The index is cut into blocks of documents. A block's row holds its documents, their
lengths, and for every term the documents with it; making it needs no shuffle. For a
block of queries, bounded in items and characters, three passes over blocks follow:

1. the queries' terms are cut out of every block, which also gives document frequencies
   and so the impact of every posting;
2. pairs of a query's terms, heaviest first, get their *intersection list*: the documents
   with both and the largest joint impact among them. Documents on the lists of a query's
   heaviest pairs are scored at once, and the ``top``-th best of all blocks is a score
   that no result of the query can be below;
3. MaxScore: in a block, the terms of a pair together add at most the largest of their
   joint maximum and each one's own maximum, mostly less than the sum of the maxima that
   independent bounds allow. Blocks whose bounds add up to less than the threshold are
   skipped, pairs and terms that cannot reach it alone only complete the candidates that
   others bring, and candidates go as soon as what is left cannot lift them over it. The
   threshold grows with the results of the task. Ties with it stay in.

Nothing is approximate: bounds are sums of exact integers, and documents that tie with
the threshold are kept until ids decide. Each task hands over ``top`` documents of a
query at most.

Null and empty texts, and those without a term, are no documents and no queries. Every
row is a document, repeated ones too; a null doc_id comes first in a tie. Rows of queries
equal in id and text are one item; other texts under the same id are items of their own,
each with ranks from 1. A term may be of any length. Empty tables give no rows. Columns
beyond ids and texts are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickscope.llm.common import bound_batches, written
from tickscope.session import ensure_checkpoint_dir

TOP = 20
BLOCK_DOCS, BLOCK_BYTES = 4096, 4 << 20
ITEMS, ITEM_CHARS = 512, 1 << 20  # of a block of queries; one item alone may be longer
SEED_PAIRS = 3

# Letters, digits and everything beyond ASCII make terms; only A-Z is folded.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = ("doc_ids array<bigint>, lengths array<int>, terms binary, counts binary, docs binary, tfs binary, "
         "n_docs bigint, n_terms bigint")
VIEW = "doc_ids array<bigint>, lengths array<int>, ids array<int>, counts array<int>, docs binary, tfs binary"
PAIRED = VIEW + (", pairs array<int>, joint array<bigint>, pair_sizes array<int>, "
                 "seeds array<struct<query: int, score: bigint>>")
FOUND = "query int, doc_id bigint, score bigint"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class _Filling:
    """A block while documents come in."""

    def __init__(self):
        self.number = defaultdict(count().__next__)
        self.ids, self.lengths, self.bytes = [], [], 0
        self.terms, self.tfs = [], []

    def add(self, doc_id: int | None, text: str) -> None:
        found = terms_of(text)
        if found:
            own = Counter(found)
            self.ids.append(doc_id)
            self.lengths.append(len(found))
            self.terms.append(np.fromiter(map(self.number.__getitem__, own), np.int32, len(own)))
            self.tfs.append(np.fromiter(own.values(), np.int32, len(own)))
            self.bytes += len(text)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.bytes >= BLOCK_BYTES

    def row(self) -> pa.RecordBatch:
        docs = np.repeat(np.arange(len(self.ids), dtype=np.uint16), [len(t) for t in self.terms])
        terms, tfs = np.concatenate(self.terms), np.concatenate(self.tfs)
        order = np.argsort(terms, kind="stable")
        columns = {
            "doc_ids": pa.array([self.ids], pa.list_(pa.int64())), "lengths": pa.array([self.lengths], pa.list_(pa.int32())),
            "terms": b" ".join(self.number), "counts": np.bincount(terms).astype(np.int32).tobytes(),
            "docs": docs[order].tobytes(), "tfs": tfs[order].tobytes(), "n_docs": len(self.ids), "n_terms": sum(self.lengths)}
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array([c]) for c in columns.values()], list(columns))


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each block of documents, stored in the shared folder."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Filling()
        for batch in batches:
            for doc_id, own in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                block.add(doc_id, own)
                if block.full():
                    yield block.row()
                    block = _Filling()
        if block.ids:
            yield block.row()

    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return written(source.where(F.col("text").isNotNull()).mapInArrow(run, INDEX))


class Queries:
    """A block of queries: terms by number, weights, and the units that bounds are made of."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.item_ids = [i for i, _ in items]
        counted = [Counter(terms_of(text)) for _, text in items]
        self.terms = sorted(set().union(*counted))
        number = {t: k for k, t in enumerate(self.terms)}
        self.uses = [{number[t]: n for t, n in own.items()} for own in counted]

    def weigh(self, df: dict[int, int], documents: int, length: int) -> None:
        """Weights from the corpus, then pairs of each query's terms, heaviest first."""
        self.documents, self.length = documents, length
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1)))
                                 for t in range(len(self.terms))], dtype=np.int64)
        self.pairs: dict[tuple[int, int], int] = {}
        self.units: list[list[tuple[int, ...]]] = []  # of each query: (pair, a, b) or (term,)
        for uses in self.uses:
            order = sorted((t for t in uses if df.get(t, 0)), key=lambda t: (-uses[t] * self.weights[t], t))
            own: list[tuple[int, ...]] = []
            for a, b in zip(order[::2], order[1::2]):
                pair = (min(a, b), max(a, b))
                own.append((self.pairs.setdefault(pair, len(self.pairs)), *pair))
            self.units.append(own + ([(order[-1],)] if len(order) % 2 else []))
        partners = defaultdict(list)
        for (a, b), number in self.pairs.items():
            partners[a].append((b, number))
        self.partners = dict(partners)


class Postings:
    """One block's postings of a block of queries, as exact integer impacts."""

    def __init__(self, row: dict, queries: Queries):
        self.size = len(row["doc_ids"])
        n = np.array(row["lengths"], dtype=np.int64)
        if 25 * int(n.max(initial=0)) * queries.documents >= 1 << 63:
            n = n.astype(object)
        m = (75 + 25 * n * queries.documents // queries.length).astype(np.int64)
        docs, tf = np.frombuffer(row["docs"], np.uint16).astype(np.int64), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        ids, counts = np.array(row["ids"], dtype=np.int64), np.array(row["counts"], dtype=np.int64)
        impact = np.repeat(queries.weights[ids], counts) * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))
        ends = np.cumsum(counts)
        self.of = {t: (docs[a:b], impact[a:b]) for t, a, b in zip(ids.tolist(), (ends - counts).tolist(), ends.tolist())}
        self.most = np.zeros(len(queries.terms), dtype=np.int64)
        for t, (_, own) in self.of.items():
            self.most[t] = own.max(initial=0)

    def lists(self, queries: Queries) -> dict[int, tuple[np.ndarray, int]]:
        """By pair: the documents with both terms and the largest joint impact; pairs that never meet are left out."""
        out, own, here = {}, np.zeros(self.size, dtype=np.int64), np.zeros(self.size, dtype=bool)
        for a in queries.partners.keys() & self.of.keys():
            docs, impact = self.of[a]
            own[docs], here[docs] = impact, True
            for b, pair in queries.partners[a]:
                if b in self.of:
                    others, more = self.of[b]
                    both = here[others]
                    if both.any():
                        met = others[both]
                        out[pair] = met, int((own[met] + more[both]).max())
            own[docs], here[docs] = 0, False
        return out

    def add(self, scores: np.ndarray, term: int, uses: int, candidates: np.ndarray) -> None:
        """The impact of ``term`` added to the scores of these documents, given in order."""
        docs, impact = self.of[term]
        at = np.searchsorted(docs, candidates)
        at[at == len(docs)] = 0
        hit = docs[at] == candidates
        scores[candidates[hit]] += uses * impact[at[hit]]


def pair_bound(ua: int, ub: int, most_a: int, most_b: int, joint: int) -> int:
    """What two terms, used ``ua`` and ``ub`` times, add to a document at most.

    ``joint``: the largest sum of their impacts in a document with both, 0 if there is none.
    """
    least = min(ua, ub)
    return least * max(most_a, most_b, joint) + (ua - least) * most_a + (ub - least) * most_b


def bounded_units(uses: dict[int, int], units: list[tuple[int, ...]], most: np.ndarray, joint: dict[int, int],
                  pairwise: bool = True) -> list[tuple[int, list[int]]]:
    """(bound, terms) of a query in a block, the smallest bound first; ``pairwise=False``: independent terms."""
    out = []
    for unit in units:
        terms = [t for t in unit[-2:] if most[t]] if len(unit) > 1 else [t for t in unit if most[t]]
        if len(terms) == 2 and pairwise:
            a, b = terms
            out.append((pair_bound(uses[a], uses[b], int(most[a]), int(most[b]), joint.get(unit[0], 0)), terms))
        else:
            out += [(uses[t] * int(most[t]), [t]) for t in terms]
    out.sort()
    return out


def search_block(postings: Postings, uses: dict[int, int], units: list[tuple[int, list[int]]], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block (in order) that score ``threshold`` or more, which is 1 at least, and their scores."""
    reach = np.cumsum([bound for bound, _ in units])
    if not units or reach[-1] < threshold:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    optional = int(np.searchsorted(reach, threshold, side="left"))
    scores = np.zeros(postings.size, dtype=np.int64)
    for _, terms in units[optional:]:
        for t in terms:
            docs, impact = postings.of[t]
            scores[docs] += uses[t] * impact
    candidates = np.flatnonzero(scores)
    for k in range(optional - 1, -1, -1):
        candidates = candidates[scores[candidates] + reach[k] >= threshold]
        if not len(candidates):
            break
        for t in units[k][1]:
            postings.add(scores, t, uses[t], candidates)
    candidates = candidates[scores[candidates] >= threshold]
    return candidates, scores[candidates]


class Best:
    """The best documents of one query so far: highest scores, then null ids, then small ones."""

    def __init__(self, top: int, threshold: int):
        self.top, self.threshold = top, max(1, threshold)
        self.scores, self.known, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def take(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        scores, known, ids = (np.concatenate(x) for x in ((self.scores, scores), (self.known, known), (self.ids, ids)))
        order = np.lexsort((ids, known, -scores))[:self.top]
        self.scores, self.known, self.ids = scores[order], known[order], ids[order]
        if len(order) == self.top:
            self.threshold = max(self.threshold, int(self.scores[-1]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _row(row: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=schema)


_view = [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32())),
         ("counts", pa.list_(pa.int32())), ("docs", pa.binary()), ("tfs", pa.binary())]
_VIEW = pa.schema(_view)
_PAIRED = pa.schema([*_view, ("pairs", pa.list_(pa.int32())), ("joint", pa.list_(pa.int64())),
                     ("pair_sizes", pa.list_(pa.int32())),
                     ("seeds", pa.list_(pa.struct([("query", pa.int32()), ("score", pa.int64())])))])


def query_postings(index: DataFrame, queries: Queries) -> DataFrame:
    """The blocks of the index with the postings of the queries' terms alone."""
    terms = queries.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {t: k for k, t in enumerate(terms)}
        for row in _rows(batches):
            counts = np.frombuffer(row["counts"], np.int32)
            there = [(k, wanted[t]) for k, t in enumerate(row["terms"].split(b" ")) if t in wanted]
            if not there:
                continue
            at, ids = np.array(there).T
            ends = np.cumsum(counts)
            pick = np.concatenate([np.arange(a, b) for a, b in zip(ends[at] - counts[at], ends[at])])
            yield _row({
                "doc_ids": row["doc_ids"], "lengths": row["lengths"], "ids": ids.tolist(), "counts": counts[at].tolist(),
                "docs": np.frombuffer(row["docs"], np.uint16)[pick].tobytes(),
                "tfs": np.frombuffer(row["tfs"], np.int32)[pick].tobytes()}, _VIEW)

    return written(index.mapInArrow(run, VIEW))


def pair_lists(view: DataFrame, queries: Queries, top: int = TOP) -> DataFrame:
    """The blocks with their intersection lists' joint maxima, and scores of documents on the heaviest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries  # of a block of queries, bounded; it travels with the job
        for row in _rows(batches):
            postings = Postings(row, own)
            lists = postings.lists(own)
            seeds, scores = [], np.zeros(postings.size, dtype=np.int64)
            for q, (uses, units) in enumerate(zip(own.uses, own.units)):
                heavy = [lists[u[0]][0] for u in units[:SEED_PAIRS] if len(u) > 1 and u[0] in lists]
                if heavy:
                    docs = np.unique(np.concatenate(heavy))
                    for t in uses.keys() & postings.of.keys():
                        postings.add(scores, t, uses[t], docs)
                    seeds += [{"query": q, "score": int(s)} for s in np.sort(scores[docs])[::-1][:top]]
                    scores[docs] = 0
            pairs = sorted(lists)
            yield _row(row | {"pairs": pairs, "joint": [lists[p][1] for p in pairs],
                              "pair_sizes": [len(lists[p][0]) for p in pairs], "seeds": seeds}, _PAIRED)

    return written(view.mapInArrow(run, PAIRED))


def thresholds(paired: DataFrame, top: int = TOP) -> dict[int, int]:
    """By query: the ``top``-th best score of documents on its heaviest lists, where there are so many."""
    seeds = paired.select(F.explode("seeds").alias("s")).select("s.query", "s.score")
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    last = seeds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    rows = last.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
    return {r["query"]: r["score"] for r in rows.where(F.col("n") == top).collect()}  # of a block of queries


def search_blocks(paired: DataFrame, queries: Queries, least: dict[int, int], top: int = TOP) -> DataFrame:
    """query, doc_id, score: each task's best documents of every query; the overall best are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries
        best = [Best(top, least.get(q, 0)) for q in range(len(own.uses))]
        for row in _rows(batches):
            postings = Postings(row, own)
            joint = dict(zip(row["pairs"], row["joint"]))
            known = np.array([i is not None for i in row["doc_ids"]])
            ids = np.array([i or 0 for i in row["doc_ids"]], dtype=np.int64)
            for q, found in enumerate(best):
                units = bounded_units(own.uses[q], own.units[q], postings.most, joint)
                docs, scores = search_block(postings, own.uses[q], units, found.threshold)
                if len(docs):
                    found.take(scores, known[docs], ids[docs])
        for q, found in enumerate(best):
            if len(found.scores):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(found.scores), q, dtype=np.int32)),
                    pa.array(found.ids, mask=~found.known), pa.array(found.scores)], ["query", "doc_id", "score"])

    return paired.mapInArrow(run, FOUND)


def _blocks_of(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Queries a block at a time: at most ITEMS, and ITEM_CHARS unless one alone is longer."""
    block, chars = [], 0
    for item_id, text in items.toLocalIterator():
        if block and (len(block) >= ITEMS or chars + len(text) > ITEM_CHARS):
            yield block
            block, chars = [], 0
        block.append((item_id, text))
        chars += len(text)
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of the index with the highest scores for each item."""
    spark: SparkSession = index.sparkSession
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("documents"),
                      F.coalesce(F.sum("n_terms"), F.lit(0)).alias("length")).first()
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    place = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(place)
    asked = items.select(F.col(key).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))
    asked = asked.where(F.col("text").isNotNull()).distinct().orderBy("item_id", "text")
    for block in _blocks_of(asked) if total["documents"] else ():
        queries = Queries(block)
        view = query_postings(index, queries)
        df = view.select(F.explode(F.arrays_zip("ids", "counts")).alias("x")).groupBy("x.ids").agg(F.sum("x.counts").alias("df"))
        queries.weigh({r["ids"]: r["df"] for r in df.collect()}, total["documents"], total["length"])
        paired = pair_lists(view, queries, top)
        found = search_blocks(paired, queries, thresholds(paired, top), top)
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(queries.item_ids)), "query int, item_id bigint")
        ranked.join(names, "query").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(place)
    return spark.read.schema(schema).parquet(place)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: ``docs`` indexed and searched for every item."""
    return search(build_index(docs), items, top=top)
