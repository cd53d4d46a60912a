"""Best-fit packing of token sequences by a configuration linear program.

1. Texts become token ids, a separator follows, and documents longer than a sequence
   are cut. Only (length, count) pairs of the pieces go to the driver: at most
   ``capacity`` rows, however many documents there are.
2. A configuration is a multiset of lengths that fits one sequence. The linear program
   that covers the histogram with the fewest configurations is solved by multiplicative
   weights: every length has a price, which falls with the share of its demand that is
   covered, and a knapsack dynamic program finds the dearest configuration, and with the
   same table the dearest one around any length. The configurations add up to a
   fractional cover; prices over the dearest configuration are a dual solution, and the
   cover is done when it is within GAP of the best dual bound so far, and only then. It
   is scaled to the demand and rounded down, and best fit, in bulk per length, packs the
   leftover into the rooms that are left and into new sequences.
3. The plan says how many sequences of which configuration there are. Pieces are
   numbered within their length by counts of hashed groups, so no length is gathered
   in one task, and the number alone tells sequence and offset.

Null or empty text: one piece of the separator. Null ids and repeated rows are packed
as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import Memo, bound_batches, hash_of, ids_and_texts, kept_by_worker, numbered_within, tokenizer_file, written

CAPACITY, SEPARATOR = 2048, 0
# The relative gap of the cover, how fast prices fall, and how close to the dearest a configuration must be.
# Pieces that add less than LIGHT of the value of a configuration, together, are left out of it where they
# are so rare that they would bound how often it can be used.
GAP, RATE, NEAR, LIGHT = 0.05, 0.15, 0.03, 0.01
MISSES = 16
SETTLED = 32  # from this coverage on prices fall ever more slowly, so that any gap closes in the end
WORDS_KEPT = 300_000  # words whose ids a worker remembers, in each of the memo's two generations
MARK, CHUNK = "\x02", 2000  # a character that no text on the fast path has; words encoded together
# Fixed value: the pre-token pattern of the lower-casing vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Characters that no normalisation composes and whose class no Unicode version changes.
COMMON = r"[^\x00\x01\x03-\x1b\x20-ɏ‐-‧‰-⁞]"


# --- 1. pieces ---------------------------------------------------------------------------


class WordEncoder:
    """Packed ids of whole texts with a ``tokenizers`` file that lower-cases and drops white space."""

    def __init__(self, description: str):
        import regex
        from tokenizers import Tokenizer

        parts = json.loads(description)
        self.whole = Tokenizer.from_str(description)
        self.added = {a["content"]: np.array([a["id"]], "<u4").tobytes() for a in parts["added_tokens"]}
        names = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.rare, self.control = regex.compile(COMMON).search, re.compile("[\x02\x1c-\x1f\x7f]").search
        self.sign = os.path.commonprefix(names)  # what every added token begins with
        kinds = [p["type"] for p in parts["pre_tokenizer"].get("pretokenizers", [])]
        self.plain_shape = (
            [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and kinds == ["Split", "ByteLevel"]
            and parts["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": WORD_PATTERN}
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in parts["added_tokens"])
        )
        parts["normalizer"], parts["added_tokens"], parts["truncation"], parts["padding"] = None, [], None, None
        self.model = Tokenizer.from_str(json.dumps(parts))
        self.mark = self.model.encode(MARK, add_special_tokens=False).ids
        self.plain_shape &= len(self.mark) == 1
        self.words = Memo(self._words, WORDS_KEPT)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word: many are encoded in one text, with a mark of one token in between."""
        chunks = [words[i:i + CHUNK] for i in range(0, len(words), CHUNK)]
        texts = [f" {MARK} ".join(chunk) for chunk in chunks]
        out: list[bytes] = []
        for found in self.model.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(found.ids, "<u4")
            packed, marks = ids.tobytes(), np.flatnonzero(ids == self.mark[0]).tolist()
            for begin, end in zip([-1, *marks], [*marks, len(ids)]):
                out.append(packed[4 * begin + 4:4 * end])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut: list[list | bytes] = []
        for text in texts:
            if not self.plain_shape or (self.control(text) if text.isascii() else self.rare(text)):
                ids = self.whole.encode(text, add_special_tokens=False).ids
                cut.append(np.array(ids, "<u4").tobytes())
            else:
                segments = self.cut(text) if self.cut and self.sign in text else [text]
                cut.append([s if s in self.added else s.lower().split() for s in segments])
        distinct: set = set()
        for segments in cut:
            if not isinstance(segments, bytes):
                distinct.update(*(s for s in segments if not isinstance(s, str)))
        known = self.words.many(distinct)
        return [
            segments if isinstance(segments, bytes) else b"".join(
                [self.added[s] if isinstance(s, str) else b"".join(map(known.__getitem__, s)) for s in segments])
            for segments in cut
        ]


def token_pieces(docs: DataFrame, description: str, capacity: int = CAPACITY, separator: int = SEPARATOR,
                 keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; with ``keep_ids`` the ids too."""
    spark = docs.sparkSession
    bound_batches(spark)
    name = f"words {hash_of(description)}"
    sent = spark.sparkContext.broadcast(description)  # a vocabulary, about 2 MB
    end = np.array([separator], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(name, lambda: WordEncoder(sent.value))
        for batch in batches:
            rows = ([], [], [], [], [], [])
            for doc, packed in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                packed += end
                for k in range(0, len(packed), step):
                    ids = packed[k:k + step]
                    values = (doc, k // step, k // 4, len(ids) // 4, zlib.crc32(ids), np.frombuffer(ids, "<i4"))
                    for column, value in zip(rows, values):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            shown = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows[:shown], kinds)], list(names[:shown]))

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return ids_and_texts(docs).mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


# --- 2. the linear program over the length histogram -------------------------------------


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """By room: the value of the dearest configuration in it, and a length of that one (0: leave one free).

    ``prices`` by length from 0 to ``capacity``, below 0 for lengths there are none of.
    """
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    backwards = np.zeros(capacity + 1)  # ``best`` from its end, so that a room's choices lie side by side
    values = np.empty(capacity)
    for room in range(1, capacity + 1):
        found = np.add(backwards[capacity + 1 - room:], prices[1:room + 1], out=values[:room])
        k = int(found.argmax())
        if found[k] > best[room - 1]:
            best[room], took[room] = found[k], k + 1
        else:
            best[room] = best[room - 1]
        backwards[capacity - room] = best[room]
    return best, took


def configuration(took: np.ndarray, room: int) -> Counter:
    found: Counter = Counter()
    while room > 0:
        length = int(took[room])
        if length:
            found[length] += 1
        room -= length or 1
    return found


def best_fit(plan: Counter, histogram: dict[int, int], capacity: int) -> Counter:
    """Put what ``histogram`` counts into the fullest sequences of ``plan`` that fit, longest first.

    Works on counts: equal sequences are filled together, so the effort depends on the
    number of different lengths and configurations, not on the pieces.
    """
    by_room: dict[int, Counter] = {}

    def put(configuration: tuple, n: int) -> None:
        room = capacity - sum(length * k for length, k in configuration)
        by_room.setdefault(room, Counter())[configuration] += n

    def take(configuration: tuple, room: int, n: int) -> None:
        by_room[room][configuration] -= n
        if not by_room[room][configuration]:
            del by_room[room][configuration]
            if not by_room[room]:
                del by_room[room]

    def grown(configuration: tuple, length: int, k: int) -> tuple:
        merged = Counter(dict(configuration))
        merged[length] += k
        return tuple(sorted(merged.items(), reverse=True))

    for configuration, n in plan.items():
        put(configuration, n)
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                k = capacity // length
                if count >= k:
                    put(((length, k),), count // k)
                if count % k:
                    put(((length, count % k),), 1)
                break
            configuration = max(by_room[room])
            n, k = by_room[room][configuration], room // length
            full = min(n, count // k)
            if full:
                take(configuration, room, full)
                put(grown(configuration, length, k), full)
                count -= full * k
            elif count:
                take(configuration, room, 1)
                put(grown(configuration, length, count), 1)
                count = 0
    out: Counter = Counter()
    for group in by_room.values():
        out.update(group)
    return out


def fractional_cover(histogram: dict[int, int], capacity: int, gap: float = GAP) -> tuple[dict[tuple, float], float]:
    """Configurations and their uses, fractions too, that cover ``histogram``; and a bound no cover is below.

    The uses add up to at most 1 + ``gap`` times the bound.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[n] for n in lengths], dtype=float)
    at = {int(n): i for i, n in enumerate(lengths)}
    share, total, bound = np.zeros(len(lengths)), 0.0, 0.0
    uses: dict[tuple, float] = {}
    prices = np.full(capacity + 1, -np.inf)
    while True:
        least = share.min()
        rate = RATE * min(1.0, SETTLED / max(least, 1.0))
        # Where nothing need be wasted a token is worth the same everywhere: prices start there.
        weight = lengths * demand * np.exp(-rate * (share - least))
        prices[lengths] = weight / weight.sum() / demand
        best, took = knapsack(prices, capacity)
        bound = max(bound, 1 / best[capacity])
        around = prices[lengths] + best[capacity - lengths]
        near = np.flatnonzero(around >= (1 - NEAR) * best[capacity])
        gained, misses = np.zeros(len(lengths)), 0
        for i in near[np.argsort(share[near], kind="stable")].tolist():
            first = not gained.any()
            if gained[i] or not first and share[i] >= least + 1:
                continue
            found = configuration(took, capacity - int(lengths[i]))
            found[int(lengths[i])] += 1
            worth = LIGHT * best[capacity] / len(found)
            heavy = {n: k for n, k in found.items() if n == lengths[i] or k * prices[n] >= worth}
            often = min(histogram[n] / k for n, k in heavy.items())
            if often > 4 * min(histogram[n] / k for n, k in found.items()):
                found = heavy
            index = np.fromiter((at[n] for n in found), np.int64, len(found))
            if not first and gained[index].max() >= 1:
                misses += 1
                if misses == MISSES:
                    break  # what these have in common is covered for now; it takes other prices to go on
                continue
            pieces = np.fromiter(found.values(), float, len(found))
            n = float((demand[index] / pieces).min())
            key = tuple(sorted(found.items(), reverse=True))
            uses[key] = uses.get(key, 0.0) + n
            gained[index] += n * pieces / demand[index]
            total += n
        share += gained
        scale = float(share.min())
        if scale > 0 and total / scale <= (1 + gap) * bound:
            return {c: n / scale for c, n in uses.items()}, bound


def rounded(cover: dict[tuple, float], histogram: dict[int, int], capacity: int) -> Counter:
    """A whole plan: ``cover`` rounded down, no piece used twice, and best fit for the leftover."""
    left, plan = Counter(histogram), Counter()
    for used, n in sorted(cover.items(), key=lambda item: (-item[1], item[0])):
        n = min(int(n + 1e-9), *(left[length] // k for length, k in used))
        if n > 0:
            plan[used] += n
            left.subtract({length: n * k for length, k in used})
    return best_fit(plan, +left, capacity)


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations ((length, pieces), ...) and how many sequences have each."""
    if not histogram:
        return []
    cover, _ = fractional_cover(histogram, capacity)
    return sorted(rounded(cover, histogram, capacity).items(), reverse=True)


# --- 3. pieces into the plan --------------------------------------------------------------


def plan_table(spark, plan: list) -> DataFrame:
    """Per length its runs of sequences: numbers from ``first`` on, ``each`` of them per sequence."""
    runs: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for configuration, n in plan:
        offset = 0
        for length, each in configuration:
            runs.setdefault(length, []).append((used[length], each, sequence, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    schema = "of_length bigint, runs array<struct<first: bigint, each: bigint, sequence: bigint, offset: bigint>>"
    return spark.createDataFrame(sorted(runs.items()), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of :func:`token_pieces`) with sequence_id and offset."""
    names = pieces.columns
    # Repeated rows get different salts, so their pieces are dealt to different groups. Stored before it is used.
    pieces = written(pieces.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16))))
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    plan = packing_plan({r["length"]: r["n"] for r in counts}, capacity)
    counted = numbered_within(pieces, sum(r["n"] for r in counts), ["length"], ["doc_id", "piece", "ids_crc32", "_salt"])
    placed = counted.join(plan_table(pieces.sparkSession, plan), F.col("length") == F.col("of_length"))
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("number")), -1)
    placed = placed.withColumn("run", run).withColumn("over", F.col("number") - F.col("run.first"))
    return placed.select(
        *names,
        (F.col("run.sequence") + F.floor(F.col("over") / F.col("run.each"))).cast("bigint").alias("sequence_id"),
        (F.col("run.offset") + F.col("over") % F.col("run.each") * F.col("length")).cast("bigint").alias("offset"),
    )


def word_file() -> str:
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def pack_documents(docs: DataFrame, description: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, description or word_file(), capacity), capacity)
