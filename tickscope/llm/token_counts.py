"""Token counts per document.

Within each Arrow batch every document is reduced to the frequencies of its
pre-tokens (words after a space stay whole until only distinct ones are left, then the
pattern cuts them). The pieces of each distinct pre-token are counted once by the library's
model, that table is looked up for the frequencies, and the products are summed;
ids of whole texts are never made. The batch is the unit because the pairs of
document and pre-token are about as many bytes as the texts: moving them through a
shuffle join costs more than the texts themselves (figures in the README).

Null or empty text: 0 tokens. Null ids and repeated rows pass through row by row.
Memory per task: one batch and a memo of bounded size.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import Memo, PreTokens, bound_batches, hash_of, ids_and_texts, kept_by_worker, tokenizer_file

LIMIT = 512
SPACE, CHUNK = "\u0120", 2000  # how byte-level vocabularies write a space; words encoded together
# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Beyond these code points the library's Unicode tables may be of another version.
RARE = r"[^\x00-՗ऀ-౛‐-⁞　-鿿가-힣]"


class PieceCounter:
    """Counts tokens with a ``tokenizers`` file of byte-level BPE."""

    def __init__(self, description: str):
        import regex
        from tokenizers import Tokenizer

        parts = json.loads(description)
        self.whole = Tokenizer.from_str(description)
        self.plain_shape = (
            parts["normalizer"] is None
            and parts["pre_tokenizer"] == {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in parts["added_tokens"])
        )
        parts["added_tokens"], parts["truncation"], parts["padding"] = [], None, None
        self.spacing = Tokenizer.from_str(json.dumps(parts))
        parts["pre_tokenizer"]["use_regex"] = False
        self.model = Tokenizer.from_str(json.dumps(parts))
        added = [a["content"] for a in json.loads(description)["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        vocabulary = self.model.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token[0] == SPACE]] = True
        self.cut, self.rare = PreTokens(PATTERN), regex.compile(RARE).search
        self.pieces = Memo(lambda words: [len(e) for e in self.model.encode_batch_fast(words, add_special_tokens=False)])
        self.spaced = Memo(self._spaced)

    def _spaced(self, words: list[str]) -> list[int]:
        """Pieces of each spaced word: many are encoded in one text, and only their first piece has the space."""
        out: list[int] = []
        texts = [" " + " ".join(words[i:i + CHUNK]) for i in range(0, len(words), CHUNK)]
        for found in self.spacing.encode_batch_fast(texts, add_special_tokens=False):
            starts = np.flatnonzero(self.begins[found.ids])
            out += np.diff(starts, append=len(found)).tolist()
        return out

    def frequencies(self, text: str) -> tuple[Counter, Counter, int]:
        """Frequencies of pre-tokens and of spaced words, and the number of added tokens between."""
        segments = [text] if self.added is None else self.added.split(text)
        bare, spaced = Counter(), Counter()
        for segment in segments:
            first, rest = self.cut.units(segment)
            bare.update(first)
            spaced.update(rest)
        return bare, spaced, len(segments) - 1

    def counts(self, texts: list[str]) -> list[int]:
        kept = []
        for text in texts:
            if self.plain_shape and not self.rare(text):
                kept.append(self.frequencies(text))
            else:
                kept.append((Counter(), Counter(), len(self.whole.encode(text, add_special_tokens=False))))
        pieces = self.pieces.many(set().union(*(bare for bare, _, _ in kept)))
        spaced = self.spaced.many(set().union(*(words for _, words, _ in kept)))
        return [
            more + sum([n * pieces[t] for t, n in bare.items()]) + sum([n * spaced[t] for t, n in words.items()])
            for bare, words, more in kept
        ]


def token_counts(docs: DataFrame, description: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; ``description`` is a tokenizer file's text."""
    spark = docs.sparkSession
    bound_batches(spark)
    name = f"pieces {hash_of(description)}"
    sent = spark.sparkContext.broadcast(description)  # a vocabulary, about 1.5 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_by_worker(name, lambda: PieceCounter(sent.value))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counter.counts(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = ids_and_texts(docs).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    counted = rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def gpt_file() -> str:
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()
