"""The pipeline's stages and its run against plain Python, on the smallest documents and some odd rows."""

from __future__ import annotations

import collections
import math
import os
import re
import zlib

import numpy as np
import pytest
import regex

import corpus_pipeline
from tests.llm.test_llm import base_spans, lower
from tickscope.llm import packing, pii, quality
from tickscope.llm.common import written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest documents with null, empty and repeated rows, at a place of their own."""
    place = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("lang = 'en' AND length(text) BETWEEN 400 AND 3000").orderBy("doc_id").limit(1)
    odd = spark.createDataFrame([(90_000, None), (90_001, ""), (None, "short"), (90_002, "x " * 3000)], "doc_id bigint, text string")
    docs.unionByName(clean).unionByName(odd, allowMissingColumns=True).coalesce(2).write.parquet(f"{place}/documents.parquet")
    return place


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents, and what each stage makes of what the one before kept."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir)))
    return out


def rows_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def jensen_shannon(p, q):
    def part(x, m):
        return x * math.log2(x / m) if x > 0 else 0.0

    return math.sqrt(max(0.0, sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(p, q)) / 2))


def plain_quality(rows):
    """(kept, class distance, word distance) of (text, lang) rows."""
    facts = []
    for text, lang in rows:
        text, lang = text or "", lang if lang in quality.COMMON_WORDS else ""
        words = WORD.findall(text)
        seen = collections.Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if seen[tuple(words[k:k + 5])] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        marked = [len(regex.findall(c, text)) for c in quality.CLASSES]
        letters = sum(map(len, words))
        classes = [*marked, len(text) - letters, letters - sum(marked)]
        known = quality.COMMON_WORDS.get(lang, [])
        counts = [words.count(k) for k in known]
        counts.append(len(words) - sum(counts))
        facts.append((lang, failed, len(text), len(words), [n / max(1, sum(classes)) for n in classes],
                      [n / max(1, sum(counts)) for n in counts]))
    mean = {}
    for lang in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == lang and not f[1]]
        if own:
            mean[lang] = [np.mean([f[k] for f in own], axis=0).tolist() for k in (4, 5)]
    out = []
    for lang, failed, n_chars, n_words, classes, words in facts:
        known = mean.get(lang)
        # Where no document of a language passes the base rules there is nothing to be far from.
        by_class = (jensen_shannon(classes, known[0]) if known else 0.0) if n_chars >= quality.MIN_CHARS else None
        by_word = (jensen_shannon(words, known[1]) if known else 0.0) if lang and n_words >= quality.MIN_COMMON_WORDS else None
        kept = not failed and (by_class or 0) <= quality.MAX_CLASS_DISTANCE and (by_word or 0) <= quality.MAX_WORD_DISTANCE
        out.append((kept, by_class, by_word))
    return out


def test_quality_distances_and_verdicts(spark, sf_dir, stages):
    docs = stages[0].select("doc_id", "text", "lang").collect()
    want = plain_quality([(r["text"], r["lang"]) for r in docs])
    key = collections.Counter((r["doc_id"], k, *(None if x is None else round(x, 9) for x in (c, w))) for r, (k, c, w) in zip(docs, want))
    got = collections.Counter((r["doc_id"], r["kept"], *(None if x is None else round(x, 9) for x in (r["class_distance"], r["word_distance"])))
                              for r in quality.quality_table(stages[0]).collect())
    assert got == key and 0 < sum(k for k, _, _ in want) < len(want)
    assert any(c is not None and c > quality.MAX_CLASS_DISTANCE or w is not None and w > quality.MAX_WORD_DISTANCE for _, c, w in want)
    kept = collections.Counter((r["doc_id"], r["text"]) for r, (k, _, _) in zip(docs, want) if k)
    assert collections.Counter(rows_of(stages[1])) == kept


def test_line_stage(stages):
    docs, found = rows_of(stages[1]), collections.defaultdict(set)
    for i, text in docs:
        for line in text.split("\n"):
            found[lower(line.strip(" \t\n\x0b\x0c\r"))].add(i)
    want = collections.Counter()
    for i, text in docs:
        lines = [x for x in text.split("\n") if not (k := lower(x.strip(" \t\n\x0b\x0c\r"))) or len(found[k]) < 10]
        want[i, "\n".join(lines)] += 1
    assert collections.Counter(rows_of(stages[2])) == want


def test_near_copy_stage(stages):
    docs = rows_of(stages[2])
    sets = []
    for _, text in docs:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(docs)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    members = collections.defaultdict(list)
    for k in range(len(docs)):
        members[find(k)].append(docs[k])
    want = collections.Counter()
    for m in members.values():
        first = min(m, key=lambda d: d[0])
        want[first] += m.count(first)  # repeated rows of the document that stays all stay
    got = rows_of(stages[3])
    assert collections.Counter(got) == want
    assert len(got) < len(docs)


def test_personal_data_stage(stages):
    docs = {i: t for i, t in rows_of(stages[3])}
    found = {r["doc_id"]: r["spans"] for r in pii.pii_table(stages[3]).collect()}
    hidden, changed = dict(rows_of(stages[4])), 0
    assert hidden.keys() == docs.keys()
    for i, text in docs.items():
        spans = [(kind, int(a), int(b)) for kind, a, b in (s.split(":") for s in found[i].split(",") if s)]
        assert set(base_spans(text)) <= set(spans)
        out, at, merged = "", 0, []
        for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2], pii.KINDS.index(s[0]))):
            if merged and a < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], b)
            else:
                merged.append([kind, a, b])
        for kind, a, b in merged:
            out, at = out + text[at:a] + f"<{kind.upper()}>", b
        assert hidden[i] == out + text[at:]
        changed += hidden[i] != text
    assert changed


def test_packing_stage_and_the_whole_run(spark, sf_dir, stages):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(packing.word_file())
    want = collections.Counter()
    for i, text in rows_of(stages[4]):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k:k + 2048], "<u4")
            want[i, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert collections.Counter(tuple(r) for r in stages[5].select(*columns).collect()) == want
    assert sum(n * k for (_, _, _, n, _), k in want.items()) <= 2048 * stages[5].select("sequence_id").distinct().count()
    run = corpus_pipeline.run(spark, sf_dir)
    assert run.columns == stages[5].columns
    assert collections.Counter(tuple(r) for r in run.select(*columns).collect()) == want
    for frame in stages[1:5]:
        assert frame.columns == stages[0].columns
