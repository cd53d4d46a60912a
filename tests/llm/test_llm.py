"""Every training-data operator against a brute-force version, and its odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tickscope.llm import (
    byte_bpe, common, line_dedup, near_dup, neighbours, packing, pii, quality, shards, token_counts, toxicity,
)

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PIECES = [
    "the", "of the and", "  ", "\n", "\t", "it's", "<|endoftext|>", "é", "中文", "😀", "0", "12", "!?", "\x1c", "\xa0",
    "İ", "Σ", "x" * 50, "\x00", "a@b.c", "_d@e.f", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (456) 555-2186",
    "(456) 555-2186", "tel: ", "john at mail dot com", "+", ".", "###", "|", "THE", "same line\n", "\x0b", "́",
]


def odd_texts(n: int = 300) -> list:
    rnd = random.Random(5)
    made = ["".join(rnd.choice(PIECES) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return [None, "", " ", "\n", "x" * 100_000, "a b " * 20_000, *made, *made[:20]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, random.Random(i).choice(["en", "de", None, "xx"]), "s", None) for i, t in enumerate(odd_texts())]
    rows += [rows[9], rows[9], (None, "null id", "en", "s", 1), (None, None, None, None, None)]
    # Extra columns whose names the operators use themselves.
    extra = "kept, shard, node, number, key, a, b, n_tokens, quality, _row, _spans, value"
    frame = spark.createDataFrame(rows, DOC)
    return frame.selectExpr("*", *[f"1 AS {c}" for c in extra.split(", ")]).repartition(5).persist()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def rows_of(frame, *columns):
    return collections.Counter(tuple(r) for r in frame.select(*columns).collect())


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(token_counts.gpt_file())
    want = collections.Counter()
    for i, t in texts:
        n = len(whole.encode(t, add_special_tokens=False))
        want[i, len(t.encode()), n, n > 512] += 1
    got = token_counts.token_counts(docs, token_counts.gpt_file())
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_byte_bpe(docs, texts):
    import tiktoken

    ranks = byte_bpe.gpt_ranks()
    plain = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, t in texts:
        ids = np.array(plain.encode_ordinary(t), "<u4").tobytes()
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    got = byte_bpe.encode_decode(docs, ranks, token_counts.PATTERN)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(packing.word_file())
    want = collections.Counter()
    for i, t in texts:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k:k + 2048], "<u4")
            want[i, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack_documents(docs).persist()
    assert rows_of(got, "doc_id", "piece", "start", "length", "ids_crc32") == want
    places = collections.defaultdict(list)
    for r in got.collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n * k for (_, _, _, n, _), k in want.items())
    assert len(places) <= 1.05 * -(-total // 2048) + 2


def test_covers_are_within_their_gap_and_cover():
    rnd = random.Random(7)
    spread = dict(collections.Counter(rnd.randint(1, 2048) for _ in range(3000)))
    for histogram in (spread, {2048: 5}, {1: 4}, {683: 10 ** 6, 1: 3}, {1025: 7, 1023: 3}, {1053: 6000, 570: 6000, 540: 6000, 453: 12_000},
                      {145: 61_117, 83: 10, 157: 7284, 183: 8, 335: 732_637}):
        cover, bound = packing.fractional_cover(histogram, 2048)
        had = collections.Counter()
        for configuration, n in cover.items():
            assert n > 0 and sum(length * k for length, k in configuration) <= 2048
            for length, k in configuration:
                had[length] += n * k
        assert all(had[length] >= n * (1 - 1e-9) for length, n in histogram.items())
        tokens = sum(length * n for length, n in histogram.items()) / 2048
        assert tokens <= bound * (1 + packing.GAP) and sum(cover.values()) <= (1 + packing.GAP) * bound
        plan = packing.rounded(cover, histogram, 2048)
        assert plan.total() >= bound * (1 - 1e-9)
    assert packing.packing_plan({}) == []


def test_packing_plans_beat_greedy_ones():
    rnd = random.Random(1)
    histogram = dict(collections.Counter(rnd.randint(500, 1100) for _ in range(20_000)))
    plan = packing.packing_plan(histogram)
    used = collections.Counter()
    for configuration, n in plan:
        assert sum(length * k for length, k in configuration) <= 2048
        for length, k in configuration:
            used[length] += n * k
    assert used == collections.Counter(histogram)
    assert sum(n for _, n in plan) <= sum(packing.best_fit(collections.Counter(), histogram, 2048).values())


def test_packing_plans_without_exact_fills():
    # All lengths are multiples of 3, so no configuration has 2048 tokens; 9,000 sequences suffice.
    histogram = {1053: 6000, 570: 6000, 540: 6000, 453: 12_000}
    plan = packing.packing_plan(histogram)
    used = collections.Counter()
    for configuration, n in plan:
        assert n > 0 and sum(length * k for length, k in configuration) <= 2048
        for length, k in configuration:
            used[length] += n * k
    assert used == collections.Counter(histogram)
    assert sum(n for _, n in plan) <= 1.03 * 9000


def test_quality_base_measures(docs, texts):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = collections.Counter()
    for i, t in texts:
        w = word.findall(t)
        seen = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if word.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed] += 1
    got = quality.quality_table(docs)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.where("base_failed AND kept").isEmpty()


def test_quality_verdicts(spark):
    rnd = random.Random(2)
    words = "the of and to in is that it for was on are as by with house river stone paper light".split()
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(["", "", "", "", ".", ","]) for _ in range(120)), "en", "s", 0) for i in range(60)]
    rows.append((100, " ".join(f"{rnd.choice(words).upper()}!!" for _ in range(120)), "en", "s", 0))
    rows.append((101, " ".join(f"{rnd.choice(words)}%%%" for _ in range(120)), "en", "s", 0))
    kept = quality.good_documents(spark.createDataFrame(rows, DOC))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == set(range(60))


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def test_line_dedup(docs, texts):
    found = collections.defaultdict(set)
    for i, t in texts:
        for x in t.split("\n"):
            found[lower(x.strip(" \t\n\x0b\x0c\r"))].add(i)
    want = collections.Counter()
    for i, t in texts:
        lines = t.split("\n")
        kept = [x for x in lines if not (k := lower(x.strip(" \t\n\x0b\x0c\r"))) or len(found[k]) < 10]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert sum(n for _, _, n, _ in want) > 0
    assert rows_of(line_dedup.line_dedup_table(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_near_dedup(spark, docs):
    rnd = random.Random(3)
    base = [[rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(80)] for _ in range(12)]
    rows = [(i, t or "") for i, t in enumerate(odd_texts(60))]
    for k in range(240):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 9)):
            words[rnd.randrange(80)] = str(rnd.random())
        rows.append((1000 + k, " ".join(words)))
    rnd.shuffle(rows)
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = collections.Counter((i, len(sets[i]), find(i), find(i) == i) for i in ids)
    got = near_dup.near_dup_table(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == want
    stage = near_dup.one_of_each(docs)
    assert stage.columns == docs.columns and stage.where("doc_id IS NULL").count() == 2


def test_different_texts_under_one_id_keep_their_links(spark):
    rnd = random.Random(8)
    rows, want = [], collections.Counter()

    def text(n):
        return [f"w{rnd.randrange(10 ** 6)}" for _ in range(n)]

    for k in range(12):
        one, two = text(60), text(90 + k)
        # Ids a < b < c: b has two texts, a is near its first one and c near its second one.
        a, b, c = 10 * k, 10 * k + 1, 10 * k + 2
        group = [(a, [*one, "x"], a), (b, one, a), (b, two, b), (c, [*two, "y"], b)]
        rows += [(i, " ".join(w)) for i, w, _ in group]
        want.update((i, len(w) - 1, component, i == component) for i, w, component in group)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dup.near_dup_table(frame)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == want
    kept = near_dup.one_of_each(frame, width=2)
    assert rows_of(kept, "doc_id", "text") == collections.Counter(
        row for row, i in zip(rows, range(len(rows))) if i % 4 in (0, 2))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[:max(1, n * 9 // 10)], rng.integers(0, 1 << 63, n // 10).astype(np.uint64)]))
        x, y = near_dup.sketches([a, b])
        assert not (x == np.uint64(near_dup.ALL_ONES)).any()
        assert abs((x == y).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.1


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_parity_bitmaps_never_exceed_the_difference():
    some = np.random.default_rng(5)
    empty = np.zeros(0, np.uint64)
    assert near_dup.parity_bitmaps([]).shape == (0, near_dup.PARITY)
    assert not near_dup.parity_bitmaps([empty]).any()
    for size in (1, 40, 900, 20_000):
        pool = np.unique(near_dup.mix(some.integers(0, 1 << 62, 2 * size).astype(np.uint64)))
        a, b = np.unique(some.choice(pool, size)), np.unique(some.choice(pool, size))
        x, y = near_dup.parity_bitmaps([a, b])
        differing = sum(int(w).bit_count() for w in (x ^ y).view(np.uint64))
        assert differing <= len(np.setxor1d(a, b))
        assert (near_dup.parity_bitmaps([a, empty, a])[2] == x).all()
        if size == 40:  # few shingles in many bits: close to exact
            assert differing >= 0.8 * len(np.setxor1d(a, b))


def test_pii(docs, texts):
    want = collections.Counter()
    for i, t in texts:
        spans = base_spans(t)
        n = collections.Counter(s[0] for s in spans)
        text = ",".join("%s:%d:%d" % s for s in spans)
        want[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest()] += 1
    got = pii.pii_table(docs).persist()
    assert rows_of(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    for i, t in texts:
        if i is not None:
            assert {"%s:%d:%d" % s for s in base_spans(t)} <= set(spans[i].split(","))
    hidden = pii.masked(docs)
    assert hidden.columns == docs.columns and hidden.count() == docs.count()
    left = [r["text"] for r in hidden.collect() if r["text"]]
    assert not any(kind == "email" for t in left for kind, _, _ in base_spans(t))


def test_spelled_out_addresses_are_left_to_the_classifier(spark):
    spelled = {
        "write to jane at example dot org today": (9, 32), "jane (at) example (dot) org": (0, 27),
        "mail: bob.ray at site dot de": (6, 28),
    }
    numbers = ["card 4111 1111 1111 1112", "host 1.2.3.456"]  # fail their checksum and range
    clear = ["mail a.b@c.com now", "see x@y.org", "call +1 (456) 555-2186"] * 20
    texts = [*spelled, "we met at noon dot matrix", *numbers, *clear]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.pii_table(docs).collect()}
    hidden = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    for i, (text, (start, end)) in enumerate(spelled.items()):
        assert (got[i]["spans"], got[i]["n_added"]) == (f"email:{start}:{end}", 1)
        assert hidden[i] == text[:start] + "<EMAIL>" + text[end:]
    for i, text in list(enumerate(texts))[len(spelled):len(spelled) + 1 + len(numbers)]:
        assert got[i]["n_added"] == 0 and hidden[i] == text


def test_candidates_apart_from_others(spark):
    rnd = random.Random(10)

    def spans(n):
        out, at = [], 0
        for _ in range(n):
            at += rnd.randint(0, 6)
            end = at + rnd.randint(1, 9)
            out.append((rnd.randrange(4), at, end))
            at = end if rnd.random() < 0.8 else at
        return out

    rows = [(i, spans(rnd.choice([0, 1, 5, 40, 700])), spans(rnd.choice([0, 1, 5, 40, 700]))) for i in range(60)]
    kind = "array<struct<kind: int, start: bigint, end: bigint>>"
    frame = spark.createDataFrame(rows, f"id bigint, a {kind}, b {kind}")
    for r in pii.apart_from(frame, "a", "b", "free").collect():
        want = [tuple(x) for x in r["a"] if not any(y["start"] < x["end"] and x["start"] < y["end"] for y in r["b"])]
        assert sorted(tuple(x) for x in r["free"]) == sorted(want)


def test_a_text_of_thousands_of_spans_is_no_trouble(spark):
    import time

    rnd = random.Random(11)
    text = " ".join(f"u{rnd.randrange(10 ** 6)}@site.org (456) 555-{rnd.randrange(1000, 9999)} é" for _ in range(12_000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.time()
    row = pii.pii_table(docs).collect()[0]
    assert time.time() - began < 120
    spans = base_spans(text)
    assert row["n_email"] == 12_000 and row["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(4)
    clean, bad = [f"word{k}" for k in range(300)], ["grumblefoo", "zorkel", "zorkelst", "zorkelheit", "blaharg"]
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 60))]
        if i % 6 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad).upper() + "!")
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    rows += [(1001, None), (1002, ""), (None, "zorkel zorkel zorkel")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = toxicity.toxicity_table(documents, spark.createDataFrame(labels, "doc_id bigint, toxic int"), spans=True).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 150 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    for r in got:
        assert r["doc_id"] is None or r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        text = dict(rows)[r["doc_id"]] or ""
        assert r["doc_id"] in (1001, 1002) or all(text[s["start"]:s["end"]].strip("!").lower() in bad for s in r["spans"])


def test_chain_marginals_are_exact():
    import itertools

    rng = np.random.default_rng(1)
    model = toxicity.Model(transition=rng.normal(size=(2, 2)), start=rng.normal(size=2))
    lengths = np.array([1, 4, 3])
    score = rng.normal(size=8)
    p, _ = toxicity.marginals(model, score, lengths)
    at = 0
    for n in lengths:
        own, total = np.zeros(n), 0.0
        for states in itertools.product((0, 1), repeat=int(n)):
            w = model.start[states[0]] + sum(score[at + k] * s for k, s in enumerate(states))
            w = np.exp(w + sum(model.transition[a, b] for a, b in zip(states, states[1:])))
            own, total = own + w * np.array(states), total + w
        assert np.allclose(p[at:at + n], own / total)
        at += n


def test_shards(docs, texts):
    got = shards.shard_table(docs).persist()
    want = collections.Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts)
    assert rows_of(got, "doc_id", "size", "text_crc32") == want
    for r in got.groupBy("shard").agg({"slot": "max", "*": "count"}).collect():
        assert r["max(slot)"] + 1 == r["count(1)"] and 0 <= r["shard"] < 8


def test_shards_are_even_and_keep_texts_together(spark):
    rnd = random.Random(6)
    rows = [(i, "w " * rnd.randint(1, 400) + str(i % 1500)) for i in range(3000)]
    got = shards.shard_table(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() < 1.03 * sizes.mean()
    hot = spark.createDataFrame([(i, "same text") for i in range(900)] + rows[:50], "doc_id bigint, text string")
    sizes = shards.shard_table(hot).toPandas().groupby("shard")["size"].sum()
    assert len(sizes) == 8  # a group above a shard's size is split


def test_repeated_rows_are_spread_over_shards_and_groups(spark):
    rows = [(None, "one text")] * 1000 + [(7, "another")] * 1000
    placed = shards.shard_table(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas()
    sizes = placed.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() < 1.1 * sizes.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in placed.groupby("shard"))


def test_memos_do_not_keep_long_keys():
    memo = common.Memo(lambda keys: [len(k) for k in keys], half=10)
    for n in range(50):
        keys = {"a" * (65 + n), "b", f"c{n}"}
        table = memo.many(keys)
        assert {k: table[k] for k in keys} == {k: len(k) for k in keys}
        assert sum(len(k) > 64 for k in [*memo.young, *memo.old]) <= 2 and len(memo.young) <= 14


def test_masses_of_short_texts_are_sketched_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK_DOCS", 64)
    rows = [(i, f"w{i % 700}") for i in range(1400)] + [(2000 + i, "") for i in range(300)]
    got = near_dup.near_dup_table(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    want = collections.Counter((i, 1, i % 700, i < 700) for i in range(1400))
    want.update((2000 + i, 0, 2000 + i, True) for i in range(300))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == want


def test_toxicity_of_odd_texts(spark, docs, texts):
    known = [(i, int("0" in (t or ""))) for i, t in texts if i is not None]
    labels = spark.createDataFrame([*known, *known, (None, 1), (9, None), (10, 7)], "doc_id bigint, toxic int")
    long_one = spark.createDataFrame([(5000, "word " * 30_000), (5000, "other " * 30_000)], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text").unionByName(long_one)
    got = toxicity.toxicity_table(rows.selectExpr("*", "1 AS score", "2 AS toxic"), labels.unionByName(
        spark.createDataFrame([(5000, 0)], "doc_id bigint, toxic int")), spans=True).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter([*[i for i, _ in texts], 5000, 5000])
    by_text = {}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    for i, score in [(r["doc_id"], r["score"]) for r in got]:
        by_text.setdefault(i, set()).add(score)
    assert len(by_text[9]) == 1  # repeated rows
    sample = toxicity.training_sample(rows, labels, size=1000)
    ids = {i for i, _ in known if zlib.crc32(str(i).encode()) % 3 != 1}
    texts_of = {i: t for i, t in texts if t}
    assert len(sample) <= len(ids) + 1 and max(len(t) for t, _ in sample) == max(len(texts_of[i]) for i in ids if i in texts_of)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 24)).astype("float32") * rng.uniform(0.5, 2, size=(1500, 1)).astype("float32")
    v[100:300] = v[40]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    odd = [(2000, None, 0), (2020, [0.0] * 24, 0), (2040, [float("nan")] * 24, 0), (2060, [1.0], 0), (2080, [None] * 24, 0)]
    frame = spark.createDataFrame(rows + odd + [rows[3]], "vec_id bigint, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1500, 20))
    hits, x = 0, v.astype(float)
    for q, found in got.items():
        scores = x @ x[q]
        others = np.delete(np.arange(len(v)), q)
        want = others[np.lexsort((others, -scores[others]))][:20].tolist()
        assert [s for _, s in found] == pytest.approx([scores[i] for i, _ in found])
        hits += len(set(want) & {i for i, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    few = neighbours.nearest(spark.createDataFrame(rows[:6], frame.schema))
    assert few.count() == 5


@pytest.mark.parametrize("block_rows,n", [(64, 900), (1 << 14, 3000)])
def test_neighbours_of_ids_with_several_vectors(spark, monkeypatch, block_rows, n):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(n, 6)), 2)
    ids = [int(i) for i in rng.integers(0, n // 2, n)]  # most ids have more than one vector
    ids[:40] = [20] * 40
    extra = "rank, query_id, block, asks, score, vector"
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id bigint, embedding array<double>").selectExpr(
        "*", *[f"1 AS {c}" for c in extra.split(", ")])
    hits = total = 0
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in {i for i in ids if i % 20 == 0}:
        scores = v @ v[[k for k, i in enumerate(ids) if i == q]].T
        best = collections.defaultdict(lambda: -np.inf)
        for i, s in zip(ids, scores.max(axis=1)):
            if i != q:
                best[i] = max(best[i], s)
        want = sorted(best, key=lambda i: (-best[i], i))[:20]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and len({i for _, i, _ in own}) == 20
        assert [s for _, _, s in own] == sorted((s for _, _, s in own), reverse=True)
        assert all(s <= best[i] + 1e-9 for _, i, s in own)
        hits, total = hits + len(set(want) & {i for _, i, _ in own}), total + 20
    assert hits >= 0.9 * total


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    for frame in (
        token_counts.token_counts(none, token_counts.gpt_file()), packing.pack_documents(none), quality.quality_table(none),
        quality.good_documents(none), line_dedup.line_dedup_table(none), near_dup.near_dup_table(none), pii.pii_table(none),
        pii.masked(none), toxicity.toxicity_table(none, labels), shards.shard_table(none), neighbours.nearest(vectors),
        byte_bpe.encode_decode(none, byte_bpe.gpt_ranks(), token_counts.PATTERN),
    ):
        assert frame.count() == 0
