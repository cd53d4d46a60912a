"""Lexical search, whitening and chat formatting against brute force, and their odd inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import odd_texts
from tickscope.llm import chat_format, lexical, whitening

# ---- lexical search -----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=20):
    """(item_id, rank, doc_id, score) by the definition."""
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        uses, scored = collections.Counter(terms(text)), []
        for i, c in counted:
            m = 75 + (25 * sum(c.values()) * n_docs) // length
            score = sum(
                n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, n in uses.items() if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scored)[:top], 1)]
    return collections.Counter(out)


def found(frame):
    return collections.Counter(tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("block_docs,items_at_once", [(4096, 512), (37, 7)])
def test_search_equals_scoring_every_document(spark, monkeypatch, block_docs, items_at_once):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(lexical, "ITEMS", items_at_once)
    rnd = random.Random(1)
    words = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(3000)]
    docs = list(enumerate(odd_texts(120)))
    docs += [(1000 + k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for k in range(500)]
    docs += [docs[-1], docs[-1], (None, docs[-1][1]), (None, None), (None, "null id the")]
    docs += [(5000 + k, "one copied text of many words w1 w2") for k in range(60)]  # ties beyond the list
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))) for k in range(20)]
    items += [(50, docs[200][1]), (51, None), (52, ""), (53, "?!"), (54, "absent nowhere"), (50, "copied TEXT copied"), items[0],
              (None, "the of and it's é"), (55, " ".join(words))]
    extra = "score, rank, item_id, terms"
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr(
        "*", *[f"1 AS {c}" for c in extra.split(", ")]).repartition(7)
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id", "2 AS query")
    got = lexical.ranked(frame, asked)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    want = plain_search(docs, [(i, t) for i, t in items if t is not None])
    assert found(got) == want
    assert sum(n for (i, *_), n in want.items() if i == 55) == 20


def test_empty_tables_give_no_results(spark):
    docs, items = "doc_id bigint, text string", "item_id bigint, text string"
    some = spark.createDataFrame([(1, "a b")], docs)
    assert lexical.ranked(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a")], items)).count() == 0
    assert lexical.ranked(some, spark.createDataFrame([], items)).count() == 0
    assert lexical.ranked(spark.createDataFrame([(1, None), (2, "?")], docs), spark.createDataFrame([(1, "a")], items)).count() == 0


def block_of(rnd, n_docs, n_terms, uses):
    """Postings in which two halves of the terms seldom meet."""
    queries = lexical.Queries.__new__(lexical.Queries)
    queries.terms, queries.item_ids, queries.uses = [str(t).encode() for t in range(n_terms)], [0], [uses]
    queries.weigh({t: 5 for t in range(n_terms)}, 10 * n_docs, 400 * n_docs)
    own = [sorted(rnd.sample(range(0, n_docs, 2) if t % 2 else range(1, n_docs, 2), n_docs // 8) + [rnd.randrange(n_docs)]) for t in range(n_terms)]
    own = [sorted(set(o)) for o in own]
    row = {
        "doc_ids": list(range(n_docs)), "lengths": [rnd.randint(1, 80) for _ in range(n_docs)], "ids": list(range(n_terms)),
        "counts": [len(o) for o in own], "docs": np.concatenate([np.array(o, np.uint16) for o in own]).tobytes(),
        "tfs": np.array([rnd.randint(1, 6) for o in own for _ in o], np.int32).tobytes()}
    return queries, lexical.Postings(row, queries)


def test_pair_bounds_hold_and_skip_more_than_independent_ones():
    rnd, skipped = random.Random(3), collections.Counter()
    for trial in range(60):
        uses = {t: rnd.randint(1, 3) for t in range(rnd.randint(1, 9))}
        queries, postings = block_of(rnd, 200, len(uses), uses)
        lists = postings.lists(queries)
        joint = {p: most for p, (_, most) in lists.items()}
        dense = np.zeros((len(uses), 200), np.int64)
        for t, (docs, impact) in postings.of.items():
            dense[t, docs] = impact
        for (a, b), pair in queries.pairs.items():
            both = (dense[a] > 0) & (dense[b] > 0)
            assert joint.get(pair, 0) == (dense[a] + dense[b])[both].max(initial=0)
            assert set(lists[pair][0].tolist() if pair in lists else []) == set(np.flatnonzero(both).tolist())
            for ua, ub in ((1, 1), (3, 1), (2, 5)):
                real = (ua * dense[a] + ub * dense[b]).max()
                alone = ua * int(postings.most[a]) + ub * int(postings.most[b])
                bound = lexical.pair_bound(ua, ub, int(postings.most[a]), int(postings.most[b]), joint.get(pair, 0))
                assert real <= bound <= alone
        scores = sum(n * dense[t] for t, n in uses.items())
        tight = lexical.bounded_units(uses, queries.units[0], postings.most, joint)
        loose = lexical.bounded_units(uses, queries.units[0], postings.most, joint, pairwise=False)
        assert scores.max() <= sum(b for b, _ in tight) <= sum(b for b, _ in loose)
        for threshold in (1, int(np.median(scores)) + 1, int(scores.max()), int(scores.max()) + 1, sum(b for b, _ in tight) + 1):
            for name, units in (("tight", tight), ("loose", loose)):
                docs, own = lexical.search_block(postings, uses, units, threshold)
                assert docs.tolist() == np.flatnonzero(scores >= threshold).tolist() and own.tolist() == scores[docs].tolist()
                reach = np.cumsum([b for b, _ in units])
                skipped[name] += int(reach[-1] < threshold)
                skipped[name] += sum(len(units[k][1]) for k in range(int(np.searchsorted(reach, threshold))))
    assert skipped["tight"] > skipped["loose"]


# ---- whitening ----------------------------------------------------------------------------------


def test_factorisation_and_rotations_against_numpy():
    rng = np.random.default_rng(1)
    for size, rank in ((1, 1), (2, 2), (7, 7), (20, 20), (20, 5), (33, 33)):
        factor = rng.normal(size=(size, rank)) * np.logspace(0, -4, rank)
        matrix = factor @ factor.T
        lower = whitening.pivoted_cholesky(matrix)
        assert lower.shape[1] <= rank and np.allclose(lower @ lower.T, matrix, atol=1e-12 * matrix.max())
        columns = whitening.orthogonalised(lower)
        gram = columns.T @ columns
        off = gram - np.diag(gram.diagonal())
        assert np.abs(off).max(initial=0) <= 1e-13 * np.sqrt(np.outer(gram.diagonal(), gram.diagonal())).max()
        values, vectors = whitening.eigen(matrix)
        want = np.linalg.eigvalsh(matrix)[::-1][:len(values)]
        assert np.allclose(values, want, rtol=1e-8, atol=1e-14 * want[0])
        assert np.allclose(matrix @ vectors, vectors * values, atol=1e-12 * want[0])
    assert whitening.eigen(np.zeros((3, 3)))[0].size == 0


def plain_whitening(rows, top=4):
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:top]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}
    white = {i: (np.array(v) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order]) for i, v in x.items()}
    return n, deviation, white, values[order] / values.sum()


def test_whitening_equals_an_eigendecomposition(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(400, 9)) * np.linspace(3, 0.2, 9)) @ np.linalg.qr(rng.normal(size=(9, 9)))[0]
    v = v.astype("float32")
    v[50:250] = v[7]  # copies weigh once
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, []), (902, [float("nan")] * 9), (903, [None] * 9), (904, [1.0] * 8), (905, [float("inf")] + [0.0] * 8),
           (906, [1e30] + [0.0] * 8)]
    frame = spark.createDataFrame(rows + odd + [rows[3], (None, rows[4][1])], "vec_id bigint, embedding array<float>")
    frame = frame.selectExpr("*", "1 AS x", "2 AS n", "3 AS component").repartition(6)
    got = whitening.whitened(frame).collect()
    n, deviation, white, explained = plain_whitening(rows)
    assert n == 200 and collections.Counter(r["vec_id"] for r in got) == collections.Counter(
        {**{i: 4 for i in range(400)}, 3: 8, None: 4})
    signs = {}
    for r in got:
        own = 4 if r["vec_id"] is None else r["vec_id"]
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[own]
        assert r["explained"] == pytest.approx(explained[k], rel=1e-10) and r["identity_error"] < 1e-10
        signs.setdefault(k, math.copysign(1, r["whitened"] * white[own][k]))
        assert r["whitened"] * signs[k] == pytest.approx(white[own][k], abs=1e-9)


def test_whitening_of_few_equal_and_no_vectors(spark):
    shape = "vec_id bigint, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], shape)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], shape)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(5)], shape)
    rows = whitening.whitened(line).collect()  # one direction
    assert len(rows) == 5 and {r["component"] for r in rows} == {1} and rows[0]["explained"] == pytest.approx(1)
    huge = spark.createDataFrame([(i, [2.0 ** 37 * i]) for i in range(2)], shape)
    assert [r["deviation"] for r in whitening.whitened(huge).collect()] == [None, None]


# ---- chat formatting ----------------------------------------------------------------------------

CHAT = "conv_id bigint, turn bigint, role string, text string"
MARKS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>", "\\", "<", "[", "<\\s>",
         "[\\\\INST]", " ", "\n", "x", "é", "😀", "]", ">", "/", "INST]", "s>"]


def chats():
    rnd = random.Random(2)
    rows = []
    for conv in range(150):
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant", "system", "tool", "", None, "<<TEXT>>", "a\nb", "[INST]"])
            text = rnd.choice([None, "", " ", "".join(rnd.choice(MARKS) for _ in range(rnd.randint(0, 25)))])
            rows.append((conv, turn, role, text))
    rows += [(None, 0, "user", "a null conversation"), (None, None, "assistant", "no turn"), (200, None, "user", "b"), (200, 0, "user", "a")]
    rows += [(300, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(3000)]
    rows += [(400, 1, "assistant", "twice"), (400, 1, "assistant", "twice"), (401, 0, "assistant", "long [INST] " * 30_000)]
    rnd.shuffle(rows)
    return rows


def told(rows):
    """conv_id -> n_turns, turns_sha256, loss_chars, loss_sha256 from the source."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        learned = "".join(x for _, _, r, x in own if r == "assistant")
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_conversations_are_read_back_from_the_formatted_text(spark):
    rows = chats()
    frame = spark.createDataFrame(rows, CHAT).selectExpr("*", "1 AS part", "2 AS segment", "3 AS loss").repartition(5)
    want = told(rows + [(-1, 0, "user", chat_format.CONFLICT), (-1, 1, "assistant", chat_format.CONFLICT)])
    got = {r["conv_id"]: r for r in chat_format.chat_table(frame).collect()}
    assert {i: tuple(r)[1:5] for i, r in got.items()} == want
    # The general form: stored parts of bounded length, sorted again by whoever reads them.
    parts = chat_format.formatted(frame, part_chars=500).persist()
    again = {r["conv_id"]: tuple(r)[1:] for r in chat_format.digests(parts.repartition(3)).collect()}
    assert again == {i: tuple(r)[1:] for i, r in got.items() if i != -1}
    assert parts.where("conv_id = 300").count() > 50
    for r in parts.where("conv_id < 150").orderBy("conv_id", "part").collect():
        for span in r["loss"]:
            inside = r["text"][span["start"] - r["start"]:span["end"] - r["start"]]
            assert r["text"][:span["start"] - r["start"]].endswith("<s> ") and r["text"][span["end"] - r["start"]:].startswith(" </s>")
            assert not re.search(r"<s>|</s>|\[/?INST\]|<</?SYS>>|<</?ROLE>>|<<TEXT>>", inside)
    turns = chat_format.rendered_turns(frame)
    plain = turns.where(~F.col("segment").rlike(r"\\")).where("escape_rounds > 0")
    assert plain.isEmpty() and not turns.where("escape_rounds = 0").isEmpty()


def test_no_conversations_give_the_conflicting_one_alone(spark):
    got = chat_format.chat_table(spark.createDataFrame([], CHAT)).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got] == [(-1, 2, len(chat_format.CONFLICT))]
    assert chat_format.formatted(spark.createDataFrame([], CHAT)).count() == 0


def test_the_grammar_is_checked_and_refuses_what_it_did_not_make():
    grammar = chat_format.Grammar(chat_format.Template())
    for role, text in (("user", "a"), ("tool", "</s>"), ("", ""), ("assistant", "\\<\\s>")):
        segment, begin, end, rounds = grammar.rendered(role, text)
        assert grammar.turn(segment)[:2] == (role, text) and rounds == (2 if role == "<<TEXT>>" else int("s>" in text))
        for cut in range(len(segment)):  # a turn that is not whole yet
            assert grammar.turn(segment[:cut]) is None
    for bad in ("plain text", "[INST] a </s>\n........", "<</SYS>> .......", "[INST]a [/INST]\n.......", "[INST] a[/INST]\n......", "[INST] a [/INST]x......"):
        with pytest.raises(chat_format.Malformed):
            grammar.turn(bad)
    for roles in ((("user", "<a>", "<a>"),), (("user", "<a>", "a>b"),), (("user", "<a>", "<ab"), ("x", "b<a", "zz")), (("user", "<a b>", "ee"),),
                  (("user", "x", "yy"),), (("user", "<\\a>", "yy"),)):
        with pytest.raises(ValueError):
            chat_format.Template(roles=roles)
