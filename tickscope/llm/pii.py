"""Personal data by weak supervision.

Candidates are the base patterns' matches and matches of looser patterns (spelled-out
addresses, national phone numbers, card numbers next to other digits, versions read as
addresses). Labelers vote on each: shape (regex), checksum or range, gazetteer of
prefixes and endings, context words before it, and what touches it. Expectation
maximisation on the counts of vote patterns estimates how reliable each labeler is,
and with the probabilities it gives, a logistic span classifier is trained on the kind,
the votes and products of votes, with rare patterns counting for more than their number.
It decides on the loose candidates; base matches stay. The effort of a text grows with
its length and the number of its spans, not with their product.

Texts and votes are handled by built-in expressions alone. Only counts of vote
patterns reach the driver: 3 values for each of 5 labelers in 4 kinds, 972 rows at most.

Null or empty text: no spans. Null ids and repeated rows pass through row by row.
Positions are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import fresh, let, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "check", "gazetteer", "context", "edges")
ACCEPT, PRIOR, ROUNDS, STEPS = 0.9, 0.5, 50, 400
CONTEXT, BLOCK, WINDOW = 24, 256, 1024
FAR = 1 << 60
# The base patterns. A run of the first class can only match from its
# start or where the last match ended, which keeps long runs from being tried anew.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# Gazetteers and context words.
GAZETTEER = {
    "email": r"(?i)[. ](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|127\.|22[4-9]\.|2[34][0-9]\.|25[0-5]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6011|65)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|schreib|courriel|correo|escrib)\W{0,3}[^\n]{0,12}$",
    "ip": r"(?i)(?:\bip\b|host|server|addr|from|login)\W{0,3}[^\n]{0,8}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta)\W{0,3}[^\n]{0,12}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|anruf|appel|llam)\W{0,3}[^\n]{0,12}$",
}
AGAINST = r"(?i)(?:version|\bv|release|section|isbn|order|invoice|token|password|key|#)\W{0,3}$"


def before_each(numbers, step, zero: int):
    """``step`` folded over the numbers before each place. In blocks, as arrays are copied while they grow."""
    start = F.lit(zero).cast("bigint")

    def folded(values, first):
        started = F.struct(first.alias("so_far"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(values, started, lambda s, n: F.struct(
            step(s["so_far"], n).alias("so_far"), F.concat(s["all"], F.array(s["so_far"])).alias("all")))["all"]

    def blocked(values):
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK)),
            lambda b: F.slice(values, (b * BLOCK + 1).cast("int"), BLOCK))

        def whole(parts):
            totals = F.transform(parts, lambda p: F.aggregate(p, start, step))
            return let(folded(totals, start), lambda firsts: F.flatten(F.transform(
                parts, lambda p, i: folded(p, F.get(firsts, i)))))

        return let(blocks, whole)

    return let(numbers, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(F.array().cast("array<bigint>")))


def prefix_sums(numbers):
    return before_each(numbers, lambda a, n: a + n, 0)


def windows(text):
    """The text in pieces of WINDOW code points, so that no place in it is far from a start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))


def cut_out(pieces, begin, length):
    """``length`` code points of the text from ``begin`` (from 0) on; at most WINDOW of them."""
    at = F.floor(begin / WINDOW).cast("int")
    near = F.concat(F.coalesce(F.get(pieces, at), F.lit("")), F.coalesce(F.get(pieces, at + 1), F.lit("")))
    return F.substring(near, (begin - at * WINDOW + 1).cast("int"), length.cast("int"))


def apart_from(frame: DataFrame, spans: str, others: str, out: str) -> DataFrame:
    """``frame`` with ``out``: the spans of one column that none of another column's overlaps, in order.

    Both are put in one order by start. What began earlier reaches over a span if the
    largest end so far does, and what begins later lies in it if the next start does.
    Works column by column: nested in one expression it would be too deep to analyse.
    """
    every, reach, following = fresh(frame, "_every", "_reach", "_following")

    def ordered(which: int):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(which).alias("which"), x["end"].alias("end"), x.alias("span"))

    both = F.concat(F.transform(others, ordered(0)), F.transform(spans, ordered(1)))
    none = (F.size(spans) == 0) | (F.size(others) == 0)
    frame = frame.withColumn(every, F.sort_array(F.when(none, F.slice(both, 1, 0)).otherwise(both)))
    ends = F.transform(every, lambda x: F.when(x["which"] == 0, x["end"]).otherwise(F.lit(0)))
    starts = F.transform(F.reverse(every), lambda x: F.when(x["which"] == 0, x["start"]).otherwise(F.lit(FAR)))
    frame = frame.withColumns({
        reach: before_each(ends, lambda a, n: F.greatest(a, n), 0),
        following: F.reverse(before_each(starts, lambda a, n: F.least(a, n), FAR))})
    free = F.zip_with(F.zip_with(every, reach, lambda x, end: F.struct(
        x.alias("x"), ((x["which"] == 1) & (end <= x["start"])).alias("free"))), following, lambda y, start: F.struct(
            y["x"]["span"].alias("span"), (y["free"] & (start >= y["x"]["end"])).alias("free")))
    kept = F.transform(F.filter(free, lambda x: x["free"]), lambda x: x["span"])
    return frame.withColumn(out, F.when(none, F.col(spans)).otherwise(kept)).drop(every, reach, following)


SPAN = "array<struct<kind: int, start: bigint, end: bigint, value: string, before: string, after: string>>"


def matches(text, pieces, kind: int, pattern: str):
    """Leftmost matches, not overlapping, with their places; ``pieces``: the text's `windows`."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(m):
        lengths = F.transform(m, lambda x: F.length(x).cast("bigint"))
        gaps = let(parts, lambda p: F.transform(F.slice(p, 1, F.size(m)), lambda x: F.length(x).cast("bigint")))
        steps = F.zip_with(gaps, lengths, lambda g, n: g + n)
        ends = F.zip_with(prefix_sums(steps), steps, lambda a, b: a + b)
        return F.zip_with(m, ends, lambda x, end: F.struct(
            F.lit(kind).alias("kind"), (end - F.length(x)).alias("start"), end.alias("end"), x.alias("value"),
            cut_out(pieces, F.greatest(F.lit(0), end - F.length(x) - CONTEXT),
                    F.least(F.lit(CONTEXT), end - F.length(x))).alias("before"),
            cut_out(pieces, end, F.lit(1)).alias("after")))

    return let(found, placed).cast(SPAN)


def digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number):
    n = F.length(number)
    places = F.sequence(F.lit(1), n)
    doubled = F.transform(places, lambda i: F.substring(number, i, F.lit(1)).cast("int") * (1 + (n - i) % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def passes(kind: str, value):
    """The check of the base definition."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    return F.length(digits(value)).between(9, 15)


def hint(text, kind: str):
    """Whether the text can hold a span of this kind at all; cheap to see."""
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]{2}|[0-9][. -][0-9]"))


def base_spans(text, pieces):
    none = F.array().cast(SPAN)

    def valid(k, kind):
        return F.filter(matches(text, pieces, k, BASE[kind]), lambda s: passes(kind, s["value"]))

    return F.concat(*[F.when(hint(text, kind), valid(k, kind)).otherwise(none) for k, kind in enumerate(KINDS)])


def loose_spans(text, pieces):
    none = F.array().cast(SPAN)
    hints = {"email": text.rlike(r"(?:\(at\)|\[at\]| at )") & text.rlike(r"(?:\(dot\)|\[dot\]| dot )")}
    return F.concat(*[
        F.when(hints.get(kind, text.rlike("[0-9]{3}|[0-9][.][0-9]")), matches(text, pieces, k, LOOSE[kind])).otherwise(none)
        for k, kind in enumerate(KINDS)])


def votes(span):
    """A vote of each labeler: 1 personal, -1 not, 0 no opinion."""
    value, before, after = span["value"], span["before"], span["after"]

    def by_kind(of):
        out = None
        for k, kind in enumerate(KINDS):
            out = F.when(span["kind"] == k, of(kind)) if out is None else out.when(span["kind"] == k, of(kind))
        return out

    def vote(yes, no=None):
        chosen = F.when(yes, F.lit(1))
        return (chosen if no is None else chosen.when(no, F.lit(-1))).otherwise(F.lit(0) if no is not None else F.lit(-1))

    touched = before.rlike(r"[A-Za-z0-9_.=\"'/-]$") | after.rlike(r"^[A-Za-z0-9_=\"'/]")
    return F.struct(
        by_kind(lambda k: vote(value.rlike("^(?:" + BASE[k].replace(r"|\G", "") + ")$"))).alias("shape"),
        by_kind(lambda k: vote(passes(k, value)) if k != "email" else vote(value.contains("."), F.lit(False))).alias("check"),
        by_kind(lambda k: vote(value.rlike(GAZETTEER[k]))).alias("gazetteer"),
        by_kind(lambda k: vote(before.rlike(CUES[k]), before.rlike(AGAINST))).alias("context"),
        vote(~touched).alias("edges"),
    )


# --- the model, on counts of vote patterns -----------------------------------------------


def em(patterns: dict[tuple, float], rounds: int = ROUNDS) -> dict[tuple, float]:
    """P(personal) of each (kind, votes...) by EM with one reliability table per labeler.

    Starts from labelers that are right four times in five, so that the positive class
    is the one the votes mean.
    """
    prior = {k: PRIOR for k in range(len(KINDS))}
    right = {(j, v, y): 0.8 if v == y else 0.2 if v == -y else 0.5 for j in range(len(LABELERS)) for v in (-1, 0, 1) for y in (-1, 1)}
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for key in patterns:
            kind, *cast = key
            odds = math.log(prior[kind] / (1 - prior[kind]))
            odds += sum(math.log(right[j, v, 1] / right[j, v, -1]) for j, v in enumerate(cast) if v)
            posterior[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in prior:
            of = [(n, posterior[p]) for p, n in patterns.items() if p[0] == k]
            prior[k] = (1 + sum(n * q for n, q in of)) / (2 + sum(n for n, _ in of))
        for j in range(len(LABELERS)):
            for y in (-1, 1):
                mass = {v: 4.0 if v == y else 1.0 for v in (-1, 1)}
                for p, n in patterns.items():
                    if p[1 + j]:
                        mass[p[1 + j]] += n * (posterior[p] if y == 1 else 1 - posterior[p])
                for v in mass:
                    right[j, v, y] = mass[v] / sum(mass.values())
    return posterior


def features(key: tuple) -> list[float]:
    kind, *cast = key
    return [1.0, *[float(kind == k) for k in range(1, len(KINDS))], *[float(v) for v in cast],
            float(cast[0] * cast[1]), float(cast[1] * cast[2])]


def train(patterns: dict[tuple, float], posterior: dict[tuple, float], steps: int = STEPS) -> list[float]:
    """Logistic regression with the posteriors as targets."""
    import numpy as np

    if not patterns:
        return [0.0] * len(features((0, *[0] * len(LABELERS))))
    keys = list(patterns)
    x, n = np.array([features(k) for k in keys]), np.array([patterns[k] for k in keys], dtype=float)
    n = np.sqrt(n) / np.sqrt(n).sum()  # no frequent pattern alone decides
    y, w = np.array([posterior[k] for k in keys]), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (n * (p - y)) + 1e-3 * w)
        w -= step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def probability(span, weights: list[float]):
    cast = [span["votes"][j].cast("double") for j in LABELERS]
    terms = [F.lit(1.0), *[(span["kind"] == k).cast("double") for k in range(1, len(KINDS))], *cast,
             cast[0] * cast[1], cast[1] * cast[2]]
    return 1 / (1 + F.exp(-sum((F.lit(w) * t for w, t in zip(weights, terms)), F.lit(0.0))))


# --- documents -----------------------------------------------------------------------------


def found_spans(docs: DataFrame, keep: list[str], accept: float = ACCEPT) -> tuple[DataFrame, str]:
    """The columns ``keep`` and a struct (base, added): arrays of spans in order, not overlapping."""
    name, text, pieces, base, loose, free = fresh(docs, "_spans", "_text", "_pieces", "_base", "_loose", "_free")

    def voted(spans):
        return F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"], votes(s).alias("votes")))

    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, whole.alias(text)).withColumn(pieces, windows(F.col(text)))
    rows = rows.select(*keep, base_spans(F.col(text), F.col(pieces)).alias(base), loose_spans(F.col(text), F.col(pieces)).alias(loose))
    rows = apart_from(rows, loose, base, free)
    rows = written(rows.select(*keep, voted(base).alias(base), voted(free).alias(loose)))
    spans = rows.select(F.explode(F.concat(base, loose)).alias("s")).select("s.kind", "s.votes.*")
    counted = spans.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = {(r["kind"], *[r[j] for j in LABELERS]): float(r["n"]) for r in counted}
    weights = train(patterns, em(patterns))
    # Numbers that fail their checksum or range are no card or address, however they look.
    # Spelled-out e-mail addresses have neither: the classifier alone decides on them.
    sure = F.filter(loose, lambda s: (s["votes"]["check"] >= 0) & (probability(s, weights) >= accept))
    rows = rows.withColumn(loose, sure)
    # Of overlapping candidates of different kinds, the first kind listed stays.
    earlier, own, kept = fresh(rows, "_earlier", "_own", "_kept")
    added = F.filter(loose, _of_kind(0))
    for k in range(1, len(KINDS)):
        rows = rows.withColumns({earlier: F.filter(loose, _of_kind(*range(k))), own: F.filter(loose, _of_kind(k))})
        rows = apart_from(rows, own, earlier, f"{kept}{k}")
        added = F.concat(added, F.col(f"{kept}{k}"))
    return rows.select(*keep, F.struct(F.col(base).alias("base"), added.alias("added")).alias(name)), name


def _of_kind(*kinds: int):
    return lambda span: span["kind"].isin(*kinds)


def listed(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_table(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans of every row."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows, name = found_spans(named, ["doc_id"], accept)
    base, added = F.col(name)["base"], F.col(name)["added"]

    def number(k):
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint")

    return rows.select(
        "doc_id",
        *[number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat(base, added))).alias("spans"),
        F.size(added).cast("bigint").alias("n_added"),
    )


def masked(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with every span replaced by its kind in capitals, as in ``<EMAIL>``; null stays null."""
    rows, name = found_spans(docs, docs.columns, accept)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col("text").cast("string")

    def cut(spans):
        pieces = F.transform(spans, lambda s, i: F.concat(
            F.substring(text, (F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]) + 1).cast("int"),
                        F.greatest(F.lit(0), s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])).cast("int")),
            F.get(names, s["kind"])))
        last = F.get(spans, F.size(spans) - 1)["end"]
        return F.concat(F.array_join(pieces, ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

    def disjoint(spans):
        # By place; of overlapping base spans of different kinds, the one that starts first is masked.
        ends = F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<struct<start: bigint, end: bigint, kind: int>>").alias("all")),
                           lambda a, s: F.when(s["start"] >= a["end"], F.struct(s["end"].alias("end"), F.concat(a["all"], F.array(s)).alias("all"))).otherwise(
                               F.struct(F.greatest(a["end"], s["end"]).alias("end"), F.concat(F.slice(a["all"], 1, F.size(a["all"]) - 1), F.array(
                                   F.struct(F.element_at(a["all"], -1)["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"), F.element_at(a["all"], -1)["kind"].alias("kind")))).alias("all"))))
        return ends["all"]

    every = F.concat(F.col(name)["base"], F.col(name)["added"])
    ordered = F.sort_array(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    changed = let(disjoint(ordered), cut)
    new = F.when((F.size(every) > 0) & text.isNotNull(), changed).otherwise(text).alias("text")
    return rows.select(*[new if c == "text" else F.col(c) for c in docs.columns])
