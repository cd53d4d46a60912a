"""Quality rules by distribution divergence.

Every document becomes two histograms: its characters by class, and its words by the
common words of its language. Language references are the mean shares over all
documents of that language that pass the base rules. A document is rejected by the
base rules, or if the Jensen-Shannon distance to a reference is above a threshold;
documents shorter than a guard have too little to compare and pass.

Only built-in expressions. Null or empty text: no words, fails the base rules. A null
or unlisted language is compared with the mean of all such, by character classes
alone. Repeated rows are judged one by one. Input columns are kept by
:func:`judged`, whose added columns take names that are free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import fresh, let, written

MIN_WORDS, MIN_CHARS, MIN_COMMON_WORDS = 10, 200, 60
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.28
WINDOW = 5
SPACES = r"[ \t-\r]"
# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in is that it for was on are as by".split(),
    "de": "der die das und in zu den von mit ist des ein im für".split(),
    "fr": "le la les de des du et en un une que qui dans pour".split(),
    "es": "el la los las de del y en un una que por con su".split(),
}
LONGEST = max(len(w) for words in COMMON_WORDS.values() for w in words)
# Character classes; beside them white space and small letters or others.
CLASSES = (r"\p{Lu}", r"\p{N}", r"[.,;:'’\"?()¿¡«»-]", r"[#*$%&|<>]", r"[!@^~=_+/\\\[\]{}]")
SYMBOLS = 3  # place of the symbols that the base rules count


def repeated_words(words):
    """How many words lie in windows of five words that occur at least twice."""

    def covered(hashes):
        # (hash, place) in order: a window is repeated if a neighbour has its hash.
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p):
            same = F.filter(
                p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]).eqNullSafe(True)
                | (x["h"] == F.get(p, j + 1)["h"]).eqNullSafe(True))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def total(at):
            steps = F.transform(at, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - i, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, n: a + n)

        return let(pairs, lambda p: let(places(p), total))

    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    none = F.lit(0).cast("bigint")
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(none))
    return F.when(F.size(words) > WINDOW, found).otherwise(none)


def duplicate_lines(text):
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def class_counts(text):
    """Characters of each class; small letters and white space are taken out first, as most are such."""
    rest = F.regexp_replace(text, r"[\p{Ll} \t-\r]+", "")
    return let(rest, lambda x: F.array(*[
        (F.length(x) - F.length(F.regexp_replace(x, c, ""))).cast("double") for c in CLASSES]))


def measures(text, lang):
    """One struct with everything the rules look at."""
    words = F.array_remove(F.split(text, SPACES + "+", -1), "")
    listed = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    common = F.when(lang.isin(*COMMON_WORDS), F.element_at(listed, lang)).otherwise(F.array().cast("array<string>"))

    def of_words(w):
        def shares(known):
            found = F.filter(w, lambda x: (F.length(x) <= LONGEST) & F.array_contains(known, x))
            counts = let(found, lambda f: F.transform(known, lambda k: F.size(F.filter(f, lambda x: x == k)).cast("double")))
            return let(counts, lambda c: F.concat(c, F.array(
                F.size(w) - F.aggregate(c, F.lit(0.0), lambda a, n: a + n))))

        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            let(common, shares).alias("words"),
        )

    return let(words, of_words), class_counts(text)


def distance(p, q):
    """Jensen-Shannon distance (base 2) of two arrays of shares; 0 equal, 1 disjoint."""

    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / 2))


def shares(counts):
    return let(F.aggregate(counts, F.lit(0.0), lambda a, n: a + n), lambda total: F.transform(
        counts, lambda n: F.when(total > 0, n / total).otherwise(F.lit(0.0))))


def mean_of(column: str, size: int):
    return F.array(*[F.avg(F.get(column, F.lit(i))) for i in range(size)])


def judged(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with one struct column more, named last in the result.

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (base),
    base_failed, class_distance, word_distance (null where a guard applies), kept.
    """
    keep = docs.columns if keep is None else keep
    f, c, g, r = fresh(docs, "_features", "_counts", "_language", "_reference")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    language = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit(""))
    of_words, of_chars = measures(text, language)
    rows = docs.withColumns({
        f: of_words, g: language,
        c: F.struct(
            of_chars.alias("classes"), F.length(text).alias("n_chars"), duplicate_lines(text).alias("n_dup_lines")),
    })
    rows = written(rows.select(*keep, f, c, g))
    n, repeat = F.col(f)["n_words"], F.col(f)["n_repeat_words"]
    failed = (n < MIN_WORDS) | (100 * repeat > 20 * n)
    marked, letters = F.col(c)["classes"], F.col(f)["word_chars"]
    all_classes = let(marked, lambda m: F.concat(m, F.array(
        (F.col(c)["n_chars"] - letters).cast("double"), letters - F.aggregate(m, F.lit(0.0), lambda a, x: a + x))))
    class_shares, word_shares = shares(all_classes), shares(F.col(f)["words"])
    n_classes, n_common = len(CLASSES) + 2, max(map(len, COMMON_WORDS.values())) + 1
    # One row per listed language and one for the rest.
    reference = rows.where(~failed).select(F.col(g).alias(r), class_shares.alias("p"), word_shares.alias("w")).groupBy(
        r).agg(mean_of("p", n_classes).alias("p"), mean_of("w", n_common).alias("w")).collect()
    if reference:
        known = {k: F.create_map(*[x for row in reference for x in (F.lit(row[r]), F.array(*[
            F.lit(v).cast("double") for v in row[k]]))]) for k in "pw"}
        by_class = distance(class_shares, F.element_at(known["p"], F.col(g)))
        by_word = distance(word_shares, F.slice(F.element_at(known["w"], F.col(g)), 1, F.size(F.col(f)["words"])))
    else:
        by_class = by_word = F.lit(None).cast("double")
    by_class = F.when(F.col(c)["n_chars"] >= MIN_CHARS, by_class)
    by_word = F.when((n >= MIN_COMMON_WORDS) & (F.col(g) != ""), by_word)
    (name,) = fresh(docs, "quality")
    verdict = F.struct(
        n.alias("n_words"), F.col(f)["word_chars"].alias("word_chars"),
        F.get(marked, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), F.col(c)["n_dup_lines"].alias("n_dup_lines"),
        repeat.alias("n_repeat_words"), failed.alias("base_failed"), by_class.alias("class_distance"),
        by_word.alias("word_distance"))
    rows = rows.select(*keep, verdict.alias(name))
    v = F.col(name)
    near = (F.coalesce(v["class_distance"], F.lit(0.0)) <= max_class) & (
        F.coalesce(v["word_distance"], F.lit(0.0)) <= max_word)
    return rows.withColumn(name, v.withField("kept", ~v["base_failed"] & near))


def quality_table(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and the two distances of every row."""
    rows = judged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang"), keep=["doc_id"], **limits)
    v = F.col(rows.columns[-1])
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
              "class_distance", "word_distance")
    return rows.select("doc_id", *[v[x].alias(x) for x in fields])


def good_documents(docs: DataFrame, **limits) -> DataFrame:
    """The documents that no rule rejects, columns as they came."""
    rows = judged(docs, **limits)
    return rows.where(F.col(rows.columns[-1])["kept"]).select(*docs.columns)
