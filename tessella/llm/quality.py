"""Quality rules by distribution divergence.

A document's character-class histogram and common-word histogram are compared with
language references by the Jensen-Shannon distance (base 2, so within 0 and 1).
Everything is one map-only expression over the text: no shuffle, no Python.

Defined cases: a null or empty text has no words and fails the base rule; a text under
``MIN_WORDS`` words, or mostly in a script without a reference, is not judged by the
method; ties between languages go to the first in ``LANGUAGES``; repeated rows are
judged alike; an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, count_chars, let, table, words

# Shares of characters in ordinary prose by class, in the order of CLASSES.
CLASSES = ("lower", "upper", "other_letters", "digits", "space", "sentence_marks", "symbols")
CLASS_REFERENCE = {
    "en": (0.785, 0.025, 0.000, 0.005, 0.165, 0.020, 0.000),
    "fr": (0.745, 0.025, 0.040, 0.005, 0.165, 0.020, 0.000),
    "de": (0.775, 0.045, 0.020, 0.005, 0.135, 0.020, 0.000),
    "es": (0.765, 0.025, 0.025, 0.005, 0.160, 0.020, 0.000),
}
# Shares of words in ordinary prose.
COMMON_WORDS = {
    "en": {"the": 0.060, "of": 0.030, "and": 0.028, "to": 0.026, "in": 0.022, "a": 0.021, "is": 0.012, "that": 0.011, "for": 0.010, "it": 0.010, "was": 0.009, "with": 0.008, "on": 0.008, "be": 0.007, "by": 0.006},
    "fr": {"de": 0.050, "la": 0.030, "le": 0.028, "et": 0.024, "les": 0.022, "des": 0.018, "en": 0.016, "un": 0.013, "une": 0.012, "du": 0.012, "que": 0.011, "est": 0.010, "dans": 0.009, "qui": 0.009, "pour": 0.007},
    "de": {"die": 0.035, "der": 0.034, "und": 0.029, "in": 0.018, "den": 0.012, "das": 0.012, "von": 0.011, "zu": 0.011, "mit": 0.010, "ist": 0.010, "des": 0.009, "sich": 0.009, "auf": 0.008, "ein": 0.008, "nicht": 0.007},
    "es": {"de": 0.060, "la": 0.038, "que": 0.030, "el": 0.029, "en": 0.027, "y": 0.026, "a": 0.020, "los": 0.017, "se": 0.013, "del": 0.012, "las": 0.011, "un": 0.010, "por": 0.009, "con": 0.009, "una": 0.008},
}
LANGUAGES = tuple(CLASS_REFERENCE)
#: Under so many words a histogram says little, and the method lets the document pass.
MIN_WORDS = 40
#: Over this share of letters outside Latin script there is no reference.
MAX_FOREIGN = 0.3
#: A document goes when both distances are over the first pair, or either over its own of the second.
BOTH_OVER = {"class_distance": 0.20, "word_distance": 0.28}
EITHER_OVER = {"class_distance": 0.35, "word_distance": 0.42}
#: A text without any common word has a distance of 0.386; ordinary prose of this many words stays under the limit.
LACKING_OVER = {"word_distance": 0.35}
LACKING_MIN_WORDS = 100


def js_distance(counts: list[Column], reference: tuple[float, ...]) -> Column:
    """Jensen-Shannon distance of a histogram, given as shares, to a reference; 0*log(0) is 0."""
    total = sum(reference)
    terms = []
    for p, q in zip(counts, reference, strict=True):
        q = q / total
        m = (p + F.lit(q)) / 2
        terms.append(F.when(p > 0, p * F.log2(p / m)).otherwise(0.0))
        if q > 0:
            terms.append(F.lit(q) * (F.lit(math.log2(q)) - F.log2(m)))
    return F.sqrt(F.greatest(sum(terms[1:], terms[0]) / 2, F.lit(0.0)))


def _grams(h: Column, size: int) -> Column:
    """Hash of the ``size`` items from each place on, where so many are left."""
    return F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))


def repeat_words(w: Column, size: int = 8) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the text.

    A text without a repeated half window has no repeated window, which spares most
    texts the longer hashes.
    """

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(v: Column) -> Column:
            twice = F.filter(v, lambda e, i: F.coalesce(F.get(v, i - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(v, i + 1)["x"] == e["x"], F.lit(False)))
            return F.array_sort(F.transform(twice, lambda e: e["i"]))

        def reach(p: Column) -> Column:
            steps = F.transform(p, lambda q, i: F.least(F.lit(size), F.get(p, i + 1) - q))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(pairs, places), reach)

    def unless_distinct(then) -> object:
        return lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(then(g))

    def judged(h: Column) -> Column:
        full = let(_grams(h, size), unless_distinct(covered))
        return let(_grams(h, size // 2), unless_distinct(lambda _: full))

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) <= size, F.lit(0)).otherwise(let(hashed, judged)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long")


def _word_distance(w: Column) -> Column:
    """The distance to the language whose common words the text uses most."""
    known = sorted({x for v in COMMON_WORDS.values() for x in v})
    n = F.size(w)

    def of(g: str, found: Column) -> Column:
        ref = COMMON_WORDS[g]

        def distance(joined: Column) -> Column:
            counts = F.array(*[(F.length(joined) - F.length(F.replace(joined, F.lit(f" {k} "), F.lit("")))) / (len(k) + 2) for k in ref])
            values = (*ref.values(), 1 - sum(ref.values()))

            def of_counts(c: Column) -> Column:
                shares = [F.get(c, F.lit(i)) / n for i in range(len(ref))]
                rest = F.greatest(F.lit(0.0), 1 - F.aggregate(c, F.lit(0.0), lambda a, b: a + b) / n)
                return js_distance([*shares, rest], values)

            return let(counts, of_counts)

        return let(F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" ")), distance)

    def best(found: Column) -> Column:
        def choose(h: Column) -> Column:
            most = F.array_position(h, F.array_max(h))
            out = F.when(most == 1, of(LANGUAGES[0], found))
            for i, g in enumerate(LANGUAGES[1:], 2):
                out = out.when(most == i, of(g, found))
            return out

        return let(F.array(*[F.size(F.filter(found, _among(g))) for g in LANGUAGES]), choose)

    return let(F.filter(w, lambda x: x.isin(*known)), best)


def _among(language: str):
    return lambda x: x.isin(*COMMON_WORDS[language])


def quality(text: Column, lang: Column | None = None) -> Column:
    """Struct of the base counts, the two distances and the verdicts for a text.

    Where ``lang`` names a language without a reference, common words may be lacking.
    """
    referenced = F.lit(True) if lang is None else F.coalesce(lang.isin(*LANGUAGES), F.lit(True))
    text = F.coalesce(text, F.lit(""))

    def measured(w: Column, bare: Column) -> Column:
        """``bare``: the text without a-z, which shortens all that follows."""
        n, length = F.size(w), F.length(text)
        return let(
            let(bare, lambda b: F.struct(b.alias("bare"), F.regexp_replace(b, SPACE, "").alias("dense"))),
            lambda b: F.struct(
                n.cast("long").alias("n_words"),
                (length - F.length(b["bare"]) + F.length(b["dense"])).cast("long").alias("word_chars"),
                count_chars(b["dense"], "[^#*$%&|<>]+").cast("long").alias("n_symbols"),
                duplicate_lines(text).alias("n_dup_lines"),
                repeat_words(w).alias("n_repeat_words"),
                F.when(n >= MIN_WORDS, _word_distance(w)).alias("word_distance"),
                (length - F.length(b["bare"])).alias("lower"),
                count_chars(b["dense"], "[^A-Z]+").alias("upper"),
                count_chars(b["dense"], r"[\x00-\x7F]+").alias("other_letters"),
                count_chars(b["dense"], "[^0-9]+").alias("digits"),
                (F.length(b["bare"]) - F.length(b["dense"])).alias("space"),
                count_chars(b["dense"], r"""[^.,;:!?'"()\-]+""").alias("sentence_marks"),
                F.greatest(length, F.lit(1)).alias("length"),
            ),
        )

    def judged(m: Column) -> Column:
        shares = [m[k] / m["length"] for k in CLASSES[:-1]]
        shares.append(F.greatest(F.lit(0.0), 1 - sum(shares[1:], shares[0])))
        distance = F.least(*[js_distance(shares, CLASS_REFERENCE[g]) for g in LANGUAGES])
        base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

        def verdict(v: Column) -> Column:
            def over(limits: dict[str, float]) -> list[Column]:
                return [F.coalesce(v[k] > x, F.lit(False)) for k, x in limits.items()]

            (c, w), (c_alone, w_alone), (lacking,) = over(BOTH_OVER), over(EITHER_OVER), over(LACKING_OVER)
            w_alone = w_alone | (lacking & referenced & (v["n_words"] >= LACKING_MIN_WORDS))
            fields = [v[k].alias(k) for k in (*names, "base_failed", "class_distance", "word_distance")]
            return F.struct(*fields, (~v["base_failed"] & ~(v["judged"] & ((c & w) | c_alone | w_alone))).alias("kept"))

        may_judge = (m["n_words"] >= MIN_WORDS) & (shares[2] <= MAX_FOREIGN)
        return let(F.struct(*[m[k].alias(k) for k in names], base.alias("base_failed"), distance.alias("class_distance"), m["word_distance"].alias("word_distance"), may_judge.alias("judged")), verdict)

    return let(let(words(text), lambda w: measured(w, F.regexp_replace(text, "[a-z]+", ""))), judged)


def _lang(docs: DataFrame) -> Column | None:
    return F.col("lang") if "lang" in docs.columns else None


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, ``base_failed``, ``kept`` and the distances."""
    q = docs.select("doc_id", quality(F.col("text"), _lang(docs)).alias("q"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
    return q.select("doc_id", *[F.col(f"q.{k}").alias(k) for k in names])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return docs.filter(quality(F.col("text"), _lang(docs))["kept"])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
