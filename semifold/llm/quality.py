"""Quality rules by distribution divergence.

Each document's character-class histogram and common-word histogram are compared with a language reference by
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). Short documents are guarded: a histogram of
few words is no evidence, so each test applies from a minimum length only. Everything is one projection over the
scan: no shuffle, no Python, and no state that grows with the data.

Defined results: a null text counts as no words (n_words 0, so base_failed). A null or unknown lang has no reference and
is judged by the base rules alone. Windows of three words are compared by 64-bit hashes: two that differ count as equal
with odds of 5e-20 a pair. Repeated rows are judged one by one. Extra columns are passed over by
score() and kept by keep(); no name of docs clashes with a working column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of lower-case letters, capitals, digits, white space, sentence punctuation, other signs in prose.
CLASS_SHARES = {
    "en": (0.785, 0.030, 0.010, 0.150, 0.020, 0.005),
    "fr": (0.780, 0.028, 0.010, 0.150, 0.027, 0.005),
    "de": (0.780, 0.055, 0.010, 0.130, 0.020, 0.005),
    "es": (0.785, 0.027, 0.010, 0.155, 0.018, 0.005),
}

#: Frequent words of each language with their rough share of running text.
COMMON_WORDS = {
    "en": {"the": 0.06, "of": 0.032, "and": 0.028, "to": 0.026, "a": 0.022, "in": 0.021, "is": 0.010, "that": 0.010, "for": 0.009, "it": 0.009, "with": 0.007, "as": 0.007, "on": 0.006, "are": 0.005, "this": 0.005},
    "fr": {"de": 0.055, "la": 0.030, "le": 0.027, "et": 0.025, "les": 0.022, "des": 0.019, "en": 0.015, "un": 0.012, "du": 0.012, "une": 0.011, "que": 0.010, "est": 0.009, "pour": 0.008, "qui": 0.008, "dans": 0.008},
    "de": {"der": 0.033, "die": 0.033, "und": 0.028, "in": 0.019, "den": 0.012, "das": 0.011, "von": 0.010, "zu": 0.010, "mit": 0.009, "ist": 0.009, "des": 0.008, "im": 0.008, "für": 0.008, "ein": 0.007, "eine": 0.007},
    "es": {"de": 0.060, "la": 0.036, "que": 0.029, "el": 0.028, "en": 0.025, "y": 0.024, "a": 0.019, "los": 0.016, "se": 0.011, "del": 0.011, "las": 0.010, "un": 0.010, "por": 0.009, "con": 0.009, "no": 0.009},
}


@dataclass(frozen=True)
class QualityParams:
    """Limits of the base rules and of the divergence tests."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    class_limit: float = 0.30
    class_min_words: int = 50
    word_limit: float = 0.31
    word_min_words: int = 200
    class_shares: dict = field(default_factory=lambda: CLASS_SHARES)
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of one length; terms with a zero share count as 0. Null if either is."""
    both = p.isNotNull() & q.isNotNull()
    term = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0))
    return F.when(both, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(term, F.lit(0.0), lambda s, x: s + x) / 2)))


def _with_rest(shares: Column) -> Column:
    """The shares and, last, what they leave of 1."""
    return F.concat(shares, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(shares, F.lit(0.0), lambda s, x: s + x))))


def _by_language(lang: Column, of: dict[str, list]) -> Column:
    out = F.lit(None)
    for code, values in sorted(of.items()):
        out = F.when(lang == code, F.array(*map(F.lit, values))).otherwise(out)
    return out


def with_quality(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """docs with the struct _q_ of all measures and the verdict; every other column stays as it is."""
    text = F.coalesce(F.col("text"), F.lit(""))
    space = r"[\x20\x09-\x0D]+"
    some = lambda c: F.array_remove(c, "")
    a = docs.withColumn("_q_words", some(F.split(text, space)))
    words, n = F.col("_q_words"), F.size("_q_words")
    # White space goes with the join of the words and small letters with one pattern; the other classes are few signs.
    without = lambda pattern: F.regexp_replace("_q_rest", pattern, "")
    gone = lambda pattern: F.length("_q_rest") - F.length(without(pattern))
    # Array functions with a lambda are interpreted element by element: those without one do what they can.
    a = a.withColumn("_q_windows", F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(n, F.lit(0))).alias("b"), F.slice(words, 3, F.greatest(n, F.lit(0))).alias("c")))
    a = a.withColumn("_q_windows", F.transform(F.slice("_q_windows", 1, F.greatest(F.lit(0), n - 2)), lambda x: F.xxhash64(x)))
    win = F.col("_q_windows")
    a = a.withColumn(
        "_q_sorted",
        F.when(
            F.size(F.array_distinct(win)) < F.size(win),
            F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    srt = F.col("_q_sorted")
    same = lambda x, k: F.get(srt, k)["h"].eqNullSafe(x["h"])
    a = a.withColumn("_q_at", F.sort_array(F.transform(F.filter(srt, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    at = F.col("_q_at")
    repeat = F.coalesce(
        F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda s, x: s + x), F.lit(0)
    )
    lines = some(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), x).otherwise("")))
    a = a.withColumn("_q_lines", lines)
    a = a.withColumn("_q_joined", F.array_join(words, "")).withColumn("_q_rest", F.regexp_replace("_q_joined", r"\p{Ll}+", ""))
    inner, total = F.length("_q_joined"), F.length(text)
    a = a.withColumn("_q_class", F.array(inner - F.length("_q_rest"), gone(r"\p{Lu}+"), gone("[0-9]+"), total - inner, gone(r"[.,;:!?'\"()-]+")))
    frequent = F.array(*map(F.lit, sorted({w for ref in params.common_words.values() for w in ref})))
    low = F.split(F.lower(F.array_join(words, " ")), " ")
    a = a.withColumn("_q_low", F.when(n >= params.word_min_words, low))
    a = a.withColumn("_q_hits", F.when(F.arrays_overlap("_q_low", frequent), F.col("_q_low")))
    long = lambda c: c.cast("long")
    chars, cls = F.length(text), F.col("_q_class")
    common = _by_language(F.col("lang"), {k: list(v) for k, v in params.common_words.items()})
    reference = _by_language(F.col("lang"), {k: [*v.values(), 1 - sum(v.values())] for k, v in params.common_words.items()})
    a = a.withColumn("_q_shares", F.transform(cls, lambda x: x / F.greatest(chars, F.lit(1))))
    a = a.withColumn("_q_common", F.when(n >= params.word_min_words, F.transform(common, lambda c: F.coalesce(F.size("_q_hits") - F.size(F.array_remove("_q_hits", c)), F.lit(0)) / n)))
    a = a.withColumn(
        "_q_",
        F.struct(
            long(n).alias("n_words"),
            long(chars - cls[3]).alias("word_chars"),
            long(gone("[#*$%&|<>]+")).alias("n_symbols"),
            long(F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).alias("n_dup_lines"),
            long(repeat).alias("n_repeat_words"),
            js_distance(_with_rest(F.col("_q_shares")), _by_language(F.col("lang"), {k: list(v) for k, v in params.class_shares.items()})).alias("class_distance"),
            js_distance(_with_rest(F.col("_q_common")), reference).alias("word_distance"),
        ),
    )
    q = F.col("_q_")
    failed = (q["n_words"] < params.min_words) | (q["n_repeat_words"] > params.max_repeat_share * q["n_words"])
    # A test that is always true but not deterministic keeps the optimiser from moving later filters below the projections
    # and so from computing the word arrays anew inside each of their expressions.
    fence = F.monotonically_increasing_id() >= 0
    kept = fence & ~failed & ~((q["n_words"] >= params.class_min_words) & (F.coalesce(q["class_distance"], F.lit(0.0)) > params.class_limit)) & (F.coalesce(q["word_distance"], F.lit(0.0)) <= params.word_limit)
    a = a.withColumn("_q_", q.withField("base_failed", failed).withField("kept", kept))
    return a.drop("_q_words", "_q_windows", "_q_sorted", "_q_at", "_q_lines", "_q_joined", "_q_rest", "_q_class", "_q_low", "_q_hits", "_q_shares", "_q_common")


def score(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, the base measures, base_failed, the two distances and kept: one row for each row of docs."""
    return with_quality(docs.select("doc_id", "text", "lang"), params).select("doc_id", "_q_.*")


def keep(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that pass, with their columns unchanged."""
    whole = docs.select(F.struct("*").alias("_q_row"), "text", "lang")  # so that no column of docs clashes with a working one
    return with_quality(whole, params).where(F.col("_q_")["kept"]).select("_q_row.*")
