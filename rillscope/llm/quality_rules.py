r"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

*Features.*  Words are runs of ``[^\x20\x09-\x0D]``.  Per text: n_words,
word_chars, n_symbols, n_dup_lines, n_repeat_words (see ``text_features``).

*Rules.*  Each of RULES has a statistic and a fixed sequence of cutoffs from
the mildest to the strictest.  A rule at cutoff c rejects texts whose statistic
is above c.

*Risk control.*  In each stratum (language and length class) and for each rule,
the cutoffs are tested in that order on the labelled good documents: with n
good ones of which k would be rejected, the cutoff is safe if
P(Binomial(n, a) <= k) <= d, the exact (Clopper-Pearson) test of "the false
rejection rate is above a".  Testing stops at the first cutoff that is not
safe, which keeps the error of a sequence at d (fixed-sequence testing); over
rules and strata d is DELTA / (rules * max(STRATA, strata)) (Bonferroni).  With a =
ALPHA / rules, all rules together reject more than ALPHA of the good documents
of some stratum with a probability of DELTA at most.  Cutoffs are fixed in
advance, so every labelled document is held out from their choice.

A stratum without enough labels has no safe cutoff; then only the base rules
apply to it.

Edge cases: a null text has no words (all features 0, base_failed); a null
language is a stratum of its own; labels with a null doc_id or quality are
ignored, and a document with several labels is good if one says so; repeated
documents are kept, a row for each; empty tables give empty results; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
ALPHA = 0.05
DELTA = 0.05
#: Statistic by rule, from the features; cutoffs from mild to strict.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.5, 0.3, 0.2, 0.1, 0.05, 0.02]),
    "dup_lines": ("n_dup_lines / greatest(n_words, 1)", [0.2, 0.1, 0.05, 0.02, 0.01]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.25, 0.2, 0.15, 0.1, 0.05]),
    "long_words": ("word_chars / greatest(n_words, 1)", [40.0, 20.0, 12.0, 9.0, 8.0, 7.0]),
    "shouting": ("n_marks / greatest(n_words, 1)", [1.8, 1.4, 1.0, 0.6, 0.4]),
}
LENGTH_CLASSES = (100, 400)
#: The error is shared out among this many strata, fixed beforehand; among all, should there be more.
STRATA = 48
#: Strata with a cutoff are sent to all tasks up to this number; beyond it they are joined.
MOST_SENT = 10_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeats(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, empty, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def found(h: Column) -> Column:
        # Most texts repeat no window; only the others are sorted.
        sorted_hashes = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(sorted_hashes, covered))

    return F.when(F.size(words) > WINDOW, let(hashes, found)).otherwise(F.lit(0).cast("long"))


def text_features(docs: DataFrame, keep: str | None = None) -> DataFrame:
    """doc_id, lang and the features of every text; with ``keep``, the whole row as a column of that name as well.

    n_dup_lines counts the newline-separated lines with a word that equal an
    earlier line; n_repeat_words the words in windows of eight found twice or
    more; n_marks the exclamation marks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    t = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").alias("lang"), text.alias("t"), *([F.struct("*").alias(keep)] if keep else []))
    more = [keep] if keep else []

    def features(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeats(words).alias("n_repeat_words"))

    def trimmed(w: Column) -> Column:
        # White space at an end of the text leaves an empty string there.
        first, last = (F.get(w, F.lit(0)) == "").cast("int"), (F.get(w, F.size(w) - 1) == "").cast("int")
        return F.slice(w, 1 + first, F.greatest(F.size(w) - first - last, F.lit(0)))

    words = let(F.split("t", SPACE), trimmed)
    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    marks = let(F.regexp_replace("t", r"[^#*$%&|<>!]+", ""), lambda m: F.struct(F.length(m).alias("all"), F.length(F.replace(m, F.lit("!"), F.lit(""))).alias("symbols")))
    chars = (F.length("t") - F.length(F.regexp_replace("t", r"[^\x20\x09-\x0D]+", ""))).cast("long")
    out = t.select("doc_id", "lang", *more, let(words, features).alias("f"), chars.alias("word_chars"), marks.alias("m"), dup.alias("n_dup_lines"))
    out = out.select("doc_id", "lang", *more, "f.n_words", "word_chars", F.col("m.symbols").cast("long").alias("n_symbols"), "n_dup_lines", "f.n_repeat_words", (F.col("m.all") - F.col("m.symbols")).cast("long").alias("n_marks"))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def stratum() -> Column:
    """The language (null is one more) and one of three length classes."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    return F.concat_ws("/", lang, sum((F.col("n_words") >= n).cast("int") for n in LENGTH_CLASSES).cast("string"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) by its terms, in logarithms so that none underflows."""
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), (n * F.log(F.lit(1 - p))).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        top = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a["sum"] - top) + F.exp(term - top))).alias("sum"))

    return F.when(k >= n, F.lit(1.0)).otherwise(F.exp(F.when(k < 1, start["sum"]).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), start, add, lambda a: a["sum"]))))


def safe_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the strictest safe cutoff of each stratum and rule; none where no cutoff is safe."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = features.where("not base_failed").join(good, "doc_id", "left_semi").withColumn("stratum", stratum())
    counts = [F.sum((F.expr(s) > c).cast("long")).alias(f"{rule}_{i}") for rule, (s, cuts) in RULES.items() for i, c in enumerate(cuts)]
    tally = materialize(features.sparkSession, held.groupBy("stratum").agg(F.count("*").alias("n"), *counts), "tally")
    strata = max(STRATA, tally.count())
    tests = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(c).cast("double").alias("cutoff"), F.col(f"{rule}_{i}").alias("k")) for rule, (_, cuts) in RULES.items() for i, c in enumerate(cuts)))
    rows = tally.select("stratum", "n", F.inline(tests))
    rows = rows.withColumn("safe", binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)) <= delta / (len(RULES) * strata))
    ends = rows.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("safe"), F.col("step"))).alias("end"), F.collect_list(F.struct("step", "cutoff")).alias("cuts"))
    best = ends.select("stratum", "rule", F.array_max(F.filter("cuts", lambda x: F.col("end").isNull() | (x["step"] < F.col("end")))).alias("best"))
    return best.where("best is not null").select("stratum", "rule", "best.cutoff")


def apply_rules(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``features`` with ``kept`` and the names of the rules that reject (``failed``)."""
    by = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))
    by = materialize(features.sparkSession, by, "cutoffs")
    joined = features.withColumn("stratum", stratum()).join(F.broadcast(by) if by.count() <= MOST_SENT else by.hint("merge"), "stratum", "left")
    failed = F.filter(F.array(*(F.when(F.expr(s) > F.col(f"cut_{r}"), F.lit(r)) for r, (s, _) in RULES.items())), lambda x: x.isNotNull())
    return joined.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop(*(f"cut_{r}" for r in RULES))


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Features, base result and verdict of every document."""
    features = materialize(docs.sparkSession, text_features(docs), "features")
    return apply_rules(features, safe_cutoffs(features, labels, alpha, delta)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "failed")


def kept_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, each judged by itself whatever its ``doc_id``; texts are never shuffled."""
    cutoffs = safe_cutoffs(text_features(docs), labels, alpha, delta)
    judged = apply_rules(text_features(docs, "row"), cutoffs)
    return judged.where("kept").select("row.*")
