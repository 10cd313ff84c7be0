"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Every whole text gets counts and, from them, signals: whole numbers from 0 to 1000 that are higher for
poorer texts. Fixed base rules reject first. The method then sets one cutoff for each signal and
stratum from labelled texts so that, with a stated confidence, the rules reject at most a stated share
of the good texts of every stratum:

* Labelled good texts that pass the base rules are dealt into a tuning part and a holdout by the digest of
  their text. Equal texts count once, so copies neither lie on both sides nor pass for independent draws.
* The tuning part proposes a path of settings, from loose to strict (``PATH``): for each signal a quantile
  of its good texts, times a factor.
* The holdout tests the settings in that order. A setting passes while the exact binomial probability of
  so few rejections, were the true share above ``risk``, is at most ``error`` divided by the number of strata
  (Bonferroni). Testing stops at the first that fails, so the order of tests costs nothing, and the last
  passing setting counts. Where none passes, also for want of labels, the stratum's rules reject nothing.

A setting counts all its signals together, so the guarantee is for a text's rejection by any of them.
Strata are a declared list of languages and one for all others. Histograms, cutoffs and tests have a
size that languages and the path fix; only they are broadcast.

Words are compared by 64-bit hashes of five-word windows; two different windows of one text are
taken for equal with a chance below n^2 / 2^65 for n windows.

Defined results: a null text has no words and fails the base rules, like an empty one; null or repeated ids
are rows of their own; several labels of one id, or of equal texts, count with their mean, and good is 0.5 or
more; null labels are ignored; without labels the base rules alone decide; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import materialize

#: Share of good texts that the rules may reject in a stratum, and the chance that any stratum's share is higher.
RISK = 0.01
ERROR = 0.05
LANGUAGES = ("de", "en", "es", "fr")
#: Settings from loose to strict: quantile of the tuning part, and a factor on it.
PATH = ((1.0, 4.0), (1.0, 2.0), (1.0, 1.5), (1.0, 1.0), (0.999, 1.0), (0.998, 1.0), (0.996, 1.0), (0.994, 1.0))
SIGNALS = ("symbols", "shouts", "capitals", "dup_lines", "repeats", "word_length")
#: First hexadecimal digits of the text digests that go to the tuning part: 3 of 16.
TUNING = ("0", "1", "2")
WINDOW = 5

_BLANK = " \t\n\x0b\f\r"
_BLANKS = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for each row however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, pattern: str) -> Column:
    """Code points of ``text`` less those that the pattern takes away."""
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")


def words(text: Column) -> Column:
    core = F.btrim(text, F.lit(_BLANK))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, _BLANKS))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words within windows that are found twice or more among the array's windows."""

    def covered(hashes: Column) -> Column:
        """Windows of one hash are neighbours when sorted; flagged places in order then cover words."""
        order = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

        def flagged(s: Column) -> Column:
            twin = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            found = F.filter(s, lambda x, k: F.coalesce(twin(x, k), F.lit(False)))
            return F.array_sort(F.transform(found, lambda x: x["k"]))

        def union(places: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
            add = lambda acc, p: F.struct((acc["n"] + p + window - F.greatest(p, acc["end"])).alias("n"), (p + window).alias("end"))
            return F.aggregate(places, start, add, lambda acc: acc["n"])

        return _let(order, lambda s: union(flagged(s)))

    def of_windows(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))

    def of_hashes(h: Column) -> Column:
        last = F.size(h) - window + 1
        return _let(F.transform(F.slice(h, F.lit(1), F.greatest(last, F.lit(0))), lambda x, k: F.xxhash64(x, *[F.get(h, k + d) for d in range(1, window)])), of_windows)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != "")


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """Per row: ``id``, ``stratum``, the text's ``digest``, counts and ``signals`` (an array in the order of SIGNALS)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    counts = _let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    lines = _let(_lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select(
        docs[id_col].alias("id"),
        (stratum if stratum is not None else F.lit("all")).alias("stratum"),
        F.md5(text).alias("digest"),
        counts.alias("w"),
        lines.alias("l"),
        _without(text, _BLANKS).alias("word_chars"),
        _without(text, r"[^#*$%&|<>]+").alias("n_symbols"),
        _without(text, r"[^!]+").alias("n_shouts"),
        _without(text, r"[^A-Z]+").alias("n_capitals"),
    )
    share = lambda part, whole: F.coalesce(F.expr(f"least(1000, (1000 * {part}) div nullif({whole}, 0))"), F.lit(0)).cast("int")
    flat = rows.select("id", "stratum", "digest", "word_chars", "n_symbols", "n_shouts", "n_capitals", "w.n_words", "w.n_repeat_words", "l.n_lines", "l.n_dup_lines")
    signals = [
        share("n_symbols", "word_chars"), share("n_shouts", "word_chars"), share("n_capitals", "word_chars"),
        share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), F.least(F.lit(1000), F.expr("coalesce(10 * word_chars div nullif(n_words, 0), 0)")).cast("int"),
    ]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return flat.withColumns({"base_failed": base, "signals": F.array(*signals)})


def log_factorial(n: Column) -> Column:
    """Natural logarithm of n! for whole n: a sum below 16, else Stirling's series, right to 14 digits."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(16))).cast("int")), F.lit(0.0), lambda acc, k: acc + F.log(k.cast("double")))
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046728 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 16, small).otherwise(series)


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= x), exactly to rounding; 1 where x is not below n p.

    The term at x times the falling ratios of the terms below it, as many as could add up to 1e-17 of it.
    """
    xd, nd = x.cast("double"), n.cast("double")
    term = F.exp(log_factorial(n) - log_factorial(x) - log_factorial(n - x) + xd * F.log(F.lit(p)) + (nd - xd) * F.log1p(F.lit(-p)))
    ratio = lambda k: k * (1 - p) / ((nd - k + 1) * p)
    many = F.least(xd, F.ceil(F.lit(40.0) / (1 - ratio(xd))).cast("double")).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, j: Column) -> Column:
        next_term = acc["term"] * ratio(xd - j.cast("double"))
        return F.struct(next_term.alias("term"), (acc["total"] + next_term).alias("total"))

    steps = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    tail = term * F.aggregate(steps, start, add, lambda acc: acc["total"])
    return F.when(xd >= nd * p, F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0)))


def proposals(tuning: DataFrame, path: Sequence[tuple[float, float]] = PATH) -> DataFrame:
    """Per ``stratum``: ``cutoffs``, for each setting of the path an array with one cutoff for each signal."""
    quantiles = sorted({q for q, _ in path})
    # percentile_disc keeps a count of each distinct value: signals have 1001
    cut = [[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY signals[{s}])").alias(f"q{k}_{s}") for k, q in enumerate(quantiles)] for s in range(len(SIGNALS))]
    found = tuning.groupBy("stratum").agg(*[c for row in cut for c in row])
    setting = lambda q, f: F.array(*[F.floor(F.col(f"q{quantiles.index(q)}_{s}") * F.lit(f)).cast("int") for s in range(len(SIGNALS))])
    return found.select("stratum", F.array(*[setting(q, f) for q, f in path]).alias("cutoffs"))


def exceeds(signals: Column, cutoff: Column) -> Column:
    """Whether any signal is above its cutoff."""
    return F.exists(F.zip_with(signals, cutoff, lambda s, c: s > c), lambda x: x)


def thresholds(labelled: DataFrame, n_strata: int, risk: float = RISK, error: float = ERROR, path: Sequence[tuple[float, float]] = PATH) -> DataFrame:
    """Per stratum: ``cutoff`` of the strictest setting that passes, with its ``rejected`` of ``tested`` good texts and ``p_value``.

    ``labelled`` has ``stratum``, ``digest``, ``signals`` and ``label``. Strata without a passing setting have no row.
    """
    good = labelled.groupBy("digest", "stratum").agg(F.first("signals").alias("signals"), F.avg("label").alias("label")).where("label >= 0.5")
    tune = F.substring("digest", 1, 1).isin(*TUNING)
    proposed = F.broadcast(proposals(good.where(tune), path))
    per = (
        good.where(~tune)
        .join(proposed, "stratum")
        .groupBy("stratum")
        .agg(F.count("*").alias("tested"), F.array(*[F.count_if(exceeds(F.col("signals"), F.col("cutoffs")[k])) for k in range(len(path))]).alias("rejected"), F.first("cutoffs").alias("cutoffs"))
    )
    p_value = F.transform("rejected", lambda x: binomial_tail(x, F.col("tested"), risk))
    tested = per.withColumn("p", p_value)
    # the first failure ends the sequence; its place less one is the setting that counts
    failed = F.array_position(F.transform("p", lambda p: p > error / n_strata), True)
    passed = F.when(failed == 0, F.lit(len(path))).otherwise(failed - 1).cast("int")
    return tested.withColumn("k", passed).where("k > 0").select("stratum", F.col("cutoffs")[F.col("k") - 1].alias("cutoff"), F.col("rejected")[F.col("k") - 1].alias("rejected"), "tested", F.col("p")[F.col("k") - 1].alias("p_value"), F.col("k").alias("setting"))


def strata(lang: Column, languages: Sequence[str] = LANGUAGES) -> Column:
    """The declared language, or 'other'."""
    return F.when(lang.isin(*languages), lang).otherwise("other")


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", languages: Sequence[str] = LANGUAGES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per row: ``id``, ``stratum``, counts, ``signals``, ``base_failed`` and ``kept``.

    Counts are written once and read for calibration and for the verdicts.
    """
    counts = materialize(text_counts(docs, id_col, text_col, strata(docs[lang_col], languages)), "rule-counts")
    known = labels.where(labels[label_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.avg(labels[label_col].cast("double")).alias("label"))
    labelled = counts.where(~F.col("base_failed")).join(known, "id").select("stratum", "digest", "signals", "label")
    cutoffs = thresholds(materialize(labelled, "rule-labels"), len(languages) + 1, risk, error)
    judged = counts.join(F.broadcast(cutoffs.select("stratum", "cutoff")), "stratum", "left")
    rejected = F.coalesce(exceeds(F.col("signals"), F.col("cutoff")), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected)
