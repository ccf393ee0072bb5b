"""Quality rules by weak supervision, with DataFrame functions only.

Every rule votes good (1), bad (0) or abstains (-1) on a text, each by its own evidence, so that good and bad votes meet on
one text. Nobody says how good a rule is: expectation-maximisation over the counts of vote patterns (at most 3 to the
number of rules, whatever the corpus; the only thing collected) estimates the share of good texts and, for each hidden
class, how often a rule votes good, bad or abstains. A text's posterior probability of being good decides: a bad vote
of a rule that often errs is outvoted, and abstentions count for what they are worth.

The model is fitted on the texts that it decides, those that don't fail outright. A rule's vote shares in a class start from
``START``, a belief that weighs as much as ``BELIEF`` of those texts, so that it counts alike at every size.

A null text has no words. A text under ``MIN_WORDS`` words, or with more than half of its words in repeated three-word
windows, fails outright. Ties (a posterior of one half) are good. Empty tables give no rows, repeated rows are judged one
by one, other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
ITERATIONS = 100
#: A rule's shares of good, bad and no votes in good texts and in bad ones, before any text is seen; and the weight of that.
START, BELIEF = {True: (0.70, 0.02, 0.28), False: (0.40, 0.30, 0.30)}, 0.001


def text_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The row as struct ``row`` with the counts over its whole text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), t.alias("t"))
    df = df.select("row", "t", F.array_remove(F.split("t", SPACE), "").alias("w"))
    df = df.select("row", "t", "w", F.size("w").alias("n"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    # A hash for each window of three words, in order.
    grams = F.when(F.col("n") >= 3, F.transform(F.expr("slice(w, 1, greatest(n - 2, 0))"), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.select("row", "t", "w", "n", "lines", grams.alias("g"))
    sorted_ = F.when(F.size(F.array_distinct("g")) < F.size("g"), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))
    df = df.select("row", "t", "w", "n", "lines", sorted_.alias("s"))
    twice = F.filter("s", lambda x, j: (F.get("s", j - 1)["h"] == x["h"]) | (F.get("s", j + 1)["h"] == x["h"]))
    df = df.select("row", "t", "w", "n", "lines", F.array_sort(F.transform(twice, lambda x: x["i"])).alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    joined = F.array_join("w", "")
    return df.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("[a-z]")).cast("long").alias("n_lower"),
        F.regexp_count("t", F.lit(r"[!?]{2}|[{}\[\]=;]")).cast("long").alias("n_marks"),
        F.regexp_count("t", F.lit(r"[.!?](?![^\x20\x09-\x0D])")).cast("long").alias("n_ends"),
        F.regexp_count("t", F.lit(r"(?<![^\x20\x09-\x0D])\p{L}++[.,;:?!]?+(?![^\x20\x09-\x0D])")).cast("long").alias("n_plain"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(-1)


def rules() -> dict[str, Column]:
    """Each rule's vote from the features of one text. Shares are compared as products, so that no text divides by 0."""
    n, c = F.col("n_words"), F.col
    return {
        "length": _vote(n < 20, n >= 100),
        "symbols": _vote(10 * c("n_symbols") > n, 50 * c("n_symbols") <= n),
        "word_length": _vote((c("word_chars") > 10 * n) | (c("word_chars") < 3 * n), (c("word_chars") <= 7 * n) & (2 * c("word_chars") >= 7 * n)),
        "duplicate_lines": _vote(4 * c("n_dup_lines") > c("n_lines"), (c("n_dup_lines") == 0) & (c("n_lines") >= 2)),
        "repeated_words": _vote(4 * c("n_repeat_words") > n, 20 * c("n_repeat_words") <= n),
        "capitals": _vote(c("n_upper") > c("n_lower"), 8 * c("n_upper") <= c("n_lower")),
        "marks": _vote(10 * c("n_marks") > n, 50 * c("n_marks") <= n),
        "sentences": _vote((100 * c("n_ends") < n) | (3 * c("n_ends") > n), (50 * c("n_ends") >= n) & (4 * c("n_ends") <= n)),
        "plain_words": _vote(10 * c("n_plain") < 6 * n, 10 * c("n_plain") >= 9 * n),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


class LabelModel:
    """balance: share of good texts; shares[rule][class][vote]: how often the rule votes so on texts of the class."""

    def __init__(self, balance: float, shares: dict[str, dict[bool, dict[int, float]]]):
        self.balance, self.shares = balance, shares
        #: Evidence of each vote: log of its share in good texts over that in bad ones.
        self.weights = {r: {v: math.log(x[True][v] / x[False][v]) for v in (1, 0, -1)} for r, x in shares.items()}
        self.start = math.log(balance / (1 - balance))

    def quality(self, votes: dict[str, str]) -> Column:
        """P(good | votes) as an expression; ``votes`` names each rule's vote column."""
        total = F.lit(self.start)
        for rule, column in votes.items():
            w = self.weights[rule]
            total = total + F.when(F.col(column) == 1, w[1]).when(F.col(column) == 0, w[0]).otherwise(w[-1])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def probability(self, pattern: tuple[int, ...]) -> float:
        total = self.start + sum(w[v] for w, v in zip(self.weights.values(), pattern, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def fit(features: DataFrame, iterations: int = ITERATIONS) -> LabelModel:
    """The label model by expectation-maximisation over the counts of vote patterns, which are collected once."""
    names = list(rules())
    counted = features.where(~base_failed()).select(*[v.alias(r) for r, v in rules().items()]).groupBy(*names).agg(F.count(F.lit(1)).alias("texts"))
    patterns = sorted((tuple(r[k] for k in names), r["texts"]) for r in counted.collect())
    return estimate(names, patterns, iterations)


def estimate(names: list[str], patterns: list[tuple[tuple[int, ...], int]], iterations: int = ITERATIONS) -> LabelModel:
    """The label model from (votes, texts); without texts, what is believed before."""
    texts = sum(n for _, n in patterns)
    belief = BELIEF * texts
    model = LabelModel(0.5, {r: {c: dict(zip((1, 0, -1), START[c], strict=True)) for c in (True, False)} for r in names})
    for _ in range(iterations if patterns else 0):
        sums = {r: {c: {v: belief * x for v, x in zip((1, 0, -1), START[c], strict=True)} for c in (True, False)} for r in names}
        good = 0.0
        for pattern, n in patterns:
            p = model.probability(pattern)
            good += n * p
            for r, v in zip(names, pattern, strict=True):
                sums[r][True][v] += n * p
                sums[r][False][v] += n * (1 - p)
        shares = {r: {c: {v: x / sum(by_vote.values()) for v, x in by_vote.items()} for c, by_vote in by_class.items()} for r, by_class in sums.items()}
        new = LabelModel((good + belief / 2) / (texts + belief), shares)
        moved = max(abs(new.weights[r][v] - model.weights[r][v]) for r in names for v in (1, 0, -1))
        model = new
        if moved < 1e-9:
            break
    return model


def verdicts(features: DataFrame) -> DataFrame:
    """Votes, ``quality`` (posterior), base_failed and kept beside the columns of stored ``features``."""
    model = fit(features)
    out = features.select("*", *[v.alias(f"vote_{r}") for r, v in rules().items()])
    out = out.withColumn("quality", model.quality({r: f"vote_{r}" for r in rules()})).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    return verdicts(stored(text_features(docs))).where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    features = text_features(docs)
    features = stored(features.select("row.doc_id", *features.columns[1:]))
    return verdicts(features).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
