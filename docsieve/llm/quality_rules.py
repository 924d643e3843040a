"""Quality rules: a learned decision list over document statistics.

Sequential covering on labelled documents: a rule against low quality starts empty
and takes the threshold condition with the best information gain until it covers no
good document of the growing part; the pruning part then decides how many of the
conditions stay.  Rules are added until the next one would be too imprecise.  The
list becomes one Spark expression of ordered conditions, readable as such.

The statistics of a text are found in one pass of an Arrow-batched function; the fit
sees a bounded sample of labelled documents, chosen by the hash of their ids.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

#: Labelled documents that the fit may see.
MAX_LABELLED = 20_000
COUNTS = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_distinct_words n_letters n_upper n_marks".split()
STATISTICS = ", ".join(f"{c} long" for c in COUNTS)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_UPPER, _MARKS = re.compile(r"[^\W\d_]+"), re.compile(r"[!?.,;:]")


def statistics_of(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of one text.

    Words are runs without ASCII white space; a line counts as repeated if it has a
    word and equals an earlier one; a word counts as repeated if it stands in a
    three-word window found twice or more.
    """
    text = text or ""
    words = _WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    lines = text.split("\n")
    for line in lines:
        if _WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated = until = 0
    for i, window in enumerate(windows):
        if window in often:
            repeated += i + 3 - max(i, until)
            until = i + 3
    letters = upper = 0
    for run in _UPPER.findall(text):
        letters += len(run)
        upper += len(run) if run.isupper() else sum(map(str.isupper, run)) if not run.islower() else 0
    return (
        len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), len(lines), dup, repeated,
        len(set(words)), letters, upper, len(_MARKS.findall(text)),
    )


def document_statistics(text: str | Column) -> Column:
    """The ``COUNTS`` of a text column as one struct; a null text has none of anything but one empty line."""

    @F.pandas_udf(STATISTICS)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t) for t in texts], columns=COUNTS, dtype="int64")

    return found(text)


def ratios(stats: str = "stats") -> dict[str, Column]:
    """The features that rules may test."""

    def share(a: str, b: str) -> Column:
        return F.col(f"{stats}.{a}") / F.greatest(F.col(f"{stats}.{b}"), F.lit(1))

    return {
        "words": F.col(f"{stats}.n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "word_chars"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "distinct_words": share("n_distinct_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "upper_case": share("n_upper", "n_letters"),
        "letters": share("n_letters", "word_chars"),
        "marks": share("n_marks", "n_words"),
    }


FEATURES = tuple(
    "words word_length symbols repeated_lines repeated_words distinct_words words_per_line upper_case letters marks".split()
)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column > self.threshold if self.above else column <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions]) if self.conditions else np.ones(len(x), bool)

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


def _best_condition(x: np.ndarray, bad: np.ndarray, cuts: int) -> tuple[float, Condition | None]:
    """The condition of largest gain: bad rows kept times the bits their share improves by."""
    p0, n0 = bad.sum(), len(bad) - bad.sum()
    best, found = 0.0, None
    before = np.log2(p0 / (p0 + n0))
    for i, feature in enumerate(FEATURES):
        values = np.unique(x[:, i])
        lower = np.arange(len(values) - 1)
        if len(lower) > cuts:
            quantiles = np.quantile(x[:, i], np.linspace(0, 1, cuts + 2)[1:-1], method="lower")
            lower = np.unique(np.searchsorted(values[:-2], quantiles))
        # Half-way between neighbouring values, so that unseen documents near either side stay on it.
        for threshold in (values[lower] + values[lower + 1]) / 2:
            high = x[:, i] > threshold
            for above, kept in ((True, high), (False, ~high)):
                p = (kept & bad).sum()
                if p:
                    gain = p * (np.log2(p / kept.sum()) - before)
                    if gain > best + 1e-9:
                        best, found = gain, Condition(feature, above, float(threshold))
    return best, found


def learn_rules(
    x: np.ndarray, bad: np.ndarray, min_precision: float = 0.9, max_rules: int = 12, max_conditions: int = 4, cuts: int = 48
) -> list[Rule]:
    """The decision list for rows of ``FEATURES`` and their labels, most telling rule
    first.  Two rows in three grow the rules, the third prunes and judges them; without
    bad or without good rows the list is empty."""
    rules: list[Rule] = []
    order = np.arange(len(x))
    grow, prune = order % 3 != 0, order % 3 == 0
    while len(rules) < max_rules and (bad & grow).any() and (~bad & grow).any() and (bad & prune).any():
        conditions: list[Condition] = []
        live = grow.copy()
        while len(conditions) < max_conditions and (live & ~bad).any():
            gain, condition = _best_condition(x[live], bad[live], cuts)
            if condition is None:
                break
            conditions.append(condition)
            live &= condition.holds(x)
        choices = []
        for k in range(1, len(conditions) + 1):
            covered = Rule(tuple(conditions[:k])).covers(x) & prune
            p = (covered & bad).sum()
            choices.append((2 * p - covered.sum()) / max(covered.sum(), 1))
        if not choices:
            break
        rule = Rule(tuple(conditions[: int(np.argmax(choices)) + 1]))
        covered = rule.covers(x)
        judged = covered & prune
        if not judged.any() or (judged & bad).sum() < min_precision * judged.sum():
            break
        rules.append(rule)
        grow, prune = grow & ~covered, prune & ~covered
    return rules


def rules_column(rules: list[Rule], features: dict[str, Column] | None = None) -> Column:
    """Number of the first rule that rejects a document, from 1; null for a document that none rejects."""
    features = features or ratios()
    out = F
    for number, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule.conditions:
            value = features[c.feature]
            holds = holds & (value > c.threshold if c.above else value <= c.threshold)
        out = out.when(holds, number)
    return out.otherwise(F.lit(None).cast("int")) if rules else F.lit(None).cast("int")


def labelled_sample(labels: DataFrame, size: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, bad) of at most ``size`` labelled ids, those with the smallest hashes; null ids
    and labels are left out, of repeated ids the worst label holds."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    worst = known.groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return worst.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def fit_rules(docs: DataFrame, labels: DataFrame, size: int = MAX_LABELLED, **settings) -> list[Rule]:
    """The decision list learned from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    ``size`` bounds the labelled documents that the driver sees as rows of numbers."""
    sample = labelled_sample(labels, size).withColumnRenamed("doc_id", "_id")
    known = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    rows = known.select("doc_id", "bad", document_statistics("text").alias("stats")).select("doc_id", "bad", *(
        c.alias(n) for n, c in ratios().items()
    ))
    seen = rows.toPandas().sort_values(["doc_id", *FEATURES], kind="stable")
    return learn_rules(seen[list(FEATURES)].to_numpy(float), seen["bad"].to_numpy(bool), **settings)


def base_failed(stats: str = "stats") -> Column:
    """Under 50 words, or more than half of them repeated."""
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def judge_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with ``stats``, ``rule`` (number of the rejecting rule or null) and ``kept``, in
    place of columns of these names.

    Null and empty texts fail the base test; every input row comes back once."""
    judged = docs.withColumn("stats", document_statistics("text"))
    return judged.withColumn("rule", rules_column(rules)).withColumn("kept", ~base_failed() & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that the base test and the rules learned from them keep."""
    whole = docs.select("text", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return judge_documents(whole, fit_rules(docs, labels, **settings)).where("kept").select("row.*")


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge_documents(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
    shown = [F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *shown, base_failed().alias("base_failed"), "kept")
