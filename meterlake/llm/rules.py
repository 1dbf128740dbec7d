"""Operator 7: quality classifier as a sparse ensemble of rules (after RuleFit).

Statistics of a text are column expressions. On a bounded sample of labelled rows
(`sample_rows`, by smallest hash of the id) small regression trees are boosted; every path
from a root is a conjunctive rule over the statistics; lasso-penalised logistic regression
keeps a few rules with weights. The kept rules are compiled back into one column expression,
so scoring is a single native pass over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

_SPACE = "[ \\t-\\r]"
#: Statistics by name; `c__` columns are made by `statistics` first. None of them sees labels, language, source or id.
NAMES = ("n_words", "word_chars", "upper", "marks", "bars", "bangs", "stops", "digits", "same_as_before", "distinct", "lines_per_word")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with one double column `s__<name>` per statistic; null and empty texts give zeros."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, f"{_SPACE}+"), "")
    same = lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))
    # words are bound once per text; a column of them would be split anew for each element of the lambda
    of_words = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), same(w).alias("same"), F.size(F.array_distinct(w)).alias("different")))[0]
    out = docs.withColumn("c__w", of_words)
    n, chars = F.col("c__w.n"), F.length(text)
    share = lambda pattern: (F.size(F.split(text, pattern)) - 1) / F.greatest(chars, F.lit(1))
    per_word = lambda c: c / F.greatest(n, F.lit(1))
    values = {
        "n_words": n, "word_chars": per_word(F.col("c__w.chars")),
        "upper": share("[A-Z]"), "marks": share("[#*$%&<>^~=_]"), "bars": share("[|]"), "bangs": share("!"), "stops": share("[.]"), "digits": share("[0-9]"),
        "same_as_before": per_word(F.col("c__w.same")), "distinct": per_word(F.col("c__w.different")), "lines_per_word": per_word(F.size(F.split(text, "\n"))),
    }
    return out.select(*docs.columns, *[values[k].cast("double").alias(f"s__{k}") for k in NAMES])


#: One condition: (statistic, is_above, threshold); a rule holds where all of its conditions do.
Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class RuleModel:
    """Intercept and (rule, weight) pairs; logistic."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """Score of the `s__` columns, between 0 and 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, threshold in rule:
                c = F.col(f"s__{name}")
                holds = holds & (c > threshold if above else c <= threshold)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(x: np.ndarray, residual: np.ndarray, depth: int, least: int, path: Rule, out: list[Rule], fitted: np.ndarray, rows: np.ndarray, names: list[str]) -> None:
    """Grow a least-squares tree; every node below the root adds its path to `out`, leaves fill `fitted`."""
    if path:
        out.append(path)
    r = residual[rows]
    best, cut = 1e-9, None
    if depth and len(rows) >= 2 * least:
        for j in range(x.shape[1]):
            values = x[rows, j]
            for threshold in np.unique(np.quantile(values, np.linspace(0.02, 0.98, 25))):
                left = values <= threshold
                a = int(left.sum())
                if a < least or len(rows) - a < least:
                    continue
                gain = r[left].sum() ** 2 / a + r[~left].sum() ** 2 / (len(rows) - a) - r.sum() ** 2 / len(rows)
                if gain > best:
                    best, cut = gain, (j, float(threshold))
    if cut is None:
        fitted[rows] = r.mean()
        return
    j, threshold = cut
    left = x[rows, j] <= threshold
    for above, part in ((False, rows[left]), (True, rows[~left])):
        _paths(x, residual, depth - 1, least, (*path, (names[j], above, threshold)), out, fitted, part, names)


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = NAMES, *, trees: int = 24, depth: int = 3, penalty: float = 0.002, rounds: int = 500, seed: int = 7) -> RuleModel:
    """Rules of boosted trees on rows x (statistics) and y (0 or 1), weighted by lasso logistic regression."""
    base = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    intercept = float(np.log(base / (1 - base)))
    if len(y) < 20 or y.min() == y.max():
        return RuleModel(intercept, [])
    rng, score, found = np.random.default_rng(seed), np.full(len(y), intercept), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        columns = np.sort(rng.choice(len(names), max(2, len(names) * 2 // 3), replace=False))
        fitted = np.zeros(len(y))
        _paths(x[:, columns], y - p, depth, max(5, len(y) // 200), (), found, fitted, np.arange(len(y)), [names[c] for c in columns])
        score += 2.0 * fitted
    rules = list(dict.fromkeys(found))
    at = {n: i for i, n in enumerate(names)}
    holds = np.ones((len(y), len(rules)))
    for k, rule in enumerate(rules):
        for name, above, threshold in rule:
            v = x[:, at[name]]
            holds[:, k] *= v > threshold if above else v <= threshold
    if not rules:
        return RuleModel(intercept, [])
    # accelerated proximal gradient; the intercept isn't penalised
    step = 1 / (0.25 * (np.linalg.norm(holds, 2) ** 2 / len(y) + 1))
    w, b, v, c, t = np.zeros(len(rules)), intercept, np.zeros(len(rules)), intercept, 1.0
    for _ in range(rounds):
        wrong = 1 / (1 + np.exp(-(holds @ v + c))) - y
        new_w = v - step * (holds.T @ wrong / len(y))
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_b = c - step * wrong.mean()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new_w + (last - 1) / t * (new_w - w), new_b + (last - 1) / t * (new_b - b)
        w, b = new_w, new_b
    return RuleModel(float(b), [(rule, float(weight)) for rule, weight in zip(rules, w, strict=True) if abs(weight) > 1e-4])


def training_rows(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of up to `sample_rows` labelled rows that aren't held out, in order of their hashes.

    The rows are those with the smallest hash of the id, so the ids that are broadcast to the
    scan of the texts are bounded, and only statistics reach the driver. An id that repeats
    counts once, with its smallest label and the text of smallest hash; null ids, labels other
    than 0 and 1 and labels without a document are left out.
    """
    ids = labels.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("t__id")).agg(F.min(F.col(label_col).cast("double")).alias("t__y"))
    chosen = ids.orderBy(F.xxhash64("t__id"), "t__id").limit(sample_rows).collect()
    if not chosen:
        return np.zeros((0, len(NAMES))), np.zeros(0)
    few = docs.sparkSession.createDataFrame(chosen, ids.schema)
    rows = docs.select(F.col(id_col).alias("t__id"), F.col(text_col).alias("t__text")).join(F.broadcast(few), "t__id")
    got = statistics(rows, "t__text").groupBy("t__id").agg(F.min(F.struct(F.xxhash64("t__text").alias("h"), "t__y", *[f"s__{k}" for k in NAMES])).alias("r"))
    got = got.select(F.xxhash64("t__id").alias("h"), "t__id", "r.t__y", *[f"r.s__{k}" for k in NAMES]).orderBy("h", "t__id").collect()
    return np.array([r[3:] for r in got], float).reshape(-1, len(NAMES)), np.array([r[2] for r in got], float)


def score(docs: DataFrame, model: RuleModel, *, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """(id, held_out, score double, predicted int) of every row; empty and null texts are scored by their zero statistics.

    Repeated rows come out once each, a null id isn't held out, other columns may have any
    name, and an empty table gives no rows.
    """
    made = statistics(docs.select(id_col, text_col), text_col).select(id_col, held_out(id_col).alias("held_out"), model.column().alias("score"))
    return made.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """`score` with a model fitted on the labelled rows that aren't held out.

    With fewer than 20 such rows, or labels all alike, every score is the share of label 1 (one half without any).
    """
    return score(docs, fit(*training_rows(docs, labels, **options)))
