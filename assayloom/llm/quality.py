"""A quality classifier as a sparse ensemble of rules.

Boosted shallow trees over text statistics give conjunctive rules (their paths); a lasso logistic
fit keeps a few of them with weights; the kept rules become one Spark column expression.

Defined cases: null and empty texts have all statistics zero and a score like any other;
labels that are null or held out teach nothing; without both labels in the training rows every
score is their share (0.5 without rows); equal labels of equal rows count once, different ones each;
a null doc_id is held out; texts of any length are read whole; of equally good cuts the first statistic
counts; no documents give no rows; extra columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import as_bytes, held_out, labelled_texts, slices, with_rows

#: Training rows of each label at most; chosen by a hash of doc_id over all labelled rows.
TRAIN_PER_LABEL = 3000
#: A text counts as good from this score on.
THRESHOLD = 0.3
STATISTICS = (
    "log_chars", "words", "mean_word", "letters", "upper", "digits", "spaces", "marks",
    "odd_marks", "stops", "distinct_words", "top_word", "marked_ends", "distinct_runs",
    "lines", "distinct_lines", "capitals", "short_words", "long_words", "bars",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "spaces": b" \t\n\r\x0b\x0c",
    "marks": b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "odd_marks": b"#$%&*+<=>@[\\]^_`{|}~!",
    "stops": b".,;:?", "bars": b"|",
}
_ENDS = tuple(bytes([x]) for x in _CLASSES["odd_marks"])
_TABLES = {n: np.isin(np.arange(256), list(v)) for n, v in _CLASSES.items()}
_WORD_CHUNK = 1 << 16


def statistics(text: bytes) -> list[float]:
    """The values of STATISTICS; shares are of bytes, words or lines."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = {name: float(counts[t].sum()) / n for name, t in _TABLES.items()}
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    m = len(words)
    if not m:
        words = [b""]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    often = Counter(words)
    runs = len(set(zip(words, words[1:], words[2:]))) / (m - 2) if m > 2 else 1.0
    letters = 1.0 - share["digits"] - share["spaces"] - share["marks"]
    values = {
        **share, "log_chars": float(np.log1p(n)), "words": float(m),
        "mean_word": float(sizes.mean()), "letters": letters,
        "distinct_words": len(often) / len(words),
        "top_word": max(often.values()) / len(words),
        "marked_ends": sum(w.endswith(_ENDS) for w in words) / len(words),
        "distinct_runs": runs, "lines": float(len(lines)),
        "distinct_lines": len(set(lines)) / max(1, len(lines)),
        "capitals": sum(w.isupper() for w in words) / len(words),
        "short_words": float((sizes <= 3).mean()), "long_words": float((sizes >= 12).mean()),
    }
    return [values[name] for name in STATISTICS]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values = np.array([statistics(t) for t in as_bytes(batch.column("text"))])
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept),
             *(pa.array(values[:, i]) for i in range(len(STATISTICS)))],
            [*kept, *STATISTICS],
        )


_MEASURED = ", ".join(f"{s} double" for s in STATISTICS)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the statistics of the whole text of every row."""
    return docs.select(
        F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string"),
    ).mapInArrow(_measure, "doc_id bigint, held_out boolean, " + _MEASURED)


#: A condition: statistic, True for "at most" and False for "above", limit.
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


def _best_cut(column: np.ndarray, gain: np.ndarray, weight: np.ndarray, least: int):
    """The cut with the most second-order gain, leaving ``least`` rows on each side."""
    order = np.argsort(column, kind="stable")
    x, g, h = column[order], np.cumsum(gain[order]), np.cumsum(weight[order])
    at = np.flatnonzero(x[:-1] < x[1:])
    at = at[(at + 1 >= least) & (len(x) - at - 1 >= least)]
    if not len(at):
        return 0.0, 0.0
    value = g[at] ** 2 / (h[at] + 1) + (g[-1] - g[at]) ** 2 / (h[-1] - h[at] + 1)
    value -= g[-1] ** 2 / (h[-1] + 1)
    best = int(value.argmax())
    return float(value[best]), float((x[at[best]] + x[at[best] + 1]) / 2)


def _grow(x, gain, weight, rows, depth, least, path: Rule, rules: list, out: np.ndarray) -> None:
    """A tree on the residuals: collects the path of every node, writes leaf steps to ``out``."""
    if path:
        rules.append(path)
    cuts = [_best_cut(x[rows, j], gain[rows], weight[rows], least) for j in range(x.shape[1])]
    j = max(range(len(cuts)), key=lambda i: cuts[i][0]) if depth else 0
    if not depth or cuts[j][0] <= 1e-6:
        out[rows] = gain[rows].sum() / (weight[rows].sum() + 1)
        return
    low = x[rows, j] <= cuts[j][1]
    for side, part in ((True, rows[low]), (False, rows[~low])):
        _grow(x, gain, weight, part, depth - 1, least, (*path, (j, side, cuts[j][1])), rules, out)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3) -> list[Rule]:
    """Paths of boosted trees, each once."""
    raw, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    least = max(5, len(y) // 200)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        step = np.zeros(len(y))
        _grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, least, (), rules, step)
        raw += 0.3 * step
    return list(dict.fromkeys(rules))


def applies(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for j, at_most, limit in rule:
            out[:, k] *= (x[:, j] <= limit) if at_most else (x[:, j] > limit)
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600):
    """Weights and bias by accelerated proximal gradient; the bias is free."""
    n = len(y)
    top = np.ones(x.shape[1])
    for _ in range(20):  # largest curvature, by power steps
        top = x.T @ (x @ (top / np.linalg.norm(top)))
    bound = (1.05 * np.linalg.norm(top) + n) / (4 * n)
    w = ahead = np.zeros(x.shape[1])
    b = b_ahead = float(np.log(y.mean() / (1 - y.mean())))
    for step in range(steps):
        error = 1 / (1 + np.exp(-(x @ ahead + b_ahead))) - y
        after = ahead - x.T @ error / n / bound
        after = np.sign(after) * np.maximum(0, np.abs(after) - penalty / bound)
        b_after = b_ahead - error.mean() / bound
        rate = step / (step + 3)
        ahead, b_ahead = after + rate * (after - w), b_after + rate * (b_after - b)
        w, b = after, b_after
    return w, b


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; ``score`` compiles them into a column."""

    rules: list[Rule]
    weights: list[float]
    bias: float

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for j, at_most, limit in rule:
                value = F.col(STATISTICS[j])
                holds = holds & ((value <= limit) if at_most else (value > limit))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, share: float, penalty: float = 1e-3) -> RuleModel:
    """``share``: of good texts among all labelled rows; the sample may hold another share."""
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        return RuleModel([], [], float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    w, b = lasso_logistic(applies(rules, x), y, penalty)
    kept = [(r, float(v)) for r, v in zip(rules, w) if v != 0]
    own = float(y.mean())
    shift = np.log(share / (1 - share)) - np.log(own / (1 - own))
    return RuleModel([r for r, _ in kept], [v for _, v in kept], float(b + shift))


def train_rule_model(
    docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL
) -> RuleModel:
    """A model from labelled rows that are not held out, on a bounded sample of each label."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select(
        "doc_id", F.col("quality").cast("int").alias("quality")
    )
    ids = docs.select("doc_id").distinct()
    usable = usable.join(ids, "doc_id", "left_semi")
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    # At most per_label rows of statistics for each label.
    rows = labelled_texts(docs, "quality", per_label, usable).mapInArrow(
        _measure, "quality int, " + _MEASURED).collect()
    data = np.array(sorted(tuple(r) for r in rows)).reshape(-1, 1 + len(STATISTICS))
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit_rules(data[:, 1:], data[:, 0], share)


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = measured(docs).withColumn("score", model.score())
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns as they are."""
    return with_rows(docs, _measure, _MEASURED).where(model.score() >= threshold).select("row.*")
