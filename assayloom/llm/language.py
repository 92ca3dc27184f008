"""Language identification in two steps: the family, then the language inside it.

The family comes from one-versus-rest linear support vector machines (squared hinge) over hashed byte
n-grams of the lower-cased whole text; square roots of shares keep texts of all lengths alike. Inside a
family every two languages have a machine of their own, trained on these two alone; the language
with most votes wins, and equal votes go to the larger sum of shares.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a null doc_id is
held out; no usable training row makes every text ``und``; texts of any length are read whole, in
pieces; equal votes and shares go to the first language by name; equal training rows count once, and
rows with equal doc_id are predicted each on its own; no rows give no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import held_out, labelled_texts, slices, with_rows

#: Hash cells of the n-gram counts.
CELLS = 4096
#: Training rows of each language at most; chosen by a hash of doc_id over all labelled rows.
TRAIN_PER_LANGUAGE = 400
#: Steepness that turns margins into shares.
SHARPNESS = 4.0
#: Texts whose language is less certain than this are rejected where a language is required.
LEAST_SCORE = 0.5
# The family of each language code. Codes not listed are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "turkic": "tr az kk uz ky tk tt",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
    "japonic": "ja",
    "koreanic": "ko",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv mg",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_PIECE = 1 << 20


def ngram_shares(text: str) -> np.ndarray:
    """Square roots of the shares of the hashed byte 1- to 3-grams."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(CELLS, np.int64)
    for at in range(0, len(data), _PIECE):  # n-grams that cross a cut are in the overlap
        part = data[at:at + _PIECE + 2].astype(np.uint32)
        one = part[:_PIECE]
        two = (part[:-1] << 8 | part[1:])[:_PIECE]
        three = (part[:-2] << 16 | part[1:-1] << 8 | part[2:])[:_PIECE]
        for size, grams in enumerate((one, two, three)):
            cells = ((grams + np.uint32(size << 24)) * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(cells, minlength=CELLS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights and bias (last) of a squared-hinge machine; y is -1 or 1.

    Accelerated gradient steps; classes weigh the same whatever their sizes.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    y = y.astype(np.float32)
    weight = cost * np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum()))
    weight = weight.astype(np.float32)
    # The trace bounds the curvature; texts resemble each other, so it is nearly tight.
    bound = np.float32(1e-3 + 2 * (weight * (x * x).sum(1)).sum())
    w = ahead = np.zeros(x.shape[1], np.float32)
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        after = ahead - (np.float32(1e-3) * ahead - 2 * ((weight * y * slack) @ x)) / bound
        ahead = after + np.float32(step / (step + 3)) * (after - w)
        w = after
    return w


def _one_versus_rest(x: np.ndarray, labels: list[str]) -> tuple[list[str], np.ndarray]:
    names, own = sorted(set(labels)), np.array(labels)
    if len(names) == 1:
        return names, np.zeros((1, x.shape[1] + 1))
    return names, np.stack([linear_svm(x, np.where(own == n, 1.0, -1.0)) for n in names])


def _shares(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    margins = SHARPNESS * (x @ weights[:, :-1].T + weights[:, -1])
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass(frozen=True)
class Pairs:
    """A machine for every two languages of a family: (first, second, weights), positive for first."""

    names: list[str]
    machines: list[tuple[int, int, np.ndarray]]

    @staticmethod
    def fit(x: np.ndarray, labels: list[str]) -> Pairs:
        names, own = sorted(set(labels)), np.array(labels)
        machines = []
        for i, first in enumerate(names):
            for j in range(i + 1, len(names)):
                two = (own == first) | (own == names[j])
                machines.append((i, j, linear_svm(x[two], np.where(own[two] == first, 1.0, -1.0))))
        return Pairs(names, machines)

    def vote(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language with most votes, and the mean of its shares against each other one."""
        n = len(self.names)
        votes, shares = np.zeros((len(x), n)), np.zeros((len(x), n))
        for i, j, weights in self.machines:
            share = 1 / (1 + np.exp(-2 * SHARPNESS * (x @ weights[:-1] + weights[-1])))
            votes[:, i] += share >= 0.5
            votes[:, j] += share < 0.5
            shares[:, i] += share
            shares[:, j] += 1 - share
        best = (votes * (n + 1) + shares).argmax(1)
        mean = shares[np.arange(len(x)), best] / (n - 1) if n > 1 else np.ones(len(x))
        return best, mean


@dataclass(frozen=True)
class LanguageModel:
    """Machines for the families, and for every two languages of each family."""

    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, Pairs]

    @staticmethod
    def fit(x: np.ndarray, languages: list[str]) -> LanguageModel:
        family = [_FAMILY_OF.get(code, code) for code in languages]
        names, weights = _one_versus_rest(x, family)
        inner = {}
        for name in names:
            own = [i for i, f in enumerate(family) if f == name]
            inner[name] = Pairs.fit(x[own], [languages[i] for i in own])
        return LanguageModel(names, weights, inner)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        outer = _shares(x, self.family_weights)
        best = outer.argmax(1)
        names, score = np.empty(len(x), object), np.zeros(len(x))
        for i in np.unique(best):
            own = np.flatnonzero(best == i)
            pairs = self.languages[self.families[i]]
            language, share = pairs.vote(x[own])
            names[own] = np.array(pairs.names, object)[language]
            score[own] = outer[own, i] * share
        return list(names), score


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        kept = [(c, ngram_shares(t)) for c, t in zip(
            batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if has_letter(t)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in kept], pa.string()),
             pa.array([v.astype(np.float16).tobytes() for _, v in kept], pa.binary())],
            ["lang", "vector"],
        )


def train_language_model(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE):
    """A model from rows that are not held out and have a language; None without such rows."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    # At most per_language vectors of CELLS half floats for each language.
    rows = labelled_texts(usable, "lang", per_language).mapInArrow(
        _vectors, "lang string, vector binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["vector"])))  # the order of arrival plays no part
    x = np.stack([np.frombuffer(r["vector"], np.float16) for r in rows]).astype(np.float32)
    return LanguageModel.fit(x, [r["lang"] for r in rows])


def _predictor(model: LanguageModel | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            if known:
                found, score = model.predict(np.stack([ngram_shares(texts[i]) for i in known]))
                scores[known] = score
                for i, name in zip(known, found):
                    names[i] = name
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores)],
                [*kept, "lang_pred", "score"],
            )

    return predict


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text decides."""
    rows = docs.select(
        F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string"),
    )
    return rows.mapInArrow(
        _predictor(model), "doc_id bigint, held_out boolean, lang_pred string, score double"
    )


def keep_known(
    docs: DataFrame, model: LanguageModel | None, least: float = LEAST_SCORE
) -> DataFrame:
    """The rows of ``docs`` in one learned language, all columns as they are.

    Texts without letters and texts whose best language scores below ``least`` go.
    """
    found = with_rows(docs, _predictor(model), "lang_pred string, score double")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
