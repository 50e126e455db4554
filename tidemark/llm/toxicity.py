"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order. Each has a logistic model over the hashed distinct words
of the whole text and their beginnings (four letters), and over the log-odds of all earlier categories. For training, these earlier
probabilities are out of fold: predicted by models that did not see the document. The models are
fitted on a bounded sample of labelled documents; all documents are predicted in their tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, unit

WORD = re.compile(r"[^\W\d_]+")
BITS = 18


@dataclass(frozen=True)
class Settings:
    """At most ``sample`` labelled documents train the chain, chosen by a hash of the id. Words in
    fewer than ``least_documents`` of them weigh nothing."""

    sample: int = 8_000
    least_documents: int = 6
    folds: int = 5
    epochs: int = 8
    batch: int = 128
    rate: float = 0.15
    decay: float = 1e-3
    seed: int = 23


@dataclass(frozen=True)
class Model:
    """Row j of ``weights`` and ``bias``: category j; ``chain[j]``: weights of the log-odds of the
    categories before it. ``cut``: probability from which the last category holds."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    chain: np.ndarray
    cut: float


class Features:
    """Hashed distinct words of a text and their beginnings; a bounded memo keeps hashes."""

    def __init__(self, memo: int = 200_000):
        self.memo, self.known = memo, {}

    def of(self, text: str) -> np.ndarray:
        words = set(WORD.findall(text.lower()))
        if len(self.known) > self.memo:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = _hash(w) << BITS | _hash("<" + w[:4])
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return np.unique(np.concatenate([both >> BITS, both & ((1 << BITS) - 1)]))


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Rows:
    """Sparse binary rows; an empty row is allowed."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), self.size)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.flat], minlength=len(self.size))

def fit_logistic(
    rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, width: int, settings: Settings,
) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and weights of the dense columns, by AdaGrad from zero."""
    n, rng = len(y), np.random.default_rng(settings.seed)
    w, v, b = np.zeros(width), np.zeros(dense.shape[1]), float(_odds(np.array((y.sum() + 1) / (n + 2))))
    sw, sv, sb = np.full(width, 1e-4), np.full(len(v), 1e-4), 1e-4
    for _ in range(settings.epochs):
        order = rng.permutation(n)
        for begin in range(0, n, settings.batch):
            at = order[begin:begin + settings.batch]
            x = _Rows([rows[i] for i in at.tolist()])
            g = (_sigmoid(x.times(w) + dense[at] @ v + b) - y[at]) / len(at)
            touched, place = np.unique(x.flat, return_inverse=True)
            gw = np.bincount(place, g[x.owner], minlength=len(touched)) + settings.decay * w[touched]
            gv, gb = dense[at].T @ g + settings.decay * v, float(g.sum())
            sw[touched] += gw * gw
            sv, sb = sv + gv * gv, sb + gb * gb
            w[touched] -= settings.rate * gw / np.sqrt(sw[touched])
            v -= settings.rate * gv / np.sqrt(sv)
            b -= settings.rate * gb / sb ** 0.5
    return w, b, v


def train(
    names: list[str], rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, settings: Settings = Settings(),
) -> Model:
    """Fit the chain. ``labels``: one row a document, one column a category; ``folds``: fold of each."""
    k, width = len(names), 1 << BITS
    seen = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=width)
    # Only words that weigh keep a column while fitting.
    columns = np.flatnonzero(seen >= settings.least_documents)
    place = np.full(width, -1, np.int64)
    place[columns] = np.arange(len(columns))
    rows = [place[r][place[r] >= 0] for r in rows]
    weights, bias, chain = np.zeros((k, width)), np.zeros(k), np.zeros((k, k))
    earlier, p = np.zeros((len(rows), 0)), np.zeros(len(rows))
    for j in range(k):
        y = labels[:, j].astype(np.float64)
        p = np.zeros(len(rows))
        for f in range(settings.folds):
            out, rest = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
            w, b, v = fit_logistic([rows[i] for i in rest.tolist()], earlier[rest], y[rest], len(columns), settings)
            p[out] = _sigmoid(_Rows([rows[i] for i in out.tolist()]).times(w) + earlier[out] @ v + b)
        w, b, v = fit_logistic(rows, earlier, y, len(columns), settings)
        weights[j, columns], bias[j], chain[j, :j] = w, b, v
        earlier = np.column_stack([earlier, _odds(p)])
    return Model(names, weights, bias, chain, _cut(p, labels[:, -1] if k else np.zeros(0)))


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """Out-of-fold probability with the best F1, the one nearest to 0.5 of equals."""
    best = (-1.0, 0.0, 0.5)
    for c in np.arange(0.05, 0.96, 0.05):
        said = p >= c
        score = 2 * (said & (y == 1)).sum() / max(1, said.sum() + (y == 1).sum())
        best = max(best, (round(float(score), 6), -abs(c - 0.5), float(c)))
    return best[2]


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], settings: Settings = Settings()) -> Model:
    """``labels``: doc_id and what the category columns (0 or 1) are made from. Rows without an id
    or with a null category don't train; several labels of a document count as their greatest."""
    names = [n for n, _ in categories]
    mark = F.xxhash64(F.lit(settings.seed), F.col("doc_id"))
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[c.cast("int").alias(n) for n, c in categories]).dropna()
    chosen = chosen.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    # Marks low enough for about twice the sample are sorted, so what is sorted doesn't grow.
    share = 2.0 * settings.sample / max(1, chosen.count())
    chosen = chosen.filter(unit(mark) < share).orderBy(mark, "doc_id").limit(settings.sample)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.of(t.as_py() or "").tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64())), *batch.columns[2:]], ["doc_id", "found", *names])

    # The sample is bounded, so it may be broadcast to meet the documents.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").mapInArrow(
        read, "doc_id bigint, found array<bigint>, " + ", ".join(f"`{n}` int" for n in names))
    found = rows.toArrow().to_pandas().sort_values("doc_id", kind="stable")
    found = found.drop_duplicates("doc_id")
    folds = np.array([zlib.crc32(str(i).encode()) % settings.folds for i in found["doc_id"]], np.int64)
    return train(names, [np.asarray(f, np.int64) for f in found["found"]], found[names].to_numpy().reshape(-1, len(names)), folds, settings)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, a probability p_<category> for each, and a boolean named as the last category.

    A text that is null or has no word gets the models' base rates and is never flagged. Repeated
    rows are predicted alike; other columns are ignored.
    """
    names, shared = model.names, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, features = shared.value, Features()
        weights = np.ascontiguousarray(m.weights.T)
        for batch in batches:
            rows = [features.of(t.as_py() or "") for t in batch.column(1)]
            base = np.stack([weights[r].sum(axis=0) for r in rows]) + m.bias if rows else np.zeros((0, len(names)))
            p = np.zeros_like(base)
            for j in range(len(names)):
                p[:, j] = _sigmoid(base[:, j] + _odds(p[:, :j]) @ m.chain[j, :j])
            flag = (p[:, -1] >= m.cut) & np.array([len(r) > 0 for r in rows], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p[:, j]) for j in range(len(names))], pa.array(flag)],
                ["doc_id", *[f"p_{n}" for n in names], names[-1]])

    schema = "doc_id bigint, " + ", ".join(f"`p_{n}` double" for n in names) + f", `{names[-1]}` boolean"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The categories that the label table has, the broader one first.
    categories = [("low_quality", 1 - F.col("quality")), ("toxic", F.col("toxic"))]
    return predict(docs, fit(docs, table(spark, sf_dir, "labels"), categories))
