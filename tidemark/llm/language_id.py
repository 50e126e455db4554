"""Language identification of documents from word labels of a linear-chain CRF.

The CRF is fitted on a bounded sample of labelled documents. Their words, cut into short runs
and shuffled across languages, make code-switched training text, so that transitions are learned.
Prediction labels the words of whole texts by forward-backward; a document's language is the one
of the highest mean marginal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import crf
from tidemark.llm.common import by_bytes, id_remainder, table, texts_of, unit

UNKNOWN = "und"
#: Weights of a model stay below 2 GB.
MOST_LABELS = 4_000


@dataclass(frozen=True)
class Settings:
    """The sample: at most ``sample`` documents in all (one for each language at least), evenly over the
    languages and chosen by a hash of the id, and of each a stretch of ``stretch`` characters from a hashed place."""

    sample: int = 1600
    stretch: int = 1600
    run: int = 24
    seed: int = 3


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on documents with text and lang. Without any there are no languages to predict; with more
    labels than the weights of a model can hold it is an error."""
    known = docs.filter("text is not null and lang is not null")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LABELS + 1).collect()
    languages = sorted(r["lang"] for r in counts)
    if len(languages) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages")
    if not languages:
        return Model([], np.zeros((1 << crf.BITS, 0)), np.zeros((0, 0)))
    quota = max(1, settings.sample // len(languages))
    mark = F.xxhash64(F.lit(settings.seed), F.col("doc_id"), F.crc32(F.col("text").cast("binary")))
    pick = Window.partitionBy("lang").orderBy("mark", "doc_id")
    # Marks low enough for about twice the quota are ranked, so what is ranked doesn't grow with
    # the table.
    low = unit(F.col("mark")) < 2.0 * quota / F.col("n")
    place = F.pmod(F.col("mark"), F.greatest(F.length("text") - settings.stretch, F.lit(1))).cast("int") + 1
    # One row a label, at most MOST_LABELS, meets the documents without moving them.
    shares = F.broadcast(docs.sparkSession.createDataFrame(counts, "lang string, n bigint"))
    rows = known.select("doc_id", "text", "lang", mark.alias("mark")).join(shares, "lang").filter(low).select(
        "doc_id", "lang", "mark", F.col("text").substr(place, F.lit(settings.stretch)).alias("part")
    ).withColumn("r", F.row_number().over(pick)).filter(F.col("r") <= quota).orderBy("mark", "lang", "doc_id").toArrow().to_pylist()
    rng = np.random.default_rng(settings.seed)
    runs: list[tuple[int, list[str]]] = []
    for row in rows:
        words = crf.words_of(row["part"].lower())
        label = languages.index(row["lang"])
        runs += [(label, words[i:i + settings.run]) for i in range(0, len(words), settings.run)]
    stream = [runs[i] for i in rng.permutation(len(runs)).tolist()]
    labels = np.array([label for label, run in stream for _ in run], np.int64)
    weights, moves = crf.train([w for _, run in stream for w in run], labels, len(languages))
    return Model(languages, weights.astype(np.float32), moves)


class Labeller:
    """Scores of words, kept in a bounded memo, and marginals of texts."""

    def __init__(self, model: Model, memo: int = 350_000):
        self.model, self.memo = model, memo
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words, and the number of words of each text."""
        lists = [crf.words_of(t.lower()) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        words = [w for l in lists for w in l]
        if len(self.known) > self.memo:
            self.known, self.scores = {}, self.scores[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            n = len(self.known)
            self.known.update(zip(new, range(n, n + len(new))))
            self.scores = np.concatenate([self.scores, crf.word_scores(new, self.model.weights)])
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        begins = (np.cumsum(counts) - counts)[counts > 0]
        return crf.marginals(self.scores[index], begins, self.model.moves), counts


SPANS = "array<struct<begin: int, end: int, lang: string>>"


def predict(
    docs: DataFrame, model: Model, keep: list[str], spans: bool = False,
    names: tuple[str, str, str] = ("lang_pred", "score", "spans"),
) -> DataFrame:
    """Columns ``keep`` of every document, lang_pred and score; with ``spans`` also the runs of
    words (numbered from 0) by their own most likely language.

    lang_pred is ``und`` and score 0 if the text is null or has no letter, or no language is
    known; else score is the mean marginal of lang_pred, the earlier language in a tie. Repeated rows are
    predicted alike. Nothing but the text decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = len(keep)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, languages = Labeller(shared.value), shared.value.languages
        for batch in batches:
            texts = texts_of(batch.column(width))
            for begin, end in by_bytes(texts, 1 << 21):
                langs, scores, runs = [UNKNOWN] * (end - begin), np.zeros(end - begin), None
                if languages:
                    p, counts = labeller.marginals(texts[begin:end])
                    filled = np.flatnonzero(counts)
                    if len(filled):
                        starts = (np.cumsum(counts) - counts)[filled]
                        mean = np.add.reduceat(p, starts, axis=0) / counts[filled, None]
                        best = mean.argmax(axis=1)
                        scores[filled] = np.clip(mean[np.arange(len(best)), best], 0, 1)
                        for i, b in zip(filled.tolist(), best.tolist()):
                            langs[i] = languages[b]
                    runs = _runs(p, counts, languages) if spans else None
                columns = [c.slice(begin, end - begin) for c in batch.columns[:width]]
                columns += [pa.array(langs, pa.string()), pa.array(scores)]
                if spans:
                    columns.append(pa.array(runs or [[]] * (end - begin), pa.list_(pa.struct(
                        [("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, [*keep, *names][:len(columns)])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("llm_text"))
    added = f"{names[0]} string, {names[1]} double" + (f", {names[2]} {SPANS}" if spans else "")
    return rows.mapInArrow(label, T.StructType([*rows.schema.fields[:width], *T.StructType.fromDDL(added).fields]))


def _runs(p: np.ndarray, counts: np.ndarray, names: list[str]) -> list[list[dict]]:
    best, out, at = p.argmax(axis=1) if len(p) else np.zeros(0, int), [], 0
    for n in counts.tolist():
        own = best[at:at + n]
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n] if n else [0]
        out.append([{"begin": b, "end": e, "lang": names[own[b]]} for b, e in zip(cuts, cuts[1:])])
        at += n
    return out


def held_out(doc_id: Column) -> Column:
    """Remainder 1 of the id's crc32 modulo 3; false for a null id."""
    return F.coalesce(id_remainder(doc_id, 3) == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, with all columns whatever their names, whose language is known with a score of ``least`` or more."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    rows = predict(docs.select(F.struct("*").alias("row"), "text"), model, ["row"])
    return rows.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
