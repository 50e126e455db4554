"""Language-model scoring with a class bigram whose classes come from exchange clustering.

P(word | word before) = P(class | class before) * P(unit | class) * P(word | unit).

The units that are clustered are the ``frequent`` most frequent words, each on its own, and
``endings`` groups of all other words, seen in training or not, by a hash of the last bytes.
So the units are bounded and may be broadcast, while every word has a class and its own count.
Counts of words beyond the frequent ones stay in a table and meet the texts by a shuffle join.

Exchange: every unit in turn moves to the class that raises the likelihood of the class bigram
most. As in distributed clustering, one round judges all units of one half against the class
counts of the round before; rounds read a table of unit bigrams, stored by unit, and shuffle nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_remainder, stored, table

#: The end of a text; no word holds a line feed.
END = b"\n"


@dataclass(frozen=True)
class Settings:
    """``frequent`` and ``endings`` bound the units; words that occur fewer than ``least`` times have
    too few neighbours for a class of their own and, like those of more than ``longest`` bytes,
    are never among the frequent ones. ``discount`` smooths P(word | unit), ``strength`` the transitions."""

    frequent: int = 40_000
    least: int = 5
    endings: int = 8_192
    letters: int = 4
    longest: int = 48
    classes: int = 48
    rounds: int = 8
    discount: float = 0.5
    strength: float = 20.0
    held_modulus: int = 7
    held_remainder: int = 2


def words(text: str | None) -> list[bytes]:
    """UTF-8 words in lower case (A-Z only) and the end. Bytes split at the same white space."""
    found = text.encode().lower().split() if text else []
    found.append(END)
    return found


def word_counts(docs: DataFrame, flush: int = 250_000) -> DataFrame:
    """word, c: counts over whole texts, combined in the task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py()))
                if len(seen) > flush:
                    yield _counted(seen)
                    seen = Counter()
        if seen:
            yield _counted(seen)

    return docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


class Units:
    """Words to units; pickled to the workers with at most ``frequent`` words."""

    def __init__(self, frequent: list[bytes], settings: Settings):
        self.index = {w: i for i, w in enumerate(frequent)}
        self.n_frequent, self.endings, self.letters = len(frequent), settings.endings, settings.letters

    def __len__(self) -> int:
        return self.n_frequent + self.endings

    def ending(self, word: bytes) -> int:
        return self.n_frequent + zlib.crc32(word[-self.letters:]) % self.endings

    def of(self, found: list[bytes]) -> np.ndarray:
        units = np.fromiter(map(self.index.get, found, [-1] * len(found)), np.int32, len(found))
        rare = np.flatnonzero(units < 0)
        units[rare] = [self.ending(found[i]) for i in rare.tolist()]
        return units


def unit_bigrams(docs: DataFrame, units: Units, buckets: int) -> DataFrame:
    """bucket, side, unit, other, n: neighbours of units in training texts, a text's first
    word coming after an end. Side 0 counts followers, side 1 those before. Packed in arrays."""
    width = len(units)
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, end = shared.value.of, shared.value.index[END]
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column(0):
                u = of(words(text.as_py())).astype(np.int64)
                held.append(np.concatenate([[end], u[:-1]]) * width + u)
                size += len(u)
                if size > 2_000_000:
                    yield from packed(held)
                    held, size = [], 0
        if held:
            yield from packed(held)

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        for side in (0, 1):
            own = codes // width if side == 0 else codes % width
            key = codes if side == 0 else own * width + codes // width
            bucket = own % buckets
            order = np.lexsort((key, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int32)
            filled = np.flatnonzero(np.diff(cuts))
            for b in filled.tolist():
                at = order[cuts[b]:cuts[b + 1]]
                yield _lists(b, side, key[at], n[at])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is held is summed up now and then, so it grows with distinct bigrams only.
        parts: dict[tuple[int, int], list] = {}
        held = 0
        for batch in batches:
            for b, side, key, n in zip(*[c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns)]):
                parts.setdefault((b, side), []).append((key.values.to_numpy(), n.values.to_numpy()))
                held += len(key)
                if held > 3_000_000:
                    parts = {k: [_summed(found)] for k, found in parts.items()}
                    held = 0
        for (b, side), found in sorted(parts.items()):
            yield _lists(b, side, *_summed(found))

    schema = "bucket int, side int, keys array<bigint>, ns array<bigint>"
    return docs.select("text").mapInArrow(count, schema).repartition(buckets, "bucket").mapInArrow(merge, schema)


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in found])).astype(np.int64)


def _lists(bucket: int, side: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    ends = pa.array([0, len(keys)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([side], pa.int32()),
         pa.ListArray.from_arrays(ends, pa.array(keys, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))],
        ["bucket", "side", "keys", "ns"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_classes(
    follow: np.ndarray, before: np.ndarray, own: np.ndarray, matrix: np.ndarray, chunk: int = 256,
) -> np.ndarray:
    """The class of highest likelihood of each unit, all others staying where they are.

    ``follow`` and ``before``: counts of neighbours of the units (rows) by their class; ``own``: the
    units' present classes; ``matrix``: class bigram counts, which these units are part of.
    Ties keep the present class, else the lower one.
    """
    k = matrix.shape[0]
    total = matrix.sum(axis=1)
    best = own.copy()
    for begin in range(0, len(own), chunk):
        f, b, o = follow[begin:begin + chunk], before[begin:begin + chunk], own[begin:begin + chunk]
        gain = np.zeros((len(o), k))
        n = f.sum(axis=1)
        # Rows of the matrix without the unit's own counts, where it now stands.
        at = np.arange(len(o))
        base_total = np.repeat(total[None, :], len(o), axis=0)
        base_total[at, o] -= n
        gain -= 2 * (_xlogx(base_total + n[:, None]) - _xlogx(np.maximum(base_total, 0)))
        for counts, rows in ((f, matrix), (b, matrix.T)):
            base = np.repeat(rows[None], len(o), axis=0)
            base[at, o] -= counts
            np.maximum(base, 0, out=base)
            gain += (_xlogx(base + counts[:, None, :]) - _xlogx(base)).sum(axis=2)
        pick = gain.argmax(axis=1)
        keep = gain[at, pick] <= gain[at, o] + 1e-9 * np.abs(gain[at, o])
        best[begin:begin + chunk] = np.where(keep, o, pick)
    return best


def exchange(bigrams: DataFrame, n_units: int, buckets: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units and class bigram counts.

    What comes to the driver in a round is one class for each unit and one matrix for each bucket.
    """
    k, spark = settings.classes, bigrams.sparkSession
    classes = (np.arange(n_units) % k).astype(np.int32)

    def judge(held: object, half: int | None):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, matrix = held.value
            sides: dict[tuple[int, int], tuple] = {}
            for batch in batches:
                for b, side, key, n in zip(*[c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns)]):
                    sides[b, side] = key.values.to_numpy(), n.values.to_numpy()
                    if (b, 1 - side) in sides:
                        yield bucket(now, matrix, b, sides.pop((b, 0)), sides.pop((b, 1)))

        def bucket(now: np.ndarray, matrix: np.ndarray | None, b: int, after: tuple, prior: tuple) -> pa.RecordBatch:
            units = np.arange(b, n_units, buckets)
            counts = []
            for keys, n in (after, prior):
                cell = (keys // n_units // buckets) * k + now[keys % n_units]
                counts.append(np.bincount(cell, n, minlength=len(units) * k).reshape(len(units), k))
            new = now[units]
            if matrix is not None:
                move = np.flatnonzero((units * 2654435761 >> 7) % 2 == half)
                move = move[(counts[0][move].sum(axis=1) > 0) & (units[move] != 0)]
                new = new.copy()
                new[move] = best_classes(counts[0][move], counts[1][move], new[move], matrix)
            # Followers by class, with the units' present classes.
            sums = np.zeros((k, k))
            np.add.at(sums, now[units], counts[0])
            return pa.RecordBatch.from_arrays(
                [pa.array([units.tolist()], pa.list_(pa.int32())), pa.array([new.tolist()], pa.list_(pa.int32())),
                 pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], ["units", "classes", "sums"])

        return run

    def round_of(matrix: np.ndarray | None, half: int | None) -> tuple[np.ndarray, np.ndarray]:
        held = spark.sparkContext.broadcast((classes, matrix))
        out = bigrams.mapInArrow(judge(held, half), "units array<int>, classes array<int>, sums array<double>").toArrow()
        held.destroy()
        new, sums = classes.copy(), np.zeros((k, k))
        for row in out.to_pylist():
            new[row["units"]] = row["classes"]
            sums += np.array(row["sums"]).reshape(k, k)
        return new, sums

    for r in range(settings.rounds):
        _, matrix = round_of(None, None)
        classes, _ = round_of(matrix, r % 2)
    return classes, round_of(None, None)[1]


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Train on the documents whose id's remainder is not the held one, and score all.

    Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity. A
    null or empty text is its end alone. A null id is not held out. Repeated rows are scored and
    counted as often as they occur; other columns are ignored. An empty table gives no rows; if
    no document is for training, all words are unknown.
    """
    spark = docs.sparkSession
    held = F.coalesce(id_remainder(F.col("doc_id"), settings.held_modulus) == settings.held_remainder, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held.alias("held_out"))
    train = docs.filter("not held_out")
    counts = stored(word_counts(train), "words")
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # A bounded list: the most frequent words; all others take the other way below.
    # Word numbers by powers of two of the count tell from which count on they must be among them.
    power = F.floor(F.log2(F.col("c"))).alias("power")
    least, found = settings.least, 0
    for p, n in sorted(map(tuple, counts.groupBy(power).count().collect()), reverse=True):
        found += n
        if found > settings.frequent:
            least = max(least, 1 << p)
            break
    top = counts.filter((F.col("c") >= least) & (F.length("word") <= settings.longest) & (F.col("word") != F.lit(END))).orderBy(
        F.desc("c"), "word").limit(settings.frequent).toArrow().to_pylist()
    end_count = counts.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    units = Units([END, *[bytes(r["word"]) for r in top]], settings)
    frequent_counts = np.array([end_count, *[r["c"] for r in top]], np.float64)
    shared = spark.sparkContext.broadcast(units)

    # Words and tokens of the units that hold rare words.
    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ending, first = shared.value.index, shared.value.ending, shared.value.n_frequent
        kinds, tokens = np.zeros(settings.endings, np.int64), np.zeros(settings.endings, np.int64)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in known:
                    e = ending(word) - first
                    kinds[e] += 1
                    tokens[e] += c
        filled = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(filled, pa.int64()), pa.array(kinds[filled], pa.int64()), pa.array(tokens[filled], pa.int64())], ["e", "kinds", "tokens"])

    kinds, tokens = np.zeros(settings.endings), np.zeros(settings.endings)
    for r in counts.mapInArrow(tail, "e bigint, kinds bigint, tokens bigint").groupBy("e").agg(
            F.sum("kinds").alias("kinds"), F.sum("tokens").alias("tokens")).toArrow().to_pylist():
        kinds[r["e"]], tokens[r["e"]] = r["kinds"], r["tokens"]

    # Buckets of the bigram table grow with the text, up to one for each unit.
    buckets = max(48, min(len(units), n_all // 2_000_000))
    bigrams = stored(unit_bigrams(train, units, buckets), "bigrams", compression="zstd")
    classes, matrix = exchange(bigrams, len(units), buckets, settings)
    unit_counts = np.concatenate([frequent_counts, tokens])
    model = _Model(units, classes, matrix, unit_counts, kinds, frequent_counts, n_all, v_all, settings)
    return _apply(docs, counts, model, n_all, v_all, settings)


class _Model:
    """What scoring needs, all of bounded size; logarithms to base 10."""

    def __init__(self, units, classes, matrix, unit_counts, kinds, frequent_counts, n_all, v_all, settings):  # noqa: ANN001
        k = settings.classes
        self.units, self.classes = units, classes
        share = (np.bincount(classes, unit_counts, minlength=k) + 1) / (unit_counts.sum() + k)
        before = matrix.sum(axis=1, keepdims=True)
        self.move = np.log10((matrix + settings.strength * share[None, :]) / (before + settings.strength))
        smoothed = unit_counts + 0.5
        self.emit = np.log10(smoothed / np.bincount(classes, smoothed, minlength=k)[classes])
        # P(word | unit) of a rare word is (c + d) / (tokens + d * (kinds + 1)), an unseen word being one more kind.
        d = settings.discount
        self.emit[units.n_frequent:] -= np.log10(unit_counts[units.n_frequent:] + d * (kinds + 1))
        self.base_total = np.log10(n_all + v_all + 1)
        self.base = np.log10(frequent_counts + 1)
        self.known = frequent_counts > 0


def _apply(docs: DataFrame, counts: DataFrame, model: _Model, n_all: int, v_all: int, settings: Settings) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "ns"]

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n_frequent, end = m.units.n_frequent, m.units.index[END]
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = words(text.as_py())
                u = m.units.of(found)
                c = m.classes[u]
                total = m.move[np.concatenate([m.classes[end:end + 1], c[:-1]]), c].sum() + m.emit[u].sum()
                frequent = u[u < n_frequent]
                rare = Counter([found[i] for i in np.flatnonzero(u >= n_frequent).tolist()])
                out.append((len(found), int(m.known[frequent].sum()),
                            float(m.base[frequent].sum()) - len(found) * m.base_total, float(total), list(rare), list(rare.values())))
            cols = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(c, t) for c, t in zip(cols, types)]], columns)

    parts = docs.select("doc_id", "text", "held_out").mapInArrow(
        partly, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, "
                "rare array<binary>, ns array<bigint>")
    # Rows get a number of their own, as ids may repeat; once stored it stays the same.
    parts = stored(parts.withColumn("row", F.monotonically_increasing_id()), "parts", compression="zstd")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "ns")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.ns").alias("n"))
    c = F.coalesce(F.col("c"), F.lit(0)).cast("double")
    sums = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("k2"),
        F.sum(F.col("n") * F.log10(c + 1)).alias("b2"),
        F.sum(F.col("n") * F.log10(c + settings.discount)).alias("s2"))
    total = F.col("score") + F.coalesce("s2", F.lit(0.0))
    return parts.drop("rare", "ns").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k2", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b2", F.lit(0.0))).alias("base_score"), total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"))


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
