"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into passages of at most ``longest`` characters, and into parts so close
that every run of ``part + stride - 1`` characters of an item holds a whole one. A text region within k
edits of a passage of m characters shares at least m + 1 - q - k * q of its q-grams with it, on
diagonals (text position less passage position) that differ by at most k. So hits are counted in
bands of 2 * (k + 1) diagonals that overlap by half: one band holds all hits of a match. Bands that
reach the bound are verified by banded alignment. Items too short for
edits are looked up where words begin.

Texts and items are compared by lower-case letters and digits; all else is one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, table, texts_of

Q = 8
U64 = np.uint64
FACTOR = 0x9E3779B97F4A7C15
#: Counters of diagonals.
CELLS = 1 << 22
#: A separator of texts, no letter.
BREAK = 1
MATCH_SCHEMA = "doc_id bigint, item_id bigint, begin bigint, end bigint, distance int, budget int"


@dataclass(frozen=True)
class Settings:
    """``rate``: edits allowed for each character of a passage. An exact excerpt of an item is found
    from ``part + stride - 1`` characters on. Items with fewer than ``shortest`` characters match
    exactly, between word borders. ``block_chars`` bounds the benchmark text that is held at once."""

    rate: float = 0.1
    longest: int = 128
    part: int = 64
    stride: int = 8
    shortest: int = 32
    block_chars: int = 2_000_000


def _lower_table() -> np.ndarray:
    table = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        low = ch.lower()
        table[c] = (ord(low) if len(low) == 1 else c) if ch.isalnum() else 32
    return table


_TABLES: list[np.ndarray] = []


def fold(texts: list[str], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts with ``gap`` separators behind each; the position of each
    in its text; where each text begins among the folded."""
    if not _TABLES:
        _TABLES.append(_lower_table())
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + gap)
    begins = ends - sizes - gap
    raw = np.frombuffer(("\n" * gap).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(raw < 1 << 16, _TABLES[0].take(np.minimum(raw, 0xFFFF)), raw)
    between = np.zeros(len(x) + 1, np.int32)
    between[ends - gap] += 1
    between[ends] -= 1
    x[np.cumsum(between[:-1]) > 0] = BREAK
    keep = np.ones(len(x), bool)
    space = x == 32
    keep[1:] = ~(space[1:] & space[:-1])
    kept = np.flatnonzero(keep)
    return x[kept], kept - np.repeat(begins, sizes + gap)[kept], np.searchsorted(kept, begins)


def qgrams(x: np.ndarray) -> np.ndarray:
    """Hash of the 8 characters from each position on, by doubling."""
    h, p = x.astype(U64) + U64(1), FACTOR
    for step in (1, 2, 4):
        h = h[:-step] * U64(p) + h[step:] if len(h) > step else h[:0]
        p = p * p % (1 << 64)
    h ^= h >> U64(31)
    return h * U64(FACTOR)


def run_hashes(x: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters from each begin on."""
    h = np.zeros(len(begin), U64)
    for i in range(n):
        h = (h ^ x[begin + i]) * U64(FACTOR)
    return h


def _occurrences(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct q-grams in order; for each, where its occurrences begin and how many they are; text and place of each."""
    grams = [qgrams(t) for t in texts]
    if not grams:
        return np.zeros(0, U64), *[np.zeros(0, np.int64)] * 4
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    distinct, first, count = np.unique(every[order], return_index=True, return_counts=True)
    return (distinct, first, count, np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order],
            np.concatenate([np.arange(len(g)) for g in grams])[order])


def _expanded(rows: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as it has occurrences, and which one it is."""
    n = count[rows]
    ends = np.cumsum(n)
    return np.repeat(np.arange(len(rows)), n), np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first[rows], n)


class Index:
    """Passages of a block of items."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        self.passages: list[np.ndarray] = []
        owner: list[int] = []
        self.part_of: list[int] = []
        whole: list[np.ndarray] = []
        short: dict[int, dict[bytes, list[int]]] = {}
        for item_id, text in items:
            x, _, _ = fold([text or ""], 1)
            x = x[:-1]
            x = x[int(x[:1].sum() == 32):len(x) - int(len(x) > 1 and x[-1] == 32)]
            if len(x) < settings.shortest:
                if len(x):
                    short.setdefault(len(x), {}).setdefault(x.tobytes(), []).append(item_id)
                continue
            whole.append(x)
            cuts = set()
            for size, stride in ((settings.longest, settings.longest // 2), (settings.part, settings.stride)):
                last = max(0, len(x) - size)
                cuts |= {(begin, min(begin + size, len(x))) for begin in (*range(0, last, stride), last)}
            for begin, end in sorted(cuts):
                self.passages.append(x[begin:end])
                owner.append(item_id)
                self.part_of.append(len(whole) - 1)
        # By size: hashes of the texts, and the items that have each text.
        self.short = {n: (np.array([run_hashes(np.frombuffer(t, np.uint32), np.zeros(1, np.int64), n)[0] for t in texts], U64), texts)
                      for n, texts in short.items()}
        self.owner = np.array(owner, np.int64)
        self.size = np.array([len(p) for p in self.passages], np.int64)
        # No more edits than leave one q-gram to be found.
        self.budget = np.minimum((self.size * settings.rate).astype(np.int64), np.maximum(self.size - Q, 0) // Q)
        self.need = np.maximum(self.size + 1 - Q - self.budget * Q, 1)
        self.gap = int(self.budget.max(initial=0)) + 1
        self.grams, self.first, self.count, self.passage, self.place = _occurrences(self.passages)
        _, self.item_first, self.item_count, self.item, self.item_place = _occurrences(whole)
        self.item_need = np.full(len(whole), 1 << 30, np.int64)
        np.minimum.at(self.item_need, np.array(self.part_of, np.int64), self.need)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.grams >> U64(42)).astype(np.int64)] = True

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, begin, end, distance, budget): all regions of each text and item. Those that
        overlap are one, with the distance and budget of the best of them."""
        x, position, begins = fold(texts, self.gap)
        parts: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for b, e, item, d, k in (*self._words(x), *self._near(x, begins)):
            text = int(np.searchsorted(begins, e - 1, "right")) - 1
            parts.setdefault((text, item), []).append((int(position[b]), int(position[e - 1]) + 1, d, k))
        found = []
        for (text, item), regions in sorted(parts.items()):
            merged: list[tuple[int, int, int, int]] = []
            for b, e, d, k in sorted(regions):
                if merged and b < merged[-1][1]:
                    last = merged.pop()
                    b, e = last[0], max(e, last[1])
                    d, k = min((d, k), last[2:])
                merged.append((b, e, d, k))
            found += [(text, item, *region) for region in merged]
        return found

    def _words(self, x: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Short items between word borders: begin and end among the folded, item, distance, budget."""
        if not self.short:
            return
        letter = (x != 32) & (x != BREAK)
        starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
        for n, (hashes, items) in self.short.items():
            at = starts[starts + n < len(x)]
            at = at[~letter[at + n]]
            for b in at[np.isin(run_hashes(x, at, n), hashes)].tolist():
                for item in items.get(x[b:b + n].tobytes(), ()):
                    yield b, b + n, item, 0, 0

    def _near(self, x: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Regions within the budget of a passage, in the same form."""
        if not len(self.owner):
            return []
        h = qgrams(x)
        hit = self.seen.take((h >> U64(42)).view(np.int64))
        at = np.flatnonzero(hit)
        gram = np.searchsorted(self.grams, h[at])
        gram[gram == len(self.grams)] = 0
        true = self.grams[gram] == h[at]
        at, gram = at[true], gram[true]
        if len(at):
            rich = self._rich(at, gram)
            at, gram = at[rich], gram[rich]
        if not len(at):
            return []
        # Every hit once for each place of its q-gram in a passage.
        row, which = _expanded(gram, self.first, self.count)
        passage = self.passage[which]
        diagonal = at[row] - self.place[which]
        band = (diagonal + self.size[passage]) // (self.budget[passage] + 1)
        key = passage << 40 | band
        key, n = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        passage = key >> 40
        enough = n >= self.need[passage]
        passage, band = passage[enough], (key & ((1 << 40) - 1))[enough]
        if not len(passage):
            return []
        low = band * (self.budget[passage] + 1) - self.size[passage]
        end, distance = self._align(x, passage, low)
        found = []
        for p, e, d in zip(passage.tolist(), end.tolist(), distance.tolist()):
            if d <= self.budget[p]:
                e = min(max(e, 1), len(x))
                text = int(np.searchsorted(begins, e - 1, "right")) - 1
                b = max(e - int(self.size[p]) - d, int(begins[text]))
                found.append((b, e, int(self.owner[p]), d, int(self.budget[p])))
        return found

    def _rich(self, at: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Hits on diagonals of an item that hold the least number any of its passages needs.

        All hits of a match lie in two neighbouring cells of diagonals. Cells share counters by a
        hash, which may only raise a count.
        """
        row, which = _expanded(gram, self.item_first, self.item_count)
        item = self.item[which]
        cell = (at[row] - self.item_place[which]) // self.gap + item * 1_000_003
        counts = np.bincount(cell & (CELLS - 1), minlength=CELLS)
        own = counts[cell & (CELLS - 1)]
        most = own + np.maximum(counts[(cell - 1) & (CELLS - 1)], counts[(cell + 1) & (CELLS - 1)])
        rich = np.zeros(len(at), bool)
        rich[row[most >= self.item_need[item]]] = True
        return rich

    def _align(self, x: np.ndarray, passage: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of whole passages against text in bands that begin at diagonals ``low``,
        and where the text region ends. Candidates of equal size are aligned together."""
        end, distance = np.zeros(len(passage), np.int64), np.zeros(len(passage), np.int64)
        shape = self.size[passage] << 20 | self.budget[passage]
        for s in np.unique(shape):
            rows = np.flatnonzero(shape == s)
            for begin in range(0, len(rows), 512):
                r = rows[begin:begin + 512]
                m, wide = int(s) >> 20, 2 * ((int(s) & 0xFFFFF) + 1)
                pattern = np.stack([self.passages[p] for p in passage[r].tolist()])
                place = low[r, None] + np.arange(m + wide)[None, :]
                inside = (place >= 0) & (place < len(x))
                text = np.where(inside, x[np.clip(place, 0, len(x) - 1)], BREAK)
                step = np.arange(wide)
                d = np.zeros((len(r), wide), np.int64)
                for i in range(m):
                    new = d + (text[:, i:i + wide] != pattern[:, i, None])
                    new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
                    d = np.minimum.accumulate(new - step, axis=1) + step
                pick = d.argmin(axis=1)
                distance[r] = d[np.arange(len(r)), pick]
                end[r] = low[r] + m + pick
        return end, distance


def blocks(benchmark: DataFrame, settings: Settings) -> Iterator[Index]:
    """Indexes of bounded size that together hold all items."""
    items: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("bigint"), "text").filter(
            "item_id is not null and text is not null").toLocalIterator(prefetchPartitions=False):
        items.append(tuple(row))
        size += len(row[1])
        if size >= settings.block_chars:
            yield Index(items, settings)
            items, size = [], 0
    if items:
        yield Index(items, settings)


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document row, item that it holds, in part or whole, and region: doc_id, item_id,
    begin and end in characters of a region that holds matches, distance and budget of the best one.

    Null and empty texts and items without an id, text or word match nothing. Repeated rows match as often as they
    occur; an empty table on either side gives no rows. Each block of items is one pass.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    for index in blocks(benchmark, settings):
        found = rows.mapInArrow(_matcher(spark.sparkContext.broadcast(index)), MATCH_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], MATCH_SCHEMA) if out is None else out


def _matcher(shared: object):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for begin, end in by_bytes(texts, 1 << 20):
                found = shared.value.find(texts[begin:end])
                if found:
                    text, item, b, e, d, k = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(begin, end - begin).take(pa.array(text)), *[pa.array(v, pa.int64()) for v in (item, b, e)],
                         pa.array(d, pa.int32()), pa.array(k, pa.int32())],
                        ["doc_id", "item_id", "begin", "end", "distance", "budget"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents, with all columns, that match no item; rows pass through their task."""
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index("text")

    def filter_by(shared: object):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = texts_of(batch.column(at))
                for begin, end in by_bytes(texts, 1 << 20):
                    keep = np.ones(end - begin, bool)
                    keep[[f[0] for f in shared.value.find(texts[begin:end])]] = False
                    yield batch.slice(begin, end - begin).filter(pa.array(keep))

        return run

    for index in blocks(benchmark, settings):
        docs = docs.mapInArrow(filter_by(spark.sparkContext.broadcast(index)), schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
