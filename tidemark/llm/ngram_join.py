"""N-gram Jaccard join of whole texts by MinHash banding.

A text's set holds its runs of five words (all its words, if fewer). Texts with equal words form
a class, compared once. A class's MinHash values are cut into bands; bands and rows follow from
the target recall at the threshold. Classes with an equal band share a bucket; a bucket whose
members all lie in one larger bucket is left out, as that one holds its pairs. What remains is
compared tile by tile on the full sets, so a hot bucket is spread over tasks and no pair becomes a row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.class_lm import words
from tidemark.llm.common import groups, stored, table
from tidemark.llm.graph import components
from tidemark.llm.tiles import chunks_of, forest, in_tiles, pair_mask

U64 = np.uint64


@dataclass(frozen=True)
class Join:
    """``members``: doc_id, text_key, digest (null without words). ``classes``: digest, class_id,
    copies, n_links, root, component_id."""

    members: DataFrame
    classes: DataFrame


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands find a pair at the threshold with this
    probability, from at most so many hash values."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1)
    for rows in range(2, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows > most_hashes:
            break
        best = bands, rows
    return best


class Grams:
    """Sets of n-grams as sorted 64-bit hashes; a bounded memo holds hashes of words."""

    def __init__(self, n: int, memo: int = 200_000):
        self.n, self.memo, self.known = n, memo, {}

    def of(self, found: list[bytes]) -> np.ndarray:
        if len(self.known) > self.memo:
            self.known.clear()
        known, new = self.known, xxhash.xxh64_intdigest
        for w in set(found):
            if w not in known:
                known[w] = new(w)
        h = np.fromiter(map(known.__getitem__, found), U64, len(found))
        n = min(self.n, len(h))
        g = np.zeros(len(h) - n + 1, U64)
        for i in range(n):
            g = (g ^ h[i:i + len(g)]) * U64(0x9E3779B97F4A7C15)
            g ^= g >> U64(29)
        return np.unique(g)


def text_words(text: str | None) -> list[bytes]:
    return words(text)[:-1]


def digest_of(found: list[bytes]) -> bytes:
    return hashlib.blake2b(b"\n".join(found), digest_size=16).digest()


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.c = rng.integers(1, 1 << 62, (2, rows), dtype=U64) | U64(1)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """One key for each band, different between bands."""
        x = (grams >> U64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            np.minimum(low, (x[i:i + 1024, None] * self.a + self.b).min(axis=0), out=low)
        rows = low.reshape(self.bands, self.rows).astype(U64)
        key = np.arange(1, self.bands + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)
        for i in range(self.rows):
            key = (key ^ rows[:, i]) * U64(0x9E3779B97F4A7C15)
            key ^= key >> U64(32)
        return key.view(np.int64)


def join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, most_hashes: int = 192,
    tile_members: int = 256, tile_grams: int = 400_000,
) -> Join:
    """Links between texts whose n-gram sets have a Jaccard similarity of ``threshold`` or more.

    Words are split at ASCII white space and compared in lower case (A-Z). A text without words
    links with nothing. Null ids count as documents of their own; class and component ids are the
    least ids not null. Repeated rows are copies of each other. Extra columns are ignored.
    """
    bands, rows = bands_for(threshold, recall, most_hashes)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, hashes = Grams(n), MinHash(bands, rows)
        for batch in batches:
            digests, sizes, keys = [], [], []
            for text in batch.column(2):
                found = text_words(text.as_py())
                g = grams.of(found) if found else None
                digests.append(digest_of(found) if found else None)
                sizes.append(len(g) if found else 0)
                keys.append(hashes.keys(g).tolist() if found else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "digest", "size", "keys"])

    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    sketched = stored(keyed.mapInArrow(
        sketch, "doc_id bigint, text_key string, digest binary, size bigint, keys array<bigint>"), "sketch")
    members = sketched.select("doc_id", "text_key", "digest")
    classes = stored(sketched.filter("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("keys").alias("keys")), "classes")

    # Buckets of at least two classes, and of each class the largest that it is in.
    spread = classes.select("digest", "size", F.explode("keys").alias("key"))
    counts = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).filter("n > 1")
    shared = stored(spread.drop("size").join(counts, "key"), "buckets")
    largest = shared.groupBy("digest").agg(F.max(F.struct("n", "key")).alias("m")).select(
        "digest", F.col("m.key").alias("largest"))
    inside = shared.join(largest, "digest").groupBy("key").agg(
        F.min("largest").alias("lo"), F.max("largest").alias("hi"))
    kept = inside.filter("lo <> hi or lo = key").select("key")
    wanted = shared.join(kept, "key").withColumn(
        "chunks", chunks_of(F.col("n"), F.col("total"), tile_members, tile_grams))
    wanted = wanted.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("key", "chunks"))).alias("buckets"))
    wanted = wanted.join(classes.select("digest", "copies", F.col("first.doc_id").alias("c_id"), F.col("first.text_key").alias("c_key")), "digest")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # long lists follow: few rows at a time
                part = batch.slice(i, 64)
                raw = [grams.of(text_words(t.as_py())).tobytes() for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), *part.columns[1:]], ["grams", *part.schema.names[1:]])

    texts = keyed.join(wanted, (F.col("text_key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_id")))
    sets = texts.select("text", "digest", "copies", "buckets").mapInArrow(
        full, "grams binary, digest binary, copies bigint, buckets array<struct<key: bigint, chunks: int>>")
    rows_in = sets.select(
        "grams", "digest", "copies", F.col("buckets.key").alias("keys"), F.explode("buckets").alias("b")
    ).select("grams", "digest", "copies", "keys", F.col("b.key").alias("key"), F.col("b.chunks").alias("chunks"))
    tiled = in_tiles(rows_in, F.pmod(F.xxhash64("digest", "key"), F.col("chunks")), F.col("chunks")).drop("chunks")

    tile = ["key", "tile_i", "tile_j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in groups(batches, tile, 500):
            yield _verified(found, tile, threshold)

    links = stored(
        tiled.repartition(*tile).sortWithinPartitions(*tile, "digest").mapInArrow(
            verify, "digest binary, other binary, links bigint"), "links")
    edges = links.filter("other is not null").select(F.col("digest").alias("a"), F.col("other").alias("b"))
    roots = components(edges)
    sums = links.groupBy("digest").agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    out = classes.select("digest", "class_id", "copies").join(
        roots.withColumnRenamed("node", "digest"), "digest", "left").join(sums, "digest", "left").select(
        "digest", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "digest").alias("root"))
    out = stored(out, "linked")
    ids = out.groupBy("root").agg(F.min("class_id").alias("component_id"))
    return Join(members, out.join(ids, "root"))


def _verified(found: pa.Table, tile: list[str], threshold: float) -> pa.RecordBatch:
    """Links of all tiles of a table: weight of partners for each member, and edges."""
    keys = [found.column(k).to_numpy() for k in tile]
    cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
    digests, copies = found.column("digest").to_pylist(), found.column("copies").to_numpy()
    chunk, lists = found.column("chunk").to_numpy(), found.column("keys").to_pylist()
    grams = [np.frombuffer(g.as_buffer(), U64) for c in found.column("grams").chunks for g in c]
    out: list[tuple] = []
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(digests)]):
        # Sorted by digest: equal ones are repeated rows of one class.
        at = [i for i in range(begin, end) if i == begin or digests[i] != digests[i - 1]]
        if len(at) < 2:
            continue
        mask = pair_mask(chunk[at], keys[1][begin], keys[2][begin])
        linked = mask & (similarity([grams[i] for i in at]) >= threshold - 1e-12)
        # A pair that shares a bucket with a lower key counts there.
        own = keys[0][begin]
        lower: dict[int, list[int]] = {}
        for row, i in enumerate(at):
            for k in lists[i]:
                if k < own:
                    lower.setdefault(k, []).append(row)
        for rows in lower.values():
            if len(rows) > 1:
                linked[np.ix_(rows, rows)] = False
        weight = copies[at]
        sums = linked @ weight + linked.T @ weight
        out += [(digests[at[r]], None, int(sums[r])) for r in np.flatnonzero(sums).tolist()]
        out += [(digests[at[a]], digests[at[b]], 0) for a, b in forest(linked)]
    columns = list(zip(*out)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())],
        ["digest", "other", "links"])


def similarity(sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of all pairs of sorted sets."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    inter = np.zeros((n, n))
    if n == 2:
        inter[0, 1] = inter[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        member = np.repeat(np.arange(n), sizes.astype(np.int64))
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Only what at least two sets hold counts; columns are taken in blocks.
        place = np.cumsum(count > 1) - 1
        common = count[column] > 1
        member, column = member[common], place[column[common]]
        order = np.argsort(column, kind="stable")
        member, column = member[order], column[order]
        for begin in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
            lo, hi = np.searchsorted(column, [begin, begin + 4096])
            x = np.zeros((n, 4096), np.float32)
            x[member[lo:hi], column[lo:hi] - begin] = 1
            inter += x @ x.T
    return inter / (sizes[:, None] + sizes[None, :] - inter)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = join(table(spark, sf_dir, "documents"))
    known = j.classes.select("digest", "class_id", "n_links", "component_id")
    own = F.col("doc_id")
    return j.members.join(known, "digest", "left").select(
        "doc_id", F.coalesce("class_id", own).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", own).alias("component_id"),
        F.coalesce(own == F.coalesce("component_id", own), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, **options: object) -> DataFrame:
    """One document of each group of linked texts, the one of the least id (null last); all
    documents without words. Of repeated rows with that id and text, the one whose other columns come
    first as JSON stays. Columns of any name are left alone: rows are carried whole."""
    j = join(docs, **options)
    first = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key")
    best = j.members.filter("digest is not null").join(j.classes.select("digest", "root"), "digest").groupBy("root").agg(
        F.min(first).alias("f")).select(F.col("f.doc_id").alias("keep_id"), F.col("f.text_key").alias("keep_key"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keyed = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.md5(F.coalesce("text", F.lit(""))).alias("own_key"),
        F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("has_words"), F.to_json(F.struct(*others)).alias("rest"))
    met = keyed.filter("has_words").join(best, (F.col("own_key") == F.col("keep_key")) & F.col("own_id").eqNullSafe(F.col("keep_id")))
    kept = met.groupBy("keep_id", "keep_key").agg(F.min_by("row", "rest").alias("row"))
    return kept.select("row").unionByName(keyed.filter("not has_words").select("row")).select("row.*")
