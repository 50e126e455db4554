"""Embedding near-dedup by a subspace pigeonhole join.

Vectors of one label are compared by cosine. Unit vectors of cosine c are at squared distance
2 - 2 * c. After a rotation the coordinates are cut into blocks; if two vectors are within the budget,
then in at least one block they are within the block's proportional share of it. So each
block is joined by range on its own: a block's leading coordinates are put into cells, a vector
stands in its own cell and visits those later cells that its ball reaches. Tasks take cells tile by tile,
compare block distances, then verify candidates by cosine in double precision. A pair counts in
its first block within the share only, so the union of the blocks needs no pair table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import groups, stored, table
from tidemark.llm.graph import components
from tidemark.llm.tiles import chunks_of, forest, in_tiles, pair_mask


@dataclass(frozen=True)
class Settings:
    """``blocks`` blocks of the rotated coordinates; the first ``axes`` coordinates of a block make
    its cells, which are ``widths`` radii wide. ``tile_members`` bounds a tile's side."""

    threshold: float = 0.98
    blocks: int = 8
    axes: int = 5
    widths: float = 3.0
    tile_members: int = 512
    seed: int = 17
    #: Slack for rounding in squared block distances; candidates are verified exactly.
    slack: float = 1e-9


class Blocks:
    """Rotation and block bounds for vectors of ``size`` coordinates."""

    def __init__(self, size: int, settings: Settings):
        n = max(1, min(settings.blocks, size))
        rng = np.random.default_rng(settings.seed)
        self.rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
        self.cuts = [size * i // n for i in range(n + 1)]
        budget = max(0.0, 2 - 2 * settings.threshold)
        self.share = [budget * (b - a) / size + settings.slack for a, b in zip(self.cuts, self.cuts[1:])]

    def parts(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.rotation
        return [turned[:, a:b] for a, b in zip(self.cuts, self.cuts[1:])]


def unit_of(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, scaled first so that squares neither vanish nor overflow."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells_of(part: np.ndarray, radius: float, settings: Settings) -> list[list[tuple[int, ...]]]:
    """For each vector its own cell and those later ones, in order, that its ball reaches."""
    width = radius * settings.widths
    x = part[:, :settings.axes]
    home = np.floor(x / width).astype(np.int64)
    out = []
    for row, own in zip(x, home.tolist()):
        reach = [((), 0.0)]
        for value, cell in zip(row.tolist(), own):
            # Distance to the cell below, to the own one, and to the one above.
            steps = ((cell - 1, value - cell * width), (cell, 0.0), (cell + 1, (cell + 1) * width - value))
            reach = [((*c, s), d + g * g) for c, d in reach for s, g in steps if d + g * g <= radius * radius * (1 + 1e-9)]
        home_cell = tuple(own)
        out.append([home_cell, *[c for c, _ in reach if c > home_cell]])
    return out


def near(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows of equal label, not null, link if the cosine of their vectors is at least the threshold.
    A vector that is null, empty, zero, or has a null or non-finite coordinate links with nothing, and
    vectors of different length never link. Rows with equal label and vector are one class, compared
    once, and link with each other. Rows with equal or null ids are rows of their own; components
    take the least id not null, a row without links its own. An empty table gives no rows.
    """
    # Floats stay floats on their way; all arithmetic is in double precision.
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"),
        F.col("label").cast("string").alias("label"))
    usable = F.coalesce(
        F.col("label").isNotNull() & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0), F.lit(False))
    digest = F.md5(F.concat_ws("|", F.col("label"), F.array_join(
        F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")), ",")))
    keyed = stored(rows.withColumn("class", F.when(usable, digest)), "vectors")
    classes = stored(keyed.filter("class is not null").groupBy("class").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"),
        F.first("label").alias("label")), "classes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Blocks] = {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                v, lists = part.column(2), part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(lists).tolist():
                    at = np.flatnonzero(lists == size)
                    if size not in made:
                        made[size] = Blocks(size, settings)
                    flat = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    unit = unit_of(flat.reshape(-1, size))
                    out: list[tuple] = []
                    for b, x in enumerate(made[size].parts(unit)):
                        for i, cells in enumerate(cells_of(x, made[size].share[b] ** 0.5, settings)):
                            out += [(i, f"{size}:{b}:" + ":".join(map(str, c)), k > 0) for k, c in enumerate(cells)]
                    index, cell, visits = zip(*out)
                    source = pa.array(at[list(index)])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(source), part.column(1).take(source), pa.array(cell), pa.array(visits)],
                        ["class", "label", "cell", "visits"])

    cells = classes.select("class", "label", "v").mapInArrow(
        spread, "class string, label string, cell string, visits boolean")
    cells = stored(cells.withColumn("key", F.xxhash64("label", "cell")), "cells")
    # A cell with one class, or with visitors only, holds no pair.
    counts = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("visits"), 0).otherwise(1)).alias("own")).filter("n > 1 and own > 0")
    counts = counts.withColumn("chunks", chunks_of(F.col("n"), F.col("n"), settings.tile_members, settings.tile_members))
    met = cells.join(counts.select("key", "chunks"), "key").join(classes.select("class", "copies", "v"), "class")
    tiled = in_tiles(met, F.pmod(F.xxhash64("class", "key"), F.col("chunks")), F.col("chunks"))
    tile = ["key", "tile_i", "tile_j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Blocks] = {}
        for found in groups(batches, tile, 2_000):
            yield _verified(found, tile, made, settings)

    links = stored(tiled.drop("chunks").repartition(*tile).sortWithinPartitions(*tile, "class").mapInArrow(
        verify, "class string, other string, links bigint"), "links")
    edges = links.filter("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))
    roots = components(edges).withColumnRenamed("node", "class")
    sums = links.groupBy("class").agg(F.sum("links").alias("links"))
    linked = classes.select("class", "least", "copies").join(roots, "class", "left").join(sums, "class", "left").select(
        "class", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    linked = stored(linked, "linked")
    ids = linked.groupBy("root").agg(F.min("least").alias("component"))
    own = F.col("vec_id")
    return keyed.select("vec_id", "class").join(linked.join(ids, "root"), "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", own).alias("component_id"),
        F.coalesce(own == F.coalesce("component", own), F.lit(False)).alias("kept"))


def _verified(found: pa.Table, tile: list[str], made: dict[int, Blocks], settings: Settings) -> pa.RecordBatch:
    keys = [found.column(k).to_numpy() for k in tile]
    cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
    chunk, copies = found.column("chunk").to_numpy(), found.column("copies").to_numpy()
    visits = found.column("visits").to_numpy()
    names, label, cell = (found.column(c).to_pylist() for c in ("class", "label", "cell"))
    vectors = found.column("v").combine_chunks()
    out: list[tuple] = []
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
        if end - begin < 2 or visits[begin:end].all():
            continue
        size, block = (int(x) for x in cell[begin].split(":")[:2])
        blocks = made.setdefault(size, Blocks(size, settings))
        unit = unit_of(vectors[begin:end].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))
        mask = pair_mask(chunk[begin:end], keys[1][begin], keys[2][begin])
        v = visits[begin:end]
        mask &= ~(v[:, None] & v[None, :])
        # Cells are told apart by a hash: members must agree on what it stands for.
        same = np.array([hash((a, b)) for a, b in zip(label[begin:end], cell[begin:end])])
        mask &= same[:, None] == same[None, :]
        parts = blocks.parts(unit)
        close = mask & (_squared(parts[block]) <= blocks.share[block])
        a, b = np.nonzero(close)
        if not len(a):
            continue
        # Of the pair's blocks within their share, only the first counts it.
        first = np.ones(len(a), bool)
        for earlier in range(block):
            d = parts[earlier][a] - parts[earlier][b]
            first &= (d * d).sum(axis=1) > blocks.share[earlier]
        a, b = a[first], b[first]
        good = np.einsum("ij,ij->i", unit[a], unit[b]) >= settings.threshold
        linked = np.zeros_like(mask)
        linked[a[good], b[good]] = True
        weight = copies[begin:end]
        sums = linked @ weight + linked.T @ weight
        out += [(names[begin + r], None, int(sums[r])) for r in np.flatnonzero(sums).tolist()]
        out += [(names[begin + x], names[begin + y], 0) for x, y in forest(linked)]
    columns = list(zip(*out)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["class", "other", "links"])


def _squared(x: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, by a product; the slack covers its rounding."""
    s = (x * x).sum(axis=1)
    return s[:, None] + s[None, :] - 2 * (x @ x.T)


def op9_embedding_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings"))
