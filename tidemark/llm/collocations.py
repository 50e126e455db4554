"""Collocations: phrases of two to five words that occur together more often than their parts explain.

A phrase can only be frequent if its words, pairs and triples of words are. So words are counted first, then
hashes of the pairs of frequent words, then of the triples of frequent pairs; each level goes to the tasks as a
bitmap of fixed size, which lets everything frequent pass. Phrases whose parts all pass are counted exactly: every
task counts in a trie (``hat_trie``) and lets subtrees go as sorted runs, one row for each part of the prefixes;
the runs of a part are merged. What shares a hash is told apart there.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.hat_trie import HatTrie

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Lower case for A-Z, one sign for all ends of pieces, a space for a tab.
PLAIN = bytes(10 if c in PIECE_ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Factors of the hash of words in a row, of which the upper 44 bits are kept: 12 tell the part, 32 the place in it.
U64 = np.uint64
FACTORS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))
MIX = U64(0xD6E8FEB86659FD93)
GRAM_BITS, PART_BITS = 44, 12
#: Pairs and triples are hashed before phrases are counted.
HASHED = 3
BLOCK_BITS = 1 << 16

#: Phrases of a run end in line feeds, which no word holds; counts are 64 bits each.
RUN_SCHEMA = "part bigint, lang string, phrases binary, n binary"
#: Runs of one Arrow batch.
RUN_ROWS = 2_000


@dataclass(frozen=True)
class Settings:
    """``least``: occurrences of a candidate; ``share``: per cent of its count a longer candidate needs to
    replace it; ``top`` rows a language; ``longest`` phrase in words.
    ``bits`` is the size of a bitmap, ``burst`` and ``keys`` bound the trie of a task, ``part_pairs`` the pairs
    that begin the phrases of one part of the merge."""

    least: int = 100
    share: int = 100
    top: int = 2_000
    longest: int = 5
    bits: int = 1 << 26
    burst: int = 4_096
    keys: int = 200_000
    part_pairs: int = 2_048


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case, a line feed at each end of a piece, and empty ones where spaces meet."""
    return text.translate(PLAIN).replace(b"\n", b" \n ").split(b" ")


def word_counts(docs: DataFrame, flush: int = 150_000) -> DataFrame:
    """lang, phrase, n of all words, combined in the task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.setdefault(lang, Counter()).update(text.as_py().translate(PLAIN).split())
            if sum(map(len, seen.values())) > flush:
                yield from (_words(lang, n) for lang, n in seen.items())
                seen = {}
        yield from (_words(lang, n) for lang, n in seen.items())

    counted = docs.mapInArrow(count, "lang string, phrase binary, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counted.withColumn("phrase", F.col("phrase").cast("string"))


def _words(lang: str, seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(seen), pa.string()), pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["lang", "phrase", "n"])


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """One bit for each ``slot``, put together in blocks; ``bits`` / 8 bytes whatever the input."""
    width = min(BLOCK_BITS, bits)

    def block(found: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(width, bool)
        marks[found["slot"].to_numpy() % width] = True
        return pd.DataFrame({"block": [found["block"].iloc[0]], "marks": [np.packbits(marks).tobytes()]})

    blocks = slots.distinct().withColumn("block", F.expr(f"slot div {width}"))
    out = np.zeros((bits // width, width // 8), np.uint8)
    for row in blocks.groupBy("block").applyInPandas(block, "block bigint, marks binary").toLocalIterator():
        out[row["block"]] = np.frombuffer(row["marks"], np.uint8)
    return out.reshape(-1)


def word_slots(words: DataFrame, bits: int) -> DataFrame:
    return words.select(F.pmod(F.crc32(F.concat("lang", F.lit("\0"), "phrase").cast("binary")), F.lit(bits)).alias("slot"))


def _set(marks: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (marks[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)


class Words:
    """Ids of the words of a task that may be frequent; -1 for all others."""

    def __init__(self, marks: np.ndarray, forget: int = 150_000):
        self.marks, self.bits, self.forget = memoryview(marks), len(marks) * 8, forget
        self.names: list[bytes] = []
        self.langs: list[str] = []
        self.hashes: list[int] = []
        self.known: dict[str, dict[bytes, int]] = {}

    def of(self, lang: str) -> dict[bytes, int]:
        if lang not in self.known:
            self.known[lang] = _Known(self, lang)
        return self.known[lang]

    def new(self, lang: str, word: bytes) -> int:
        h = zlib.crc32(lang.encode() + b"\0" + word)
        slot = h % self.bits
        if not self.marks[slot >> 3] >> (7 - (slot & 7)) & 1:
            return -1
        self.names.append(word)
        self.langs.append(lang)
        self.hashes.append(h)
        return len(self.names) - 1

    def trim(self) -> None:
        """Forget rare words now and then; ids stay."""
        if sum(map(len, self.known.values())) > self.forget:
            for lang, known in self.known.items():
                kept = self.known[lang] = _Known(self, lang)
                kept.update((w, i) for w, i in known.items() if i >= 0)


class _Known(dict):
    def __init__(self, words: Words, lang: str):
        super().__init__({b"\n": -1, b"": -2})
        self.words, self.lang = words, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = found = self.words.new(self.lang, word)
        return found


def _streams(batches: Iterator[pa.RecordBatch], words: Words, chars: int) -> Iterator[np.ndarray]:
    """Word ids of some texts at a time, -1 between pieces; no list of ids is larger than a text or ``chars``."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = tokens(text.as_py())
            ids = np.fromiter(map(words.of(lang).__getitem__, found), np.int64, len(found))
            held += [ids[ids != -2], END]
            size += len(ids)
            if size > chars // 6:
                yield np.concatenate(held)
                words.trim()
                held, size = [], 0
    if held:
        yield np.concatenate(held)


END = np.array([-1], np.int64)


def _narrowed(ok: np.ndarray) -> np.ndarray:
    """Where a part and the one after it are ok: the parts of a phrase longer by one word."""
    return ok[:-1] & ok[1:]


def _hashed(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each position on."""
    h = np.zeros(len(at), U64)
    for j in range(k):
        h += hashes[ids[at + j]] * FACTORS[j]
    return ((h ^ (h >> U64(29))) * MIX) >> U64(64 - GRAM_BITS)


def _survivors(ids: np.ndarray, hashes: np.ndarray, bitmaps: list[Broadcast]) -> list[np.ndarray]:
    """By position, whether one word, two words, ... from there may be frequent, as far as there are bitmaps."""
    oks = [ids >= 0]
    for k, marks in enumerate(bitmaps, 2):
        ok = _narrowed(oks[-1])
        at = np.flatnonzero(ok)
        ok[at] = _set(marks.value, (_hashed(ids, hashes, at, k) % U64(len(marks.value) * 8)).astype(np.int64))
        oks.append(ok)
    return oks


def gram_slots(docs: DataFrame, words: Broadcast, bitmaps: list[Broadcast], settings: Settings, chars: int = 1 << 22) -> DataFrame:
    """slot of each hash of neighbouring words, one more than ``bitmaps`` tell of, that occurs ``least`` times or more.

    Hashes travel packed by part; a part meets in one task and holds one hash in 2**12.
    """
    low_bits, k = U64((1 << (GRAM_BITS - PART_BITS)) - 1), len(bitmaps) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Words(words.value)
        for stream in _streams(batches, ids, chars):
            hashes = np.array(ids.hashes or [0], U64)
            h = _hashed(stream, hashes, np.flatnonzero(_narrowed(_survivors(stream, hashes, bitmaps)[-1])), k)
            if len(h):
                h, n = np.unique(h, return_counts=True)
                part = (h >> U64(GRAM_BITS - PART_BITS)).astype(np.int64)
                filled, first = np.unique(part, return_index=True)
                low, ends = (h & low_bits).astype(np.uint32), [*first[1:].tolist(), len(h)]
                cuts = list(zip(first.tolist(), ends))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(filled, pa.int64()), pa.array([low[b:e].tobytes() for b, e in cuts], pa.binary()),
                     pa.array([n[b:e].astype(np.uint32).tobytes() for b, e in cuts], pa.binary())], ["part", "low", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            for part, low, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if part != own:
                    yield from frequent_of(own, held)
                    own, held = part, []
                held.append((np.frombuffer(low.as_buffer(), np.uint32), np.frombuffer(n.as_buffer(), np.uint32)))
                if len(held) > 200:
                    held = [_summed(held)]
        yield from frequent_of(own, held)

    def frequent_of(part: int | None, held: list) -> Iterator[pa.RecordBatch]:
        if held:
            low, n = _summed(held)
            slots = ((part << (GRAM_BITS - PART_BITS)) + low[n >= settings.least].astype(np.int64)) % settings.bits
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64())], ["slot"])

    packed = docs.mapInArrow(count, "part bigint, low binary, n binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "slot bigint")


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    low, inverse = np.unique(np.concatenate([l for l, _ in held]), return_inverse=True)
    return low, np.bincount(inverse, np.concatenate([n for _, n in held]), len(low)).astype(np.int64)


def _distinct(ids: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of ``k`` ids at the positions, and their counts."""
    rank, width = ids[begins], int(ids.max(initial=0)) + 1
    for j in range(1, k):
        _, first, rank = np.unique(rank * width + ids[begins + j], return_index=True, return_inverse=True)
    return ids[begins[first][:, None] + np.arange(k)], np.bincount(rank)


def count_phrases(docs: DataFrame, words: Broadcast, bitmaps: list[Broadcast], settings: Settings, chars: int = 1 << 22) -> DataFrame:
    """lang, phrase, n of the phrases of two words or more that occur ``least`` times or more.

    ``words`` and ``bitmaps`` tell of frequent words, pairs, ...
    """
    parts = _parts((bitmaps or [words])[0].value, settings.part_pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, trie = Words(words.value), HatTrie(settings.burst, settings.keys)
        for stream in _streams(batches, ids, chars):
            oks = _survivors(stream, np.array(ids.hashes or [0], U64), bitmaps)
            for k in range(2, settings.longest + 1):
                if k > len(oks):
                    oks.append(_narrowed(oks[-1]))
                begins = np.flatnonzero(oks[k - 1])
                if not len(begins):
                    break
                phrases, n = _distinct(stream, begins, k)
                for phrase, times in zip(map(tuple, phrases.tolist()), n.tolist()):
                    trie.add(phrase, times)
                    if trie.full():
                        yield from _runs(trie, ids, parts)
        yield from _runs(trie, ids, parts)

    runs = docs.mapInArrow(count, RUN_SCHEMA)
    merged = runs.repartition("part", "lang").sortWithinPartitions("part", "lang")
    return merged.mapInArrow(_merger(settings.least), "lang string, phrase string, n bigint")


def _parts(pairs: np.ndarray, part_pairs: int) -> int:
    """Number of prefix parts: a power of two, 1,024 at least, with about ``part_pairs`` of the pairs in each."""
    found = int(np.bitwise_count(pairs).sum())
    return 1 << max(10, (found // part_pairs).bit_length())


def _runs(trie: HatTrie, ids: Words, parts: int) -> Iterator[pa.RecordBatch]:
    """All subtrees of the trie as sorted runs, one for each part (a hash of the first two words) and language."""
    runs: dict[tuple[int, str], list[tuple[bytes, int]]] = {}
    names = ids.names
    for first, found in trie.spill():
        lang, word = ids.langs[first], names[first] + b" "
        for phrase, n in found:
            part = zlib.crc32(word + names[phrase[1]]) % parts
            runs.setdefault((part, lang), []).append((b" ".join([names[i] for i in phrase]), n))
    while runs:
        keys, phrases, counts = [], [], []
        while runs and len(keys) < RUN_ROWS:
            key, run = runs.popitem()
            run.sort()
            names_of, n = zip(*run)
            keys.append(key)
            phrases.append(b"\n".join(names_of))
            counts.append(np.array(n, np.int64).tobytes())
        part, lang = zip(*keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array(lang, pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.binary())],
            ["part", "lang", "phrases", "n"])


def _merger(least: int, most_runs: int = 200):
    """Merges the sorted runs of each part and language; the phrases of one part are held at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            for part, lang, phrases, n in zip(*[c.to_pylist() for c in batch.columns]):
                if (part, lang) != own:
                    yield from ended(own, held)
                    own, held = (part, lang), []
                held.append(list(zip(phrases.split(b"\n"), np.frombuffer(n, np.int64).tolist())))
                if len(held) > most_runs:
                    held = [_merged(held)]
        yield from ended(own, held)

    def ended(own: tuple[int, str] | None, held: list) -> Iterator[pa.RecordBatch]:
        found = [(p, n) for p, n in _merged(held) if n >= least]
        if found:
            phrases, n = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([own[1]] * len(n), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                ["lang", "phrase", "n"])

    return merge


def _merged(runs: list[list[tuple[bytes, int]]]) -> list[tuple[bytes, int]]:
    """One sorted run of all; Python's sort merges runs that are sorted already."""
    out: list[tuple[bytes, int]] = []
    for phrase, equal in groupby(sorted(chain.from_iterable(runs)), itemgetter(0)):
        out.append((phrase, sum(n for _, n in equal)))
    return out


def frequent(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, n of all phrases of one word up to the longest with ``least`` occurrences, and
    lang, total: the words of each language."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counts = stored(word_counts(docs), "words")
    found = counts.where(F.col("n") >= settings.least)
    words = context.broadcast(bitmap(word_slots(found, settings.bits), settings.bits))
    bitmaps: list[Broadcast] = []
    for _ in range(2, min(HASHED, settings.longest) + 1):
        bitmaps.append(context.broadcast(bitmap(gram_slots(docs, words, bitmaps, settings), settings.bits)))
    found = found.unionByName(stored(count_phrases(docs, words, bitmaps, settings), "phrases"))
    return found, counts.groupBy("lang").agg(F.sum("n").alias("total"))


def _slice(begin: Column | int, size: Column) -> Column:
    return F.array_join(F.slice("words", begin, size), " ")


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each candidate by its lowest-scoring cut, ties to the earliest."""
    phrases = found.withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words")).where("k > 1")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", F.col("n").alias("a"), "cut",
        _slice(1, F.col("cut")).alias("left"), _slice(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = cuts.join(found.selectExpr("lang", "phrase left", "n l"), ["lang", "left"]).join(found.selectExpr("lang", "phrase right", "n r"), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.join(totals.withColumnRenamed("total", "n"), "lang").withColumns(
        {"above": (whole("a") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)") * whole("n"), "below": whole("l") * whole("r")})
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", *[f"best.{c}" for c in ("a", "l", "r", "n", "score")])


def covered(found: DataFrame, share: int) -> DataFrame:
    """lang, phrase of candidates whose words lie within a longer one of nearly the same count."""
    phrases = found.withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words")).where("k > 1")
    inner = phrases.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1))).select(
        "lang", _slice(F.col("begin"), F.col("size")).alias("phrase"), "n")
    longer = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return phrases.join(longer, ["lang", "phrase"]).where(100 * F.col("longer") >= share * F.col("n")).select("lang", "phrase")


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` candidates.

    Counts are per language; a null one counts as ``und``, a null text as empty. Candidates dropped for a
    longer one leave no rank open; ties go by score, then count, then the bytes of the phrase. Repeated
    rows count as often as they occur; doc_id and extra columns are not read; an empty table gives no rows.
    """
    found, totals = frequent(docs, settings)
    ranked = scored(found, totals).join(covered(found, settings.share), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each lane first, so that no task ranks a whole language.
    lane = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(64))).orderBy(*order)
    ranked = ranked.withColumn("rank", F.row_number().over(lane)).where(F.col("rank") <= settings.top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= settings.top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce("text", ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') ws from pieces),
spans as (
  select lang, ws, k, unnest(range(1, len(ws) - k + 2)) b
  from words, (values (1), (2), (3), (4), (5)) lengths(k) where len(ws) >= k),
f as (
  select lang, k, list_slice(ws, b, b + k - 1) p, count(*) c from spans group by all),
totals as (select lang, sum(c)::hugeint n from f where k = 1 group by lang),
candidates as (select * from f where k > 1 and c >= 100),
cuts as (
  select x.lang, x.p, x.k, x.c a, l.c l, r.c r, t.n, i,
    (1000::hugeint * x.c * t.n) // (l.c::hugeint * r.c) score
  from candidates x cross join (values (1), (2), (3), (4)) cut(i)
  join f l on l.lang = x.lang and l.p = list_slice(x.p, 1, i)
  join f r on r.lang = x.lang and r.p = list_slice(x.p, i + 1, x.k)
  join totals t on t.lang = x.lang
  where i < x.k),
best as (select * from cuts qualify row_number() over (partition by lang, p order by score, i) = 1),
covered as (
  select distinct x.lang, x.p from candidates x join candidates y
    on y.lang = x.lang and y.k > x.k and 100 * y.c >= 100 * x.c
  where list_contains(list_transform(range(1, y.k - x.k + 2), lambda b: list_slice(y.p, b, b + x.k - 1)), x.p)),
ranked as (
  select *, array_to_string(p, ' ') phrase from best anti join covered using (lang, p))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase,
  a, l, r, n::bigint n, score::bigint score
from ranked
qualify "rank" <= 2000
"""
