"""Secret scan: fixed patterns, and values in a credential context that are costly to guess.

The words of the guess model are the most frequent ones of the documents themselves, counted over
all of them. Texts are scanned whole, in their tasks; nothing but the word counts is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.class_lm import word_counts
from tidemark.llm.common import by_bytes, table, texts_of
from tidemark.llm.guess_cost import LONGEST_WORD, GuessCost

#: The base patterns and the least length that counts, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "guess")

#: Words after which a value is judged by its guess cost, and one that must stand in such a text.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|(?:api|access|private|secret|auth)[_-]?key)"""
    r"""["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["'`]?([^\s"'`,;<>]+)"""
    r"""|bearer\x20+([A-Za-z0-9._~+/=-]+)"""
    r"""|://[^\s/:@]+:([^\s/@]+)@""", re.I | re.A)
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer", "://")

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


@dataclass(frozen=True)
class Settings:
    """A value counts from ``guesses`` (decimal logarithm) on. ``words`` bounds the list of the guess
    model, which is broadcast: at most 24 letters each."""

    guesses: float = 8.0
    words: int = 50_000


class Span(NamedTuple):
    kind: str
    begin: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Matches of the three patterns, by start, then kind."""
    low, found = text.lower(), []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return _ordered(found)


def guess_spans(text: str, model: GuessCost, base: list[Span], guesses: float) -> list[Span]:
    """Values in a credential context outside the base spans that cost ``guesses`` or more."""
    low, found = text.lower(), []
    if any(w in low for w in HINTS):
        for m in CONTEXT.finditer(text):
            begin, end = m.span(m.lastindex)
            if not any(s.begin <= begin and end <= s.end for s in base) and model.cost(text[begin:end]) >= guesses:
                found.append(Span("guess", begin, end))
    return found


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.begin, KINDS.index(s.kind)))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.begin}:{s.end}" for s in spans)


def common_words(docs: DataFrame, limit: int) -> list[str]:
    """The most frequent words of three letters or more, at most ``limit`` of them; ties by the word."""
    bare = F.regexp_extract(F.col("word").cast("string"), r"^[^a-z]*([a-z]+)[^a-z]*$", 1)
    ranked = (word_counts(docs).select(bare.alias("bare"), "c").where(F.length("bare").between(3, LONGEST_WORD))
              .groupBy("bare").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "bare").limit(limit))
    return [r["bare"] for r in ranked.select("bare").collect()]


def secrets(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All spans of every whole text: counts and digest of the base spans, and all spans in order.

    A null text counts as empty: no spans, the digest of the empty string. Positions are code points.
    Rows are independent: repeated rows, null ids and extra columns change nothing; an empty table
    gives an empty result. A value that lies in a base span is not reported twice.
    """
    model = docs.sparkSession.sparkContext.broadcast(GuessCost(common_words(docs, settings.words)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for begin, end in by_bytes(texts, 1 << 22):
                rows = [_row(text, model.value, settings.guesses) for text in texts[begin:end]]
                columns = [pa.array(v, pa.int64() if i < 3 else pa.string()) for i, v in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), *columns],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(scan, SCHEMA)


def _row(text: str, model: GuessCost, guesses: float) -> tuple[int, int, int, str, str]:
    base = base_spans(text)
    spans = _ordered(base + guess_spans(text, model, base, guesses))
    counts = [sum(s.kind == kind for s in base) for kind in KINDS[:3]]
    return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
