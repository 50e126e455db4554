"""Small tables for the tests of the llm operators."""

from __future__ import annotations

import re

SF_DIR = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
#: Columns that operators use inside, as extra columns of the input.
CLASHES = ("size", "score", "keys", "lang_pred", "row", "n", "mix_size", "mix_begin", "mix_key", "mix_text", "mix_chunk", "mix_source",
           "mix_base", "mix_before", "keep_id", "keep_key", "keep_text", "keep_words", "llm_lang", "llm_score", "llm_text", "at", "part", "key", "chunk",
           "held_out", "text_key", "root", "digest", "f", "z")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} und{i % 31}," for i in range(20_000))
AWKWARD = [
    (None, None, None, None, None),
    (None, "Nobody knows this text by an id at all.", "en", "b", 3),
    (1, "", "en", "a", 0),
    (2, " \t\n ", "fr", None, 4),
    (3, LONG, "de", "a", len(LONG)),
    (4, "The same few words stand here twice, or more.", "en", "a", 40),
    (4, "The same few words stand here twice, or more.", "en", "a", 40),
    (5, "The same few words stand here twice, or more.", "en", None, 40),
    (6, "THE SAME few words stand here twice, or more.", None, "b", 40),
    (7, "a", "en", "b", 1),
    (8, "1234 5678 !!! <|endoftext|> \u65e5\u672c\u8a9e \u00a0 \u2028 \x00 x", "en", "c", 9),
    (9, "le la les des une qui que pour dans avec sur", "fr", "c", 40),
]


def awkward(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def read(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def words(text):
    """Lower-case words by the plain definition."""
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
