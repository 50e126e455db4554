"""Token counts, token files, the mix, URL filter, and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, SF_DIR, awkward, empty, read, rows, words
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import mixing, rangecoder, token_counts, token_output, url_filter
from tidemark.llm.common import scratch
from tidemark.llm.pieces import PieceEncoder
from tidemark.llm.queries import ORACLE_SQL, QUERIES

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE)
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rng = random.Random(1)
    return ["", " ", "  a", "it's  <|endoftext|> x<|endoftext|>  y \n\n z ", "a" * 3000, "\x85 b \xa0 c"] + [
        "".join(rng.choice(" \n\t\x0b\x1c\x85\xa0ab1'.\u00e9<|>") for _ in range(rng.randint(0, 40))) for _ in range(3000)]


def test_pieces_equal_the_library(library):
    texts, e = odd_texts(), PieceEncoder(BPE, memo=500)
    want, got = library(texts), []
    for i in range(0, len(texts), 100):
        ids, sizes = e.ids(texts[i:i + 100])
        got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert e.lengths(texts[i:i + 100]).tolist() == sizes.tolist()
    assert got == want


def test_words_reach_the_library_once(library):
    class Recorder:
        def __init__(self, inner):
            self.inner, self.chars = inner, 0

        def encode_batch_fast(self, runs, **options):
            self.chars += sum(map(len, runs))
            return self.inner.encode_batch_fast(runs, **options)

    known = [f"w{i:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(500)]
    texts = [gap.join(w + mark for w in known) for mark in ("", "&&&", ",", ").", "'") for gap in (" ", "\n")]
    e = PieceEncoder(BPE)
    e.tokenizer = Recorder(e.tokenizer)
    got = [x.tolist() for t in texts for x in [e.ids([t])[0]]]
    assert got == library(texts)
    # Once behind a space, once behind a line feed, whatever marks follow.
    assert e.tokenizer.chars < 2.2 * len(texts[0])


def test_cuts_keep_white_space_before_special_tokens(library):
    texts = ["a\n\n<|endoftext|>", "\n\n<|endoftext|>\n<|endoftext|>\n\nb", "a  <|endoftext|> <|endoftext|>", "\r\n\r", "a\n \nb\n"]
    e = PieceEncoder(BPE, memo=3)
    assert [e.ids([t])[0].tolist() for t in texts] == library(texts)


def test_token_counts(spark, library):
    df = token_counts.token_counts(awkward(spark), BPE, limit=5, batch_chars=100)
    want = [(i, len((t or "").encode()), len(ids), len(ids) > 5) for (i, t, *_), ids in zip(AWKWARD, library([r[1] or "" for r in AWKWARD]))]
    assert rows(df) == sorted(want, key=repr)
    assert token_counts.token_counts(empty(spark), BPE).count() == 0


def test_range_coder_round_trip():
    rng = np.random.default_rng(7)
    for n, high in ((0, 1), (1, 9), (5, 3), (255, 1), (256, 2), (4000, 60_000), (20_000, 300)):
        ids = rng.integers(0, high, n)
        ids[n // 2:] = ids[:n - n // 2]
        block = rangecoder.encode(ids)
        assert rangecoder.decode(block).tolist() == ids.tolist()
    text = np.tile(rng.integers(0, 50_000, 500), 60)
    assert len(rangecoder.encode(text)) < len(text)
    broken = bytearray(block)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode(bytes(broken))
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([rangecoder.ID_LIMIT]))


def test_range_coder_bytes_stay():
    ids = np.random.default_rng(3).zipf(1.3, 60_000) % 50_000
    ids[30_000:45_000] = ids[:15_000]
    block = rangecoder.encode(ids)
    # Fixed value: the block as the first version of the coder wrote it.
    assert zlib.crc32(block) == 2020042744
    assert (rangecoder.decode(block) == ids).all()


def test_crc_join():
    a, b = b"some bytes", b"and others"
    assert token_output.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_output.crc_join(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


@pytest.mark.parametrize("block_ids", [1 << 20, 5_000])
def test_token_files(spark, library, block_ids):
    path = scratch(spark, "test")
    token_output.write_tokens(awkward(spark), path, BPE, block_ids=block_ids)
    blocks = token_output.read_blocks(spark, path)
    got = sorted(token_output.token_digest(blocks).collect(), key=lambda r: r.start)
    want = sorted([(r[0], [*ids, 2]) for r, ids in zip(AWKWARD, library([r[1] or "" for r in AWKWARD]))], key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    crc = sorted((str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == crc
    parts = token_output.read_tokens(blocks).collect()
    assert sum(len(p.ids) for p in parts) == sum(len(ids) for _, ids in want)


def test_token_files_empty(spark):
    path = scratch(spark, "test")
    token_output.write_tokens(empty(spark), path, BPE)
    assert token_output.token_digest(token_output.read_blocks(spark, path)).count() == 0


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("documents", "pages", "labels"):
        c.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, key):
    df = QUERIES[key](spark, SF_DIR)
    want = con.execute(ORACLE_SQL[key])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.select(*names)) == sorted((tuple(r) for r in want.fetchall()), key=repr)


def test_target_levels(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 20):
        sizes = [rng.choice([0, 1, 10, 500, 9000]) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:02}" if i < n - 1 else None, s) for i, s in enumerate(sizes)], "source string, source_size bigint")
        got = [r.target for r in sorted(mixing.targets(df).collect(), key=lambda r: (r.source is None, r.source))]
        if sum(sizes):
            assert np.allclose(got, _levels(sizes))


def _levels(sizes):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    total, capped = 1.5 * sum(sizes), set()
    while True:
        rest = total - sum(2 * sizes[i] for i in capped)
        share = sum(w for i, w in enumerate(weights) if i not in capped)
        out = [2.0 * s if i in capped else rest * weights[i] / share for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(out) if i not in capped and t > 2 * sizes[i] + 1e-9}
        if not over:
            return out
        capped |= over


def test_mix_words_and_edges(spark):
    m = mixing.mix(awkward(spark))
    sizes = sorted((str(r.row.doc_id), r.mix_size) for r in m.docs.collect())
    assert sizes == sorted((str(r[0]), len(words(r[1]))) for r in AWKWARD)
    out = mixing.mixed_documents(awkward(spark))
    assert out.columns == awkward(spark).columns
    taken = {}
    for r in out.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words(r.text))
    assert all(taken[i] <= 2 * sum(len(words(r[1])) for r in AWKWARD if r[0] == i) for i in taken)
    assert mixing.mixed_documents(empty(spark)).count() == 0
    assert rows(mixing.mixed_documents(read(spark, "documents")).select("doc_id")) == rows(
        mixing.mixed_documents(read(spark, "documents").repartition(7)).select("doc_id"))


def test_mix_sources_near_their_targets(spark):
    got = QUERIES["op4_mix_schedule"](spark, SF_DIR).collect()
    by = {}
    for r in got:
        assert r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= n / -(-n // mixing.BLOCK_WORDS) for (n, target), t in by.items())


def test_mixed_documents_of_small_sources_near_their_targets(spark):
    sizes = {f"s{i:02}": n for i, n in enumerate([100, 257, 600, 1, 300] * 8 + [200_000])} | {None: 120}
    docs = spark.createDataFrame(
        [(i * 1000 + k, "w " * min(700, n - k * 700), "en", s, 0) for i, (s, n) in enumerate(sizes.items()) for k in range(-(-n // 700))],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    goals = {r.source: r.target for r in mixing.mix(docs).sources.collect()}
    got = dict.fromkeys(sizes, 0)
    for r in mixing.mixed_documents(docs).collect():
        got[r.source] += len(words(r.text))
    for s, n in sizes.items():
        block = n / -(-n // mixing.BLOCK_WORDS)
        assert 0 < got[s] <= 2 * n and abs(got[s] - goals[s]) <= block, (s, n, got[s], goals[s])
    sums = dict.fromkeys(sizes, 0)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(ORACLE_SQL["op4_mix_schedule"]).fetchall()
    for r in mixing.taken(mixing.mix(docs)).collect():
        sums[r.source] += r.n
    assert sums == got and sum(got.values()) == sum(w[4] for w in want)
    m = mixing.mix(docs)
    assert sum(r.to_word - r.from_word for r in m.pieces.collect()) == sum(sizes.values())
    # Any first part of the schedule has each source's share, to a few slots.
    at = sorted((r.at, r.source or "") for r in m.schedule.collect())
    for part in (0.25, 0.5, 0.9):
        for s in {s for _, s in at}:
            n = sum(x == s for _, x in at)
            assert abs(sum(x == s for t, x in at if t < part) - part * n) < 3


def test_url_edges(spark):
    pages = spark.createDataFrame([
        (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://Example.ORG"), (6, "x://a.example.org/es/1?q#f"),
        (7, "http://notexample.org/es/"), (8, "http://example.org/en/12"), (9, "http://w.com/de/a"), (10, "http://w.com/fr/a"),
        (11, "http://u.com?x=http://v.org/"), (11, "http://u.com?x=http://v.org/"), (None, "http://b.co.uk/p#h"),
    ], "page_id bigint, url string").selectExpr("*", "'x' as host", "'y' as good", "'z' as path")
    labels = spark.createDataFrame([(1, 0), (None, 1), (5, None), (9, 1), (9, 0)], "page_id bigint, good int")
    got = rows(url_filter.judge(pages, labels).select("page_id", "host", "path", "rule", "verdict"))
    assert got == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "example.org", "", None, "allow"), (6, "a.example.org", "/es/1", "example.org/es/", "block"),
        (7, "notexample.org", "/es/", "org/", "allow"), (8, "example.org", "/en/12", "example.org/en/1", "block"),
        (9, "w.com", "/de/a", "com/de/", "block"), (10, "w.com", "/fr/a", "com/fr/", "allow"),
        (11, "u.com", "", None, "allow"), (11, "u.com", "", None, "allow"), (None, "b.co.uk", "/p", None, "allow"),
    ], key=repr)
    assert url_filter.judge(pages.limit(0), labels).count() == 0
    assert url_filter.judge(pages, labels.limit(0)).count() == 13


def test_url_reputation_blocks_bad_hosts(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.example.net/{i}") for i in range(200)]
    labels = [(i, 0 if i % 2 else 1) for i in range(0, 150)]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, good int"))
    assert {(r.host, r.verdict) for r in got.collect()} == {("bad.example.net", "block"), ("good.example.net", "allow")}
    d, s = url_filter.domain_of, url_filter.suffix_of
    from pyspark.sql import functions as F

    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.com",), ("com",), ("",), ("m.x.example.org",)], "h string")
    assert rows(hosts.select("h", s(F.col("h")).alias("s")).select("h", "s", d(F.col("h"), F.col("s")))) == sorted([
        ("a.b.co.uk", "co.uk", "b.co.uk"), ("co.uk", "co.uk", "co.uk"), ("x.com", "com", "x.com"), ("com", "com", "com"),
        ("", "", ""), ("m.x.example.org", "org", "example.org")])


def test_pipeline_and_registration(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {k.split("_")[0] for k in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "source_mix", "token_output"]
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert got and [r.start for r in sorted(got, key=lambda r: r.start)] == np.cumsum(
        [0, *[r.n_tokens for r in sorted(got, key=lambda r: r.start)]])[:-1].tolist()
    ids = {r.doc_id for r in got}
    assert ids <= {r.doc_id for r in read(spark, "documents").collect()}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (awkward(spark), empty(spark)):
        out = stage(spark, docs, SF_DIR)
        found = out.collect()
        if name != "token_output":
            assert out.columns == docs.columns
            assert all(r[c] == "x" for r in found for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars"))
