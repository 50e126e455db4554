"""Class language model, language identification and the toxicity chain."""

import collections
import itertools
import math
import zlib

import numpy as np
import pytest
from helpers import awkward, empty, read, rows, words

from tidemark.llm import class_lm, crf, language_id, toxicity
from tidemark.llm.queries import QUERIES

SMALL = class_lm.Settings(frequent=200, endings=64, classes=8, rounds=4)


def held(doc_id, n, r):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == r


def base_of(texts):
    counts = collections.Counter()
    for doc_id, text in texts:
        if not held(doc_id, 7, 2):
            counts.update([*words(text), "\n"])
    n, v = sum(counts.values()), len(counts)
    return [
        (doc_id, held(doc_id, 7, 2), len(found), sum(counts[w] > 0 for w in found), n,
         sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in found))
        for doc_id, text in texts for found in [[*words(text), "\n"]]]


def check_base(got, texts):
    got = sorted([tuple(r)[:6] for r in got], key=repr)
    want = sorted(base_of(texts), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_class_lm_base_counts_and_gain(spark):
    docs = read(spark, "documents")
    got = class_lm.score(docs).collect()
    check_base(got, [(r.doc_id, r.text) for r in docs.collect()])
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in got)


def test_class_lm_edges(spark):
    docs = awkward(spark)
    got = class_lm.score(docs, SMALL).collect()
    check_base(got, [(r.doc_id, r.text) for r in docs.collect()])
    assert class_lm.score(empty(spark), SMALL).count() == 0


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    s = class_lm.Settings(frequent=5, endings=4, classes=3)
    units = class_lm.Units([class_lm.END, b"a", b"b", b"c", b"d", b"e"], s)
    frequent, tokens, kinds = np.array([9.0, 5, 4, 3, 2, 1]), np.array([7.0, 0, 3, 2]), np.array([3.0, 0, 1, 2])
    counts = np.concatenate([frequent, tokens])
    m = class_lm._Model(units, rng.integers(0, 3, 10), rng.integers(0, 9, (3, 3)).astype(float), counts, kinds, frequent, 36, 12, s)
    assert np.allclose((10 ** m.move).sum(axis=1), 1)
    for c in range(3):
        at = np.flatnonzero(m.classes == c)
        emit = 10 ** m.emit[at]
        # A rare unit shares its probability among its kinds and one unseen word.
        tail = at >= units.n_frequent
        e = at[tail] - units.n_frequent
        emit[tail] *= tokens[e] + s.discount * (kinds[e] + 1)
        assert not len(at) or np.isclose(emit.sum(), 1)


def test_exchange_move_is_the_likelihood_optimum():
    rng = np.random.default_rng(3)
    v, k = 12, 3
    bigrams = rng.integers(0, 6, (v, v)).astype(float)
    np.fill_diagonal(bigrams, 0)
    classes = rng.integers(0, k, v)

    def likelihood(c):
        m = np.zeros((k, k))
        np.add.at(m, (c[:, None], c[None, :]), bigrams)
        t = m.sum(axis=1), m.sum(axis=0)
        return class_lm._xlogx(m).sum() - class_lm._xlogx(t[0]).sum() - class_lm._xlogx(t[1]).sum()

    m = np.zeros((k, k))
    np.add.at(m, (classes[:, None], classes[None, :]), bigrams)
    follow = np.stack([bigrams[:, classes == c].sum(axis=1) for c in range(k)], axis=1)
    before = np.stack([bigrams.T[:, classes == c].sum(axis=1) for c in range(k)], axis=1)
    new = class_lm.best_classes(follow, before, classes, m)
    better = worse = 0
    for u in np.flatnonzero(new != classes):
        moved = classes.copy()
        moved[u] = new[u]
        better, worse = better + (likelihood(moved) > likelihood(classes)), worse + (likelihood(moved) < likelihood(classes) - 1e-9)
    assert better > worse


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    for n, k in ((1, 2), (5, 3), (6, 2)):
        scores, moves = rng.normal(size=(n, k)), rng.normal(size=(k, k))
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            p = math.exp(sum(scores[t, path[t]] for t in range(n)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            want[range(n), path] += p
        want /= want.sum(axis=1, keepdims=True)
        for segment in (1, 2, 4, 128):
            assert np.allclose(crf.marginals(scores, np.array([0]), moves, segment), want)


def test_language_id_held_out_accuracy(spark):
    docs = read(spark, "documents")
    got = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, "/root/testdata/sf0.001").collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    unseen = [r for r in got.values() if r.held_out]
    assert {i for i in got if got[i].held_out} == {i for i in got if held(i, 3, 1)}
    assert sum(r.lang_pred == lang[r.doc_id] for r in unseen) / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_id_code_switch_and_edges(spark):
    model = language_id.fit(read(spark, "documents"))
    texts = {r.lang: r.text for r in read(spark, "documents").filter("length(text) > 600").collect()}
    mixed = " ".join(texts["en"].split()[:60] + texts["de"].split()[:40])
    df = spark.createDataFrame([(1, mixed)], "doc_id bigint, text string")
    (row,) = language_id.predict(df, model, ["doc_id"], spans=True).collect()
    share = collections.Counter()
    for s in row.spans:
        share[s.lang] += s.end - s.begin
    assert row.lang_pred == "en" and share["en"] > share["de"] > 20
    got = language_id.predict(awkward(spark), model, ["doc_id", "lang_pred"], names=("p", "s", "r")).collect()
    assert len(got) == 12
    assert all(r.p == "und" and r.s == 0 for r in got if r.doc_id in (1, 2))
    kept = language_id.accepted(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert language_id.accepted(empty(spark)).count() == 0
    nothing = language_id.fit(awkward(spark).filter("lang is null"))
    assert nothing.languages == []
    assert {r.lang_pred for r in language_id.predict(awkward(spark).select("text", "doc_id"), nothing, ["doc_id"]).collect()} == {"und"}


def test_toxicity_chain(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    made = []
    for i in range(600):
        text = rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 30).tolist()
        bad, worse = rng.random() < 0.4, False
        if bad:
            text += ["junky"]
            worse = rng.random() < 0.5
            text += ["nasty"] * worse
        made.append((i, " ".join(text), int(bad), int(worse)))
    df = spark.createDataFrame(made, "doc_id bigint, text string, bad int, worse int")
    model = toxicity.fit(df.filter("doc_id < 400"), df, [("bad", F.col("bad")), ("worse", F.col("worse"))])
    assert model.chain[1, 0] != 0 and model.chain[0].sum() == 0
    got = {r.doc_id: r for r in toxicity.predict(df, model).collect()}
    right = [got[i].worse == bool(w) for i, _, _, w in made if i >= 400]
    assert np.mean(right) > 0.97
    edge = toxicity.predict(awkward(spark), model).collect()
    assert len(edge) == 12 and not any(r.worse for r in edge if r.doc_id in (1, 2))
    assert toxicity.predict(empty(spark), model).count() == 0
    # No labels at all: base rates, nothing flagged below one half.
    none = toxicity.fit(df, df.limit(0), [("bad", F.col("bad")), ("worse", F.col("worse"))])
    assert toxicity.predict(df, none).count() == 600


@pytest.mark.parametrize("key", ["op6_toxicity_chain"])
def test_toxicity_query_covers_all_documents(spark, key):
    got = QUERIES[key](spark, "/root/testdata/sf0.001")
    assert rows(got.select("doc_id")) == rows(read(spark, "documents").select("doc_id"))


def test_numbers_are_no_letters(spark):
    model = language_id.fit(read(spark, "documents"))
    docs = spark.createDataFrame([(1, "\u00bd \u00b2 \u2460 12 !_"), (2, "\u4e8c"), (3, "a\u00bdb")], "doc_id bigint, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    assert got[1] == "und" and got[2] != "und" and got[3] != "und"
    assert crf.words_of("a\u00bdb \u4e8c3") == ["a", "b", "\u4e8c"]


def test_every_language_is_learned(spark):
    rows = [(i, f"wort{i} sprache{i} " * 20, f"l{i:03}") for i in range(230)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 230
