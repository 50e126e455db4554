"""Near-duplicate joins, components and decontamination against brute force."""

import random

import numpy as np
import pytest
from helpers import awkward, empty, read, rows, words

from tidemark.llm import decontamination, embedding_join, ngram_join
from tidemark.llm.graph import components
from tidemark.llm.queries import QUERIES


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def closure(n, pairs):
    root = list(range(n))
    for a, b in pairs * n if n < 30 else pairs * 12:
        root[a] = root[b] = min(root[a], root[b])
        root = [root[r] for r in root]
    return root


def brute(ids, sets, threshold):
    pairs = [(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if sets[i] and sets[j]
             and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12]
    links = [0] * len(ids)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    return links, closure(len(ids), pairs)


def families():
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(t))
    return [(i, t) for i, t in enumerate(texts + texts[:3])]


@pytest.mark.parametrize("tile_members", [256, 3])
def test_ngram_join_on_families(spark, tile_members):
    docs = families()
    j = ngram_join.join(spark.createDataFrame(docs, "doc_id bigint, text string"), tile_members=tile_members)
    got = {r.doc_id: (r.n_links, r.component_id) for r in j.members.join(j.classes, "digest").collect()}
    links, root = brute([i for i, _ in docs], [grams(t) for _, t in docs], 0.8)
    assert got == {i: (links[i], root[i]) for i, _ in docs}


def test_ngram_query(spark):
    docs = read(spark, "documents").orderBy("doc_id").collect()
    links, root = brute([d.doc_id for d in docs], [grams(d.text) for d in docs], 0.8)
    got = {r.doc_id: r for r in QUERIES["op8_ngram_jaccard"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        r = got[d.doc_id]
        assert (r.n_links, r.component_id, r.kept) == (links[i], docs[root[i]].doc_id, root[i] == i)


def test_ngram_edges(spark):
    j = ngram_join.join(awkward(spark))
    assert j.members.count() == 12
    same = [r for r in j.members.join(j.classes, "digest").collect() if r.doc_id in (4, 5, 6)]
    assert len(same) == 4 and {(r.n_links, r.component_id) for r in same} == {(3, 4)}
    assert j.members.filter("digest is null").count() == 3
    kept = ngram_join.one_of_each(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "7", "8", "9", "None", "None"]
    assert ngram_join.one_of_each(empty(spark)).count() == 0


def test_bands_meet_the_recall():
    for recall, most in ((0.9, 64), (0.9999, 192)):
        bands, size = ngram_join.bands_for(0.8, recall, most)
        assert bands * size <= most and 1 - (1 - 0.8 ** size) ** bands >= recall


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [
        (rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    root = {n: n for p in pairs for n in p}
    for _ in range(80):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    alone = {a for a, b in pairs if a == b} - {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: r for n, r in root.items() if n not in alone}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def cosine_brute(made, threshold=0.98):
    ok = [v is not None and l is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in made]
    unit = [np.array(v, float) / np.linalg.norm(v) if k else None for (_, v, _), k in zip(made, ok)]
    pairs = [(i, j) for i in range(len(made)) for j in range(i + 1, len(made)) if ok[i] and ok[j] and made[i][2] == made[j][2]
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    links = [0] * len(made)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    return links, closure(len(made), pairs)


@pytest.mark.parametrize("tile_members", [512, 4])
def test_embedding_join(spark, tile_members):
    rng = np.random.default_rng(6)
    made = []
    for size in (16, 5, 1):
        for label in (0, 1):
            for _ in range(6):
                base = rng.normal(size=size)
                for _ in range(rng.integers(1, 8)):
                    made.append(((base + rng.normal(size=size) * rng.choice([0, 0.02, 0.05])) * rng.uniform(0.1, 9)).astype(np.float32).tolist() + [label])
    made = [(i, m[:-1], m[-1]) for i, m in enumerate(made)]
    n = len(made)
    odd = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1e-30, 0.0], [1e30, 0.0]]
    made += [(n + i, v, 7) for i, v in enumerate(odd)] + [(n + len(odd) + i, made[0][1], None) for i in range(2)]
    df = spark.createDataFrame(made, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_join.near(df, embedding_join.Settings(tile_members=tile_members)).collect()}
    links, root = cosine_brute(made)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {
        i: (links[i], root[i], root[i] == i) for i in range(len(made))}
    assert embedding_join.near(df.limit(0)).count() == 0


def test_embedding_repeats_and_null_ids(spark):
    v = [0.6, 0.8]
    df = spark.createDataFrame([(3, v, 1), (3, v, 1), (None, v, 1), (2, [0.6, 0.81], 1), (9, v, 2)], "vec_id bigint, embedding array<double>, label int")
    got = rows(embedding_join.near(df.selectExpr("*", "'x' as class", "1 as copies")))
    assert got == sorted([(3, 3, 2, False), (3, 3, 2, False), (None, 3, 2, False), (2, 3, 2, True), (9, 0, 9, True)], key=repr)


def distance(pattern, text):
    d = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern):
        new = np.append(i + 1, np.minimum(d[:-1] + (text != c), d[1:] + 1))
        d = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return d.min()


def test_decontamination_finds_what_edit_distance_allows(spark):
    rng = random.Random(2)
    items = [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
    index = decontamination.Index(items, decontamination.Settings())
    filler = [r.text[:300] for r in read(spark, "documents").limit(20).collect()]
    found = 0
    for _ in range(80):
        item, text = rng.choice(items)
        s = list(text)
        for _ in range(rng.randrange(0, 22)):
            at, kind = rng.randrange(len(s)), rng.randrange(3)
            s[at:at + (kind != 1)] = [] if kind == 2 else [rng.choice("abcdez")]
        doc = f"{rng.choice(filler)} {''.join(s)} {rng.choice(filler)}"
        regions = [r for r in index.find(["x", doc, "", doc[:40]]) if r[0] == 1]
        got = {r[1]: r for r in sorted(regions, key=lambda r: -r[4])}
        folded = decontamination.fold([doc], 1)[0][:-1]
        best = [(distance(index.passages[p], folded), index.budget[p]) for p in np.flatnonzero(index.owner == item)]
        allowed = [d for d, k in best if d <= k]
        assert bool(allowed) == (item in got)
        if allowed:
            found += 1
            assert got[item][4] == min(allowed)
            own = sorted(r[2:4] for r in regions if r[1] == item)
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
            assert 0 <= got[item][2] < got[item][3] <= len(doc)
    assert 20 < found < 80


def test_decontamination_query_finds_whole_items(spark):
    docs, items = read(spark, "documents").collect(), read(spark, "benchmark").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in items if d.text and b.text in d.text}
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op2_decontamination"](spark, "/root/testdata/sf0.001").collect()}
    assert want and want <= set(got)
    text = {d.doc_id: d.text for d in docs}
    for (doc, item), r in got.items():
        assert r.distance <= r.budget
        if (doc, item) in want and r.distance == 0:
            whole = next(b.text for b in items if b.item_id == item)
            assert text[doc][r.begin:r.end].strip()[:20] in whole or whole[:10] in text[doc]
    kept = {r.doc_id for r in decontamination.clean(read(spark, "documents"), read(spark, "benchmark")).collect()}
    assert kept == {d.doc_id for d in docs} - {d for d, _ in got}


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, None), (None, "no id"), (2, ""), (3, "short"), (4, "The same few words stand here twice, or more."), (5, "q" * 60)], "item_id bigint, text string")
    got = rows(decontamination.matches(awkward(spark), bench).select("doc_id", "item_id"))
    assert got == [(4, 4), (4, 4), (5, 4), (6, 4)]
    assert len(rows(decontamination.clean(awkward(spark), bench))) == 8
    assert decontamination.matches(empty(spark), bench).count() == 0
    assert decontamination.matches(awkward(spark), bench.limit(0)).count() == 0
    # Blocks of one item each give the same.
    small = decontamination.Settings(block_chars=1)
    assert rows(decontamination.matches(awkward(spark), bench, small).select("doc_id", "item_id")) == got


def test_decontamination_finds_every_excerpt_and_short_item(spark):
    settings = decontamination.Settings()
    items = [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
    index = decontamination.Index(items, settings)
    m = settings.part + settings.stride - 1
    for item, text in items[:8]:
        folded = "".join(map(chr, decontamination.fold([text], 1)[0][:-1]))
        excerpts = [f"0 zq {folded[b:b + m]} zq 0" for b in range(len(folded) - m + 1)]
        assert excerpts and {(r[0], r[1]) for r in index.find(excerpts)} >= {(i, item) for i in range(len(excerpts))}
    # What the long passages allow is still found: all edits in the middle, where every part meets them.
    text = "".join(random.Random(4).choices("abcdefgh ijklmnop", k=100)).replace("  ", " x").strip()
    doc = text[:len(text) // 2 - 4] + "99999999" + text[len(text) // 2 + 4:]
    assert [r[1] for r in decontamination.Index([(1, text)], settings).find([doc])] == [1]
    bench = spark.createDataFrame(
        [(1, "Grand Prix 1950"), (2, " grand-prix, 1950!"), (3, "prix"), (4, "a"), (5, "\u65e5\u672c"), (6, "?!")], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, "The GRAND PRIX (1950)."), (2, "grand prix 19500"), (3, "a prixe"), (4, "\u65e5\u672c"), (5, "Prix. Prix"), (6, None)], "doc_id bigint, text string")
    got = decontamination.matches(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 3), (5, 3)]
    assert {(r.begin, r.end) for r in got if r.doc_id == 1 and r.item_id == 3} == {(10, 14)}
    assert [r.doc_id for r in decontamination.clean(docs, bench).collect()] == [6]


def test_decontamination_reports_every_region(spark):
    items = [(r.item_id, r.text) for r in read(spark, "benchmark").limit(3).collect()]
    index = decontamination.Index(items, decontamination.Settings())
    text = items[1][1]
    doc = f"{text} Something else stands between the two of them here. {text}"
    found = [r for r in index.find([doc]) if r[1] == items[1][0]]
    assert len(found) == 2 and {r[4] for r in found} == {0}
    assert found[0][2] < len(text) < found[1][2]
