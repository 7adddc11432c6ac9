"""Corpus operators on small inputs: odd rows, planted cases, and brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from llm_helpers import brute_components, brute_lines, words
from pyspark.sql import functions as F

from rangeloom.llm import ann, bit_sliced, html_text, jaccard_join, language_id, line_dedup, packing, quality, sharding, source_mix
from rangeloom.llm.components import connected_components
from rangeloom.llm.cuckoo import CuckooFilter, as_words


# --- language identification


def test_language_odd_rows(odd_docs):
    model = language_id.train(odd_docs)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.predict(odd_docs, model).collect()}
    assert got[1, None] == ("und", 0.0) and got[2, ""] == ("und", 0.0) and got[3, " \t\n"] == ("und", 0.0)
    assert language_id.predict(odd_docs.limit(0), model).count() == 0
    empty = language_id.train(odd_docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd_docs, empty).collect()} == {"und"}


def test_language_backs_off_to_shorter_grams(spark, make_docs):
    docs = make_docs(["schlange schule schwarz"] * 30 + ["queso quince quedar"] * 30, langs={i: "de" if i < 30 else "es" for i in range(60)})
    model = language_id.train(docs)
    score = lambda text, many=model.scorer(): many([text])[0]
    assert score("schule")[0] == "de" and score("quince")[0] == "es"
    assert score("schwalbe")[0] == "de" and score("quizas")[0] == "es"
    assert score("zzz###")[0] in ("de", "es")
    assert {score(x)[0] for x in ("123", "\u00bd \u00b2 \u2167 \u0661", "_ - !", "\u0301")} == {"und"}
    assert language_id.find_words("a\u0301b \u0939\u093f\u0928\u094d\u0926\u0940 x1y") == ["a\u0301b", "\u0939\u093f\u0928\u094d\u0926\u0940", "x", "y"]
    assert language_id.find_words("\U00010400\U00010401 b\u00e9 \U0001f600 \u01c5x") == ["\U00010400\U00010401", "b\u00e9", "\u01c5x"] and language_id.find_words("na\u00efve \u00bd") == ["na\u00efve"]


# --- source mixing


def water_fill(sizes, weights, epochs):
    total, open_ = sum(sizes.values()), set(sizes)
    target = {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] >= epochs * sizes[s]}
        if not over:
            return target | share
        target |= {s: float(epochs * sizes[s]) for s in over}
        open_ -= over
    return target


def test_mix_targets_and_words(make_docs, rng):
    sources = {i: f"s{min(i % 11, 6)}" for i in range(150)}
    docs = make_docs([words(rng, rng.randrange(1, 60) if i % 11 else 400) for i in range(150)], sources=sources)
    plan = source_mix.mix_plan(docs).collect()
    sizes = Counter()
    for r in plan:
        sizes[r.source] += r["size"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    expected = water_fill(sizes, weights, 3)
    taken = Counter()
    for r in plan:
        assert abs(r.target - expected[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, plan)) == sorted(map(tuple, source_mix.mix_plan(docs).collect()))
    mixed = source_mix.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == +taken


def test_mix_odd_rows(odd_docs):
    plan = source_mix.mix_plan(odd_docs).collect()
    assert len(plan) == odd_docs.count() and all(r.taken == 0 for r in plan if r["size"] == 0)
    assert source_mix.mix_plan(odd_docs.limit(0)).count() == 0
    assert source_mix.mix_documents(odd_docs).columns == odd_docs.columns


# --- line dedup


def test_cuckoo_filter_holds_and_forgets():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(3000)]
    f = CuckooFilter.sized_for(2000)
    f.insert(*keys[:2000])
    assert f.contains(as_words(keys[:2000])).all()
    assert f.contains(as_words(keys[2000:])).mean() < 0.01
    again = CuckooFilter.from_bytes(*f.to_bytes())
    again.delete(*keys[:1000])
    assert again.contains(as_words(keys[1000:2000])).all() and again.contains(as_words(keys[:1000])).mean() < 0.01


def test_overfull_cuckoo_filter_stays_sound():
    keys = [hashlib.md5(bytes([i])).digest() for i in range(200)]
    f = CuckooFilter(16)
    f.insert(*keys)
    f = CuckooFilter.from_bytes(*f.to_bytes())
    assert len(f.stash) >= 200 - 64 and f.contains(as_words(keys)).all()
    f.delete(*keys[::2])
    assert f.contains(as_words(keys[1::2])).all()
    with pytest.raises(KeyError):
        CuckooFilter(16).delete(keys[0])


def test_line_dedup_against_brute_force(make_docs, rng):
    common = ["Share this!", "  SHARE this!\t", "Éa", "ÉA", "", "menu", "Menu "]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.5 else words(rng, 4) for _ in range(rng.randrange(1, 12))) for _ in range(60)] + [None, ""]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(make_docs(texts), min_docs=10).collect()}
    for i, kept in enumerate(brute_lines(texts, 10)):
        assert got[i].text == kept and got[i].n_lines == len((texts[i] or "").split("\n"))


def test_line_index_insert_delete_is_reversible(spark, make_docs, rng):
    docs = make_docs(["\n".join(words(rng, 1, ["a", "b", "c"])[:2] for _ in range(6)) for _ in range(80)])
    first, second = docs.where("doc_id < 40"), docs.where("doc_id >= 40")
    one = line_dedup.LineIndex.empty(spark, min_docs=5).insert(first)
    back = one.insert(second).delete(second)
    rows = lambda ix: sorted((bytes(r.key), r.n_docs) for r in ix.refs.collect())
    assert rows(one) == rows(back)
    text = lambda ix: sorted((r.doc_id, r.text) for r in ix.apply(docs).collect())
    assert text(one) == text(back)
    # Beyond the bounds of broadcasts the lines join the exact counts.
    for bounds in ({"max_filter_bytes": 0}, {"max_exact_bytes": 0}):
        assert text(one) == sorted((r.doc_id, r.text) for r in one.apply(docs, **bounds).collect())


def test_filters_of_many_shards_keep_every_key(spark):
    """Over growing and shrinking shards each frequent key is in its shard's filter, and nearly no other key is."""
    lines = lambda a, b: spark.range(a, b, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))
    one = line_dedup.LineIndex.empty(spark, min_docs=1, shard_keys=500).insert(lines(0, 3_000))
    grown = one.insert(lines(3_000, 60_000))
    back = grown.delete(lines(3_000, 60_000)).delete(lines(0, 100)).insert(lines(0, 100))
    assert one.shards == 8 and grown.shards == 128 == back.shards
    key = lambda i: hashlib.md5(b"line %d" % i).digest()
    for index, last in ((one, 3_000), (grown, 60_000), (back, 3_000)):
        shared = index._shared_filters(1 << 30)
        held = line_dedup._Filters(index.shards, shared).hits([key(i) for i in range(60_000)]).tolist()
        assert held[:last] == list(range(last)) and len(held) - last < 200


def test_hot_line_and_shared_ids(spark):
    """A line in every document, and ids that repeat: every row counts as a document of its own."""
    rows = [(i % 40, f"hot line\nown {i}\n{'pair' if i < 2 else 'x' + str(i)}") for i in range(400)] + [(None, "hot line\npair")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(50)
    for bounds in ({}, {"max_filter_bytes": 0}, {"max_exact_bytes": 0}):
        got = sorted((str(r.doc_id), r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs, min_docs=4, **bounds).collect())
        expected = [(str(d), "\n".join(x for x in t.split("\n") if x not in ("hot line", "pair")), sum(x in ("hot line", "pair") for x in t.split("\n"))) for d, t in rows]
        assert got == sorted(expected)


def test_line_dedup_odd_rows(odd_docs):
    got = line_dedup.dedup_lines(odd_docs, min_docs=2)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(r.text is not None for r in rows)
    assert [r.text for r in rows if r.doc_id == 5] == ["", ""]
    assert line_dedup.dedup_lines(odd_docs.limit(0)).count() == 0


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>Site</header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head&amp;line</h1><p>One <b>two</b>&nbsp;three<br>four<p>five &lt;six&gt;
<aside>Related</aside><div class="ad-slot">Buy</div><form><input value=q>Search</form><ul><li>a<li>b</ul></article>
<section id="comments"><p>First!</p></section><div class='sidebar'>Side</div><!-- <p>no</p> --><footer>&copy; me</footer></body></html>"""


def test_html_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", PAGE), (2, None, None), (3, "::", "just <b>text</b> &amp; <p>more"), (4, "http://a.org/y", "<p>a<table><tr><td>1<td>2<tr><td>3</table>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got[1] == "Head&line One two three four five <six> a b"
    assert got[2] == "" and got[3] == "just text & more" and got[4] == "a 1 2 3"
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_templates_go_but_repeated_articles_stay(spark):
    box = "<div><p>Call us at our shop</p></div>"
    pages = [(i, "http://h.org/%d" % i, f"<body>{box}<div><p>Story {i} told</p></div></body>") for i in range(20)]
    pages += [(100 + i, "http://copy.org/%d" % i, "<body><div><p>The same story</p></div></body>") for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} told" for i in range(20))
    assert all(got[100 + i] == "The same story" for i in range(20))


def test_deep_and_broken_markup(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 3000
    pages = spark.createDataFrame([(1, "u", deep), (2, "u", "<a href='x>y</a><p"), (3, "u", "<script>never closed")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got[1] == "x" and got[3] == ""


# --- search


def brute_inner(vectors, k):
    q = {i: np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(np.int64) for i, v in vectors}
    out = {}
    for i in q:
        if i % 50 == 0:
            out[i] = [(j, int(q[i] @ q[j])) for j in sorted((j for j in q if j != i), key=lambda j: (-int(q[i] @ q[j]), j))[:k]]
    return out


def test_bit_sliced_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=7).round(1).tolist()) for i in range(230)] + [(i, [0.5] * 7) for i in range(230, 300)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {}
    for r in bit_sliced.top_k(df, F.col("vec_id") % 50 == 0, k=5, block_rows=64, unit_queries=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_inner(vectors, 5)


def test_bit_sliced_large_components(spark):
    """Exact beyond 2^53, saturated beyond a long, and vectors of several lengths."""
    rows = [(0, [1e6, -3e5, 1.0]), (1, [-2e6, 7.0]), (2, [9e8, 1e9, 3e7]), (3, [1e30, 0.0]), (4, [-1e30]), (50, [1e30, 1.0, 2.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): (r.rank, r.score) for r in bit_sliced.top_k(df, F.col("vec_id") % 50 == 0, k=9, block_rows=2).collect()}
    clip = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
    q = {i: [clip(int(np.floor(256 * x))) for x in v] for i, v in rows}
    for a in (0, 50):
        score = {b: clip(sum(x * y for x, y in zip(q[a], q[b]))) for b in q if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        assert {k: v for k, v in got.items() if k[0] == a} == {(a, b): (i + 1, score[b]) for i, b in enumerate(order)}


ODD_VECTORS = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (100, [float("nan"), 1.0]), (1, None), (2, [None, 1.0]), (3, [float("inf"), 0.0]), (None, [1.0, 1.0]), (4, [3.0, 1.0]), (4, [3.0, 1.0]), (5, [3.0, 1.0])]


def test_search_odd_vectors(spark):
    df = spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<float>").withColumn("label", F.lit("x")).withColumn("score", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in bit_sliced.top_k(df, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 4, 65536 * 5), (0, 2, 4, 65536 * 5), (0, 3, 5, 65536 * 5)] and [g[2] for g in got[3:]] == [0, 4, 4]
    near = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 100 == 0, k=5).orderBy("rank").collect()]
    assert near == [(0, 1, 4), (0, 2, 4), (0, 3, 5)]
    assert bit_sliced.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_visits_best_bins_first():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 8)) + 20 * rng.normal(size=8) for _ in range(6)])
    tree = ann.build_tree(x, branch=4, leaf_rows=30, rounds=5, seed=1)
    assert sorted(tree.visit(x[0], tree.leaves)) == list(range(tree.leaves))
    assert np.mean([tree.visit(v, 1)[0] == leaf for v, leaf in zip(x, tree.file(x), strict=True)]) > 0.95
    assert ann.calibrate(tree, x, k=5, recall=0.95, probes=100, seed=1) < tree.leaves // 2


def test_hot_vector_is_many_units(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(300)] + [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [r.vec_id for r in ann.nearest(df, F.col("vec_id") == 100, k=5, chunk_rows=50, batch_queries=1).orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 4]


def test_tree_grows_with_the_table(spark):
    """Leaves are split again and again, a hot vector cannot be; recall holds."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(400, 6)) + 4 * rng.normal(size=6) for _ in range(8)] + [np.ones((300, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=5, sample_rows=400, leaf_rows=100, split_rows=120, max_levels=4, chunk_rows=100, batch_queries=8).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, len(x), 50):
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits.append(len(got[q] & set(np.argsort(far, kind="stable")[:5].tolist())) / 5)
    assert len(got) == 70 and np.mean(hits) >= 0.9


# --- Jaccard join


def near_copy(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("block", "piece"), [(64, 2048), (3, 7)])
def test_jaccard_join_against_brute_force(make_docs, rng, monkeypatch, block, piece):
    """Also with families of many pieces, whose near copies lie on both sides of the threshold."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_join, "PIECE_SETS", piece)
    monkeypatch.setattr(jaccard_join, "SPOKESMEN", min(16, piece // 2))
    base = [words(rng, n) for n in (5, 8, 30, 120, 300)]
    passage = words(rng, 60)
    texts = [near_copy(rng, rng.choice(base), rng.randrange(0, 9)) for _ in range(70)]
    texts += [f"{words(rng, 40)} {passage} {words(rng, 20)}" for _ in range(15)] + [base[3].upper(), base[3] + "\n", None, "", " ", "one two", "One  Two", "one"]
    texts += [near_copy(rng, base[4], 2) for _ in range(20)]
    sizes, classes = brute_components(texts)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(make_docs(texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == classes


def test_jaccard_threshold_is_exact(make_docs):
    w = [f"w{i}" for i in range(60)]
    texts = [" ".join(w[:20]), " ".join(w[:16]), " ".join(w[:15]), " ".join(w[30:50])]  # 16, 12 and 11 shingles: 12/16 links, 11/16 does not
    sizes, classes = brute_components(texts)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(make_docs(texts)).collect()}
    assert [got[i] for i in range(4)] == classes


def test_trie_join_equals_all_pairs():
    rng = random.Random(5)
    for _ in range(30):
        sets = sorted((np.array(sorted(rng.sample(range(40), rng.randrange(3, 30))), np.uint64) for _ in range(25)), key=len)
        linked = [(i, j) for i, j in itertools.combinations(range(25), 2) if 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - b)]

        def classes(pairs):
            up = list(range(25))
            for _ in range(25):
                for i, j in pairs:
                    up[i] = up[j] = min(up[i], up[j])
            return up

        found = jaccard_join.trie_join(sets, 75, 100)
        assert set(found) <= set(linked) and classes(found) == classes(linked)


def test_jaccard_odd_rows(odd_docs):
    got = jaccard_join.near_duplicates(odd_docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[1] == by[2] == [(0, 1)] or (by[1] == [(0, 1)] and by[2] == [(0, 2)])
    assert by[None] == [(1, None)] and by[5] == [(1, 5), (1, 5)] and len(got) == odd_docs.count()
    assert jaccard_join.near_duplicates(odd_docs.limit(0)).count() == 0
    assert jaccard_join.keep_one(odd_docs).columns == odd_docs.columns


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[100 + i] == 100 for i in range(60))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- packing


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_respects_every_capacity(rule):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 77, 400))[::-1]
    at, offset = packing.best_fit(lengths, 128, 3, 6000, (1.0, 0.2, 0.2), rule)
    for s in set(at.tolist()):
        inside = np.flatnonzero(at == s)
        order = inside[np.argsort(offset[inside])]
        assert lengths[inside].sum() <= 128 and len(inside) <= 3 and (lengths[inside] ** 2).sum() <= 6000 or len(inside) == 1
        assert (np.cumsum(lengths[order]) - lengths[order] == offset[order]).all()


def test_best_fit_picks_the_tightest_sequence():
    at, offset = packing.best_fit(np.array([70, 60, 40, 30]), 100, 100, 10**6, (1.0, 0.0, 0.0), "norm")
    assert at.tolist() == [0, 1, 1, 0] and offset.tolist() == [0, 0, 60, 70]
    with pytest.raises(ValueError, match="capacity"):
        packing.best_fit(np.array([50]), 100, 10, 100, (1.0, 0.0, 0.0), "norm")


def test_packing_odd_rows(odd_docs):
    rows = packing.pack_documents(odd_docs, group_pieces=3).collect()
    by = Counter((r.doc_id, r.piece) for r in rows)
    assert by[1, 0] == by[2, 0] == 1 and by[5, 0] == 2 and sum(r.length for r in rows if r.doc_id == 1) == 1
    assert packing.pack_documents(odd_docs.limit(0)).count() == 0


# --- sharding


def test_differencing_beats_greedy_and_keeps_every_part():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1000, 300)
    parts = np.zeros((300, 4), np.int64)
    parts[:, 0] = sizes
    into = sharding.difference(parts)
    assert all(sorted(row) == [0, 1, 2, 3] for row in into.tolist())
    sums = np.bincount(into[:, 0], weights=sizes, minlength=4)
    assert sums.max() - sums.min() <= 3
    assert sharding.difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))[:, 0].tolist() in ([0, 1, 1, 0, 0], [0, 0, 1, 1, 1], [1, 0, 0, 1, 1], [1, 1, 0, 0, 0], [0, 1, 0, 1, 1], [0, 1, 1, 0, 1], [1, 0, 1, 0, 0], [1, 0, 0, 1, 0])


def test_shards_over_many_buckets(make_docs, rng):
    docs = make_docs([words(rng, rng.randrange(1, 30)) for _ in range(300)] + ["same text"] * 40 + [None, None, ""])
    rows = sharding.shard_documents(docs, 8, bucket_groups=20, bundle_buckets=4).collect()
    sums = Counter()
    for r in rows:
        sums[r.shard] += r["size"]
    assert len({r.shard for r in rows if 300 <= r.doc_id < 340}) == 1 and len(rows) == 343
    assert max(sums.values()) - min(sums.values()) <= 24
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sharding_odd_rows(odd_docs):
    rows = sharding.shard_documents(odd_docs, 8).collect()
    assert len(rows) == odd_docs.count() and [r["size"] for r in rows if r.doc_id == 1] == [1]
    assert len({r.shard for r in rows if r.text_crc32 == next(x.text_crc32 for x in rows if x.doc_id == 5)}) == 1
    assert sharding.shard_documents(odd_docs.limit(0), 8).count() == 0


# --- quality


def test_isotonic_is_monotone_and_keeps_the_mean():
    y, n = np.array([0.0, 3, 1, 2, 5]), np.array([4.0, 4, 4, 4, 5])
    level = quality.isotonic(y, n)
    assert (np.diff(level) >= 0).all() and abs((level * n).sum() - y.sum()) < 1e-9
    assert level.tolist() == [0.0, 0.5, 0.5, 0.5, 1.0]


def test_quality_learns_and_handles_odd_rows(spark, make_docs, odd_docs, rng):
    docs = make_docs([words(rng, 60) if i % 3 else " ".join(x + "!!" for x in words(rng, 60).upper().split()) for i in range(240)])
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i in range(120)] + [(None, 1), (500, 0), (3, None), (4, 7)], "doc_id long, quality int")
    stats = quality.document_statistics(docs)
    model = quality.train(stats, labels, features=64)
    got = {r.doc_id: r.predicted for r in quality.score(stats, model).collect()}
    assert np.mean([got[i] == bool(i % 3) for i in range(120, 240)]) > 0.97
    assert quality.keep_good(docs, model).count() == sum(got.values())
    odd = quality.score(quality.document_statistics(odd_docs), model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    none = quality.train(stats, labels.limit(0))
    assert {r.score for r in quality.score(stats, none).collect()} == {0.5}
    assert quality.score(stats.limit(0), model).count() == 0
