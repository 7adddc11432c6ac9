"""Recall over several levels, whole answers below split leaves, and a language sample bounded in bytes."""

import numpy as np
from pyspark.sql import functions as F

from rangeloom.llm import ann, language_id


def test_levels_multiply_to_the_recall_and_every_query_has_its_rows(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1200, 6)), rng.normal(size=(600, 6)) * 0.01 + 3])  # a third of all rows in one spot
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(table, F.col("vec_id") % 40 == 0, k=10, sample_rows=200, leaf_rows=4, split_rows=40, max_levels=4, chunk_rows=50, batch_queries=8).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    hits = []
    for q in range(0, len(x), 40):
        far = ((x - x[q]) ** 2).sum(axis=1)
        near = [i for i in np.argsort(far, kind="stable") if i != q][:10]
        assert sorted(found[q]) == list(range(1, 11))
        hits.append(len(set(near) & set(found[q].values())) / 10)
    assert np.mean(hits) >= 0.9


def test_planned_levels():
    plan = {"sample_rows": 10_000, "leaf_rows": 64, "split_rows": 8_192, "most": 4}
    assert [ann.planned_levels(n, **plan) for n in (0, 300_000, 10**7, 10**9, 10**15)] == [1, 1, 2, 3, 4]


def test_language_sample_is_bounded_in_bytes(spark, make_docs, rng):
    """Sixty languages of long texts: what is learned stays near the bound, and still tells them apart."""
    letters = {k: rng.sample("abcdefghijklmnopqrstuvwxyz", 6) for k in range(60)}
    texts = [" ".join("".join(rng.choice(letters[i % 60]) for _ in range(7)) for _ in range(400)) for i in range(600)]
    docs = make_docs(texts, langs={i: f"l{i % 60:02}" for i in range(600)})
    whole = sum(map(len, texts))
    small, full = (language_id.train(docs, sample_bytes=n) for n in (whole // 4, 10 * whole))
    sizes = [sum(len(k.gains) for k in m.kinds.values()) for m in (small, full)]
    assert sizes[0] < 0.7 * sizes[1]
    got = language_id.predict(docs.select("doc_id", "text", "lang"), small).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.85
