"""Documents without an id in the mix: they spread over the slices of the hash, and clashing columns keep their values."""

import duckdb
from llm_helpers import words
from pyspark.sql import functions as F

from rangeloom.llm import queries, source_mix


def test_documents_without_an_id(spark, make_docs, rng, tmp_path):
    texts = [words(rng, rng.randrange(1, 40)) for _ in range(300)] + [None, ""]
    docs = make_docs(texts, sources={i: "abc"[i % 2] for i in range(200)} | {i: None for i in range(290, 302)})
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")))
    marks = source_mix.size_documents(docs, 0)
    assert marks.select("source", "mark").distinct().count() == docs.select("doc_id", "source", "text").distinct().count()
    plan = source_mix.mix_plan(docs, weights=(5, 2, 1), max_epochs=3)
    rows = plan.collect()
    assert len(rows) == len(texts)
    for source in {r.source for r in rows}:
        held = [r for r in rows if r.source == source]
        assert sum(r.taken for r in held) == int(held[0].target + 0.5)
        assert all(0 <= r.taken <= 3 * r["size"] for r in held)
    docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text, lang, source, n_chars FROM '{tmp_path}/documents.parquet'")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    told = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()['op2_source_mix']})").fetchall()
    assert sorted(told, key=repr) == sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_clashing_columns_keep_their_values(spark, make_docs, rng):
    docs = make_docs([words(rng, 10) for _ in range(12)])
    names = ["size", "mark", "row", "copy", "head", "part", "whole", "extra", "edge_part", "target"]
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id")))
    mixed = source_mix.mix_documents(docs, cut=False).collect()
    assert mixed and all(r[n] == f"{n}-{r.doc_id}" for r in mixed for n in names)
