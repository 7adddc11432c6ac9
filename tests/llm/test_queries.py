"""The registered corpus queries on the smallest tables: SQL where there is some, else invariants and brute force."""

import zlib

import numpy as np
import pytest
from helpers import DATA, assert_matches

from rangeloom.llm import queries as Q
from rangeloom.llm.tokens import encoder


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert_matches(Q.queries()[name](spark, DATA), duck, Q.oracle_sql()[name])


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_op1_held_out_accuracy(spark, docs):
    rows = Q.op1_language_id(spark, DATA).collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([docs[r.doc_id].lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_op10_ranks_held_out_documents(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = Q.op10_quality(spark, DATA).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in held if labels[r.doc_id] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_op4_keeps_the_article_only(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = Q.op4_html_text(spark, DATA).collect()
    import html
    import re

    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        article = re.sub(r"</?(?:p|h1|br)>", " ", article)
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", "", article)).split())
        assert r.n_chars == len(r.text)


def test_op6_recall(spark):
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    found = {}
    for r in Q.op6_kmeans_tree(spark, DATA).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ids, x = np.array(list(table)), np.stack(list(table.values()))
    hits = []
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - table[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        assert sorted(found[q]) == list(range(1, 11))
        assert all(abs(score - np.sqrt(((table[v] - table[q]) ** 2).sum())) < 1e-9 for v, score in found[q].values())
        hits.append(len({int(ids[i]) for i in order} & {v for v, _ in found[q].values()}) / 10)
    assert np.mean(hits) >= 0.9


def test_op8_pieces_and_sequences(spark, docs):
    rows = Q.op8_best_fit(spark, DATA).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    encode = encoder("byte_bpe_50k.json")
    for doc_id, pieces in by_doc.items():
        ids = np.array([*encode(docs[doc_id].text or ""), 2], "<u4")
        at = 0
        for i, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert i == 0 or r.length == 1024
            at += r.length
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_sequence) <= np.ceil(sum(r.length for r in rows) / 1024) * 1.03 + 1


def test_fast_and_plain_tokenizers_agree(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    odd = ["", "  \n\t x", "<|endoftext|> a", "é ß  ü", "a" * 5000, "1234567 8,9"]
    for text in [*odd, *[d.text for d in list(docs.values())[:20]]]:
        assert encoder("byte_bpe_50k.json")(text or "") == plain.encode(text or "", add_special_tokens=False).ids


def test_op9_balance(spark, docs):
    rows = Q.op9_shards(spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(docs)
    sizes, slots, of_text = [0] * 8, [[] for _ in range(8)], {}
    for r in rows:
        text = (docs[r.doc_id].text or "").encode()
        assert r.size == len(text) + 1 and r.text_crc32 == zlib.crc32(text)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of_text.setdefault(text, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert all(len(s) == 1 for s in of_text.values())
    assert max(sizes) - min(sizes) <= 50


def test_pipeline_matches_its_stages(spark, docs):
    import corpus_pipeline

    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    now = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, DATA)
        kept.append((name, now))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for _, df in kept]
    assert ids[0] < set(docs) and ids[1] == ids[0] and ids[2] < ids[1] and ids[3] <= ids[2] and ids[4] == ids[3]
    packed = kept[4][1].collect()
    assert max(r.offset + r.length for r in packed) <= 1024


def test_rest_does_not_need_the_corpus_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "rangeloom", tmp_path / "rangeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries() and not any(k.startswith('op1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, check=True)
