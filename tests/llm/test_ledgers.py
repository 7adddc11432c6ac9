"""Token files, divergence audit and Merkle manifest against plain Python, and their odd cases."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rangeloom.llm import divergence, merkle, simple8b
from rangeloom.llm import queries as Q
from rangeloom.llm.token_files import TokenFiles
from rangeloom.llm.tokens import WordEncoder, words_apart

VOCABULARY = "word_bpe_49k.json"


@lru_cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def plain_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


# Simple-8b


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 7), st.integers(0, 70_000), st.integers(0, (1 << 64) - 1)), max_size=400), st.sampled_from([7, 64, 1024]))
def test_simple8b_round_trip(values, block):
    values = np.array(values, np.uint64)
    stream = simple8b.encode(values, block)
    assert (simple8b.decode(stream) == values).all()
    for first in range(len(stream.offsets)):
        assert (simple8b.decode(stream, first, first + 1) == values[first * block : (first + 1) * block]).all()


def test_simple8b_packs_and_escapes():
    rng = np.random.default_rng(3)
    zeros = simple8b.encode(np.zeros(10_000, np.uint64), 10_000)
    assert len(zeros.words) == 42 and not len(zeros.escaped)  # 240 a word
    small = rng.integers(0, 8, 60_000).astype(np.uint64)
    assert len(simple8b.encode(small).words) <= 60_000 / 20 + 120
    small[[77, 40_000]] = (1 << 63, 1 << 40)
    stream = simple8b.encode(small)
    assert stream.escape_at.tolist() == [77, 40_000] and (simple8b.decode(stream) == small).all()
    assert not len(simple8b.encode(np.zeros(0, np.uint64)).words)


# Token files


def test_words_give_the_ids_of_whole_texts(rng):
    odd = ["", " ", "a b", "Straße ΑΣ  ΟΔΟΣ.", "é ́x", "it's 'RE  42.5", "<|endoftext|>x <|STARTOFTEXT|> <|startoftext|>.", "x y​", "ﬁ İ İ.", "1" * 400, "\x0b\x0c\r\n\ta", "A.'s b!'RE c?!d ≠.", "Ünï,c;ode:×.÷"]
    odd += ["".join(rng.choice("aB. ,'sé!́\t<|>x9") for _ in range(30)) for _ in range(200)]
    assert words_apart(VOCABULARY) and not words_apart("byte_bpe_50k.json")
    for encoder in (WordEncoder(VOCABULARY, most_words=5), WordEncoder(VOCABULARY, most_letters=3)):
        for _ in range(2):
            flat, sizes = encoder.encode(pa.array([*odd, None]))
            at = np.cumsum(sizes)
            assert [flat[e - n : e].tolist() for e, n in zip(at, sizes, strict=True)] == [*[plain_ids(t)[:-1] for t in odd], []]
        assert len(encoder.known) <= 2000
    flat, sizes = WordEncoder("byte_bpe_50k.json").encode(pa.array(["a b", None]))
    assert sizes.tolist() == [2, 0] and len(flat) == 2


def check_files(rows, texts):
    at = 0
    for doc_id, text in sorted(texts.items()):
        ids = np.array(plain_ids(text), "<u4")
        assert tuple(rows[doc_id]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op11_against_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = Q.op11_token_files(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    check_files({r.doc_id: r for r in rows}, texts)


def test_token_files_read_back(spark, make_docs, rng):
    texts = [words(rng, rng.randrange(0, 90)) for _ in range(150)] + [words(rng, 30_000), None, "", " \n"]
    rng.shuffle(texts)
    files = TokenFiles.write(make_docs(texts).repartition(5), vocabulary=VOCABULARY, end_id=1, segment_ids=500)
    assert files.segments().count() > 10
    check_files({r.doc_id: r for r in files.documents().collect()}, dict(enumerate(texts)))
    assert {r.doc_id: r.ids for r in files.ids().collect()} == {i: plain_ids(t) for i, t in enumerate(texts)}


def test_token_files_odd_rows(spark, odd_docs):
    rows = TokenFiles.write(odd_docs, vocabulary=VOCABULARY, end_id=1).documents().orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]]).tolist()[:-1]
    assert TokenFiles.write(odd_docs.limit(0), vocabulary=VOCABULARY, end_id=1).documents().collect() == []


# Divergence audit


def brute_audit(docs, least, most):
    def terms(text):
        return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    rows = []
    docs = [(d.text, d.lang or "", d.source or "") for d in docs]
    for lang in {x[1] for x in docs}:
        own = [(terms(t), s) for t, g, s in docs if g == lang]
        held = Counter(t for ts, _ in own for t in set(ts))
        kept = {t for t, n in held.items() if n >= least}
        counts = {s: Counter() for _, s in own}
        for ts, s in own:
            counts[s].update(t for t in ts if t in kept)
        every = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + int(Fraction(10**9 * (c[t] + 2), sum(c.values()) + 2 * len(kept)))

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in counts.items():
            pairs = [(o, sum(gap(share(c, t), share(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            above = [(t, gap(share(c, t), share(every, t))) for t in kept if c[t] and share(c, t) > share(every, t)]
            for part, found, cut in (("pair", pairs, len(pairs)), ("term", above, most)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                rows += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:cut])]
    return sorted(rows)


def audited(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).collect())


@pytest.mark.parametrize("block", [3, 1 << 14])
def test_divergence_against_plain_python(spark, make_docs, rng, block):
    texts = [words(rng, rng.randrange(0, 60)) + rng.choice(["", " Éa-b É", " ñandú's x1y"]) for _ in range(90)]
    docs = make_docs(texts, sources={i: rng.choice(["a", "b", "é", None, "d"]) for i in range(90)}, langs={i: rng.choice(["en", "en", "fr", None]) for i in range(90)})
    assert audited(docs, min_docs=6, most_terms=4, block_terms=block) == brute_audit(docs.collect(), 6, 4)


def test_divergence_odd_rows(spark, odd_docs):
    for least in (1, 2, 50):
        assert audited(odd_docs, min_docs=least) == brute_audit(odd_docs.collect(), least, 10)
    assert audited(odd_docs.limit(0)) == []


def test_counts_are_flushed_in_parts(spark, make_docs, rng, monkeypatch):
    texts = [words(rng, 40) for _ in range(50)]
    docs = make_docs(texts).coalesce(1)
    whole = sorted(map(tuple, divergence.term_counts(docs).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, divergence.term_counts(docs).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import pyarrow as pa

    monkeypatch.setattr(divergence, "FLUSH_TERMS", 20)
    batch = pa.record_batch({"text": texts, "lang": ["en"] * 50, "source": ["s"] * 50})
    parts = list(divergence._count(iter([batch.slice(i, 5) for i in range(0, 50, 5)])))
    assert len(parts) > 5
    total = Counter()
    for p in parts:
        total.update(dict(zip(p["term"].to_pylist(), p["n"].to_pylist(), strict=True)))
    assert {t: n for _, _, t, n, _ in whole} == dict(total)


@given(st.sets(st.integers(0, 3000), max_size=300), st.sets(st.integers(0, 3000), max_size=900))
@settings(max_examples=60, deadline=None)
def test_gallop_finds_what_bisection_finds(a, b):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    assert (divergence.gallop(a, b) == np.searchsorted(b, a)).all()


def test_shares_do_not_overflow():
    for count, total, kept in ((0, 0, 1), (10**13, 10**14, 10**9), (10**13, 10**13, 3), (7, 7, 1)):
        assert divergence.shares(np.array([count]), total, kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)


# Merkle manifest


def sha(*hexes):
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def naive_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def naive_order(n):
    """(level, index) in the order in which nodes are complete."""
    out = []

    def visit(level, index):
        if level and 2 * index << level - 1 < n:
            visit(level - 1, 2 * index)
        if level and (2 * index + 1) << level - 1 < n:
            visit(level - 1, 2 * index + 1)
        out.append((level, index))

    visit(merkle.height(n), 0)
    return out


@pytest.mark.parametrize("n", [*range(1, 36), 64, 100, 257])
def test_positions_follow_completion(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = naive_levels(leaves)
    order = naive_order(n)
    log = merkle.append_log([x.encode() for x in leaves], merkle.height(n))
    assert [levels[level][index] for level, index in order] == [x.decode() for x in log]
    assert [int(merkle.position(level, index, n)) for level, index in order] == list(range(len(order)))
    at = merkle.siblings(n, merkle.height(n))
    for i, (shape, column) in enumerate(zip(merkle._sides(n, at), at.T.tolist() if len(at) else [[]], strict=True)):
        assert merkle.fold(leaves[i].encode(), shape, [log[p] for p in column if p >= 0]) == log[-1]


def leaf_text(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def naive_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) in any order."""
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id, sha(leaf_text(r.doc_id, r.source, r.lang, r.n_chars, r.text))))
    trees = {}
    for lang, held in groups.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = naive_levels([leaf for _, leaf in held])
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = naive_levels([trees[x][-1][0] for x in order])

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            out += level[i ^ 1 : (i ^ 1) + 1]
            i //= 2
        return out

    return [(doc_id, leaf, trees[x][-1][0], top[-1][0], sha(*path(trees[x], i), *path(top, order.index(x)))) for x in order for i, (doc_id, leaf) in enumerate(groups[x])]


def manifest_of(docs, bits):
    docs = docs.select("doc_id", "source", "lang", "n_chars", "text")
    leaf = merkle.row_digest(*[F.col(c) for c in docs.columns])
    return merkle.build(docs, leaf, leaf, bits=bits)


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_manifest_against_plain_levels(spark, make_docs, rng, bits):
    texts = [rng.choice([None, "", "é", words(rng, 4)]) for _ in range(75)]
    langs = {i: rng.choice(["en", "en", "fr", None, "é", ""]) for i in range(74)} | {74: "alone"}
    docs = make_docs(texts, langs=langs)
    found = manifest_of(docs, bits)
    rows = found.proofs().collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in rows) == sorted(naive_manifest(docs.collect()))
    assert all(r.verified and r.folded_root == r.root for r in rows)
    for key, n in Counter(merkle_key(x) for x in langs.values()).items():
        held = found.groups.entries().where(F.col("key") == key).orderBy("position").collect()
        assert [(r.level, r["index"]) for r in held] == naive_order(n) and [r.position for r in held] == list(range(len(held)))


def merkle_key(lang):
    return "" if lang is None else f"={lang}"


def test_manifest_finds_what_was_changed(spark, make_docs):
    docs = make_docs([f"t{i}" for i in range(30)]).select("doc_id", "source", "lang", "n_chars", "text")
    leaf = merkle.row_digest(*[F.col(c) for c in docs.columns])
    other = merkle.row_digest(*[F.when(F.col("doc_id") == 7, F.lit("forged")).otherwise(F.col(c)) if c == "text" else F.col(c) for c in docs.columns])
    rows = merkle.build(docs, leaf, other, bits=2).proofs().collect()
    assert [r.doc_id for r in rows if not r.verified] == [7]


def test_manifest_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumn("n_chars", F.lit(None).cast("long"))
    rows = manifest_of(docs, 1).proofs().collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root) for r in rows) == sorted((str(a), *rest[:-1]) for a, *rest in naive_manifest(docs.collect()))
    assert all(r.verified for r in rows)
    empty = manifest_of(docs.limit(0), 8)
    assert empty.root is None and empty.proofs().collect() == []
