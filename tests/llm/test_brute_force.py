"""Corpus operators and the pipeline against plain Python that does the same without tries, filters, indexes or heaps."""

import itertools
import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from helpers import DATA
from llm_helpers import brute_components, brute_lines, words

from rangeloom.llm import language_id, packing, quality, sharding, source_mix


def brute_language(learn, text):
    """learn: (lang, text) pairs. Word-first backoff over plain dictionaries."""
    find = lambda t: "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t.lower()).split()
    grams = lambda w, n: [w[i : i + n] for i in range(len(w) - n + 1)]
    counts = {k: defaultdict(Counter) for k in (0, 4, 3, 2, 1)}
    for lang, t in learn:
        for w in find(t):
            counts[0][w][lang] += 1
            for n in (4, 3, 2, 1):
                for g in grams(f"<{w}>", n):
                    counts[n][g][lang] += 1
    langs = sorted({lang for lang, _ in learn})
    total = {k: {lang: sum(c[lang] for c in held.values()) + 0.5 * len(held) for lang in langs} for k, held in counts.items()}
    logs = lambda k, x: [math.log((counts[k][x][lang] + 0.5) / total[k][lang]) for lang in langs]
    rows = []
    for w in find(text):
        row = logs(0, w) if w in counts[0] else None
        for n in (4, 3, 2, 1):
            held = [logs(n, g) for g in grams(f"<{w}>", n) if g in counts[n]] if row is None else []
            if held:
                row = [sum(c) / len(held) for c in zip(*held)]
        rows.append(row or [0.0] * len(langs))
    if not rows:
        return "und", 0.0
    mean = [sum(c) / len(rows) for c in zip(*rows)]
    odds = [math.exp((m - max(mean)) * min(len(rows), 20)) for m in mean]
    return langs[mean.index(max(mean))], max(odds) / sum(odds)


def test_language_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    learn = [(r.lang, r.text) for r in rows[:60] if r.lang and r.text and r.doc_id is not None]
    model = language_id.train(docs.where(docs.doc_id.isin([r.doc_id for r in rows[:60] if r.doc_id is not None])))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    for r in [r for r in rows if len(r.text or "") < 3000][:80]:
        lang, score = brute_language(learn, r.text or "")
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-4


def fewest(lengths, size):
    """The least number of sequences, by trying everything."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {rooms.index(r) for r in set(rooms) if r >= lengths[i]}:
            place(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best


def test_packing_against_every_packing():
    rng = np.random.default_rng(12)
    worse = 0
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 70, rng.integers(1, 9)))[::-1]
        at, _ = packing.best_fit(lengths, 100, 100, 10_000, packing.WEIGHTS, "norm")
        least = fewest(lengths.tolist(), 100)
        assert least <= len(set(at.tolist())) <= least + 1
        worse += len(set(at.tolist())) > least
    assert worse <= 3


def test_equal_rows_are_dealt_to_many_groups(spark, make_docs):
    docs = make_docs(["same text"] * 300).selectExpr("1L AS doc_id", "text", "lang", "source", "n_chars", "'x' AS row", "7 AS group")
    rows = packing.pack_documents(docs, group_pieces=50).collect()
    assert len(rows) == 300 and len({r.sequence_id >> 32 for r in rows}) >= 5
    assert rows[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_differencing_against_every_partition():
    rng = np.random.default_rng(6)
    gaps = []
    for _ in range(25):
        sizes = rng.integers(1, 100, 8)
        parts = np.zeros((8, 3), np.int64)
        parts[:, 0] = sizes
        sums = np.bincount(sharding.difference(parts)[:, 0], weights=sizes, minlength=3)
        best = min(max(s) - min(s) for c in itertools.product(range(3), repeat=7) for s in [np.bincount([0, *c], weights=sizes, minlength=3)])
        gaps.append((sums.max() - sums.min()) - best)
    assert min(gaps) == 0 and np.mean(gaps) < 12


def test_giants_in_many_chests(make_docs, rng):
    docs = make_docs([words(rng, rng.choice([2, 3, 4, 400, 500])) for _ in range(240)])
    rows = sharding.shard_documents(docs, 4, bucket_groups=12, bundle_buckets=3).collect()
    sums = Counter()
    for r in rows:
        sums[r.shard] += r["size"]
    assert len(rows) == 240 and max(sums.values()) - min(sums.values()) <= 0.01 * sum(sums.values())


def test_pipeline_against_brute_force(spark):
    """run() as a whole: lines, near copies and pieces by plain Python on what the classifier keeps."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.train(quality.document_statistics(docs), spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = sorted(quality.keep_good(docs, model).collect(), key=lambda r: r.doc_id)
    texts = brute_lines([r.text for r in kept], 10)
    _, classes = brute_components(texts)
    one = [(r.doc_id, t, r.lang, r.source, len(t)) for i, (r, t) in enumerate(zip(kept, texts)) if classes[i] == i]
    mixed = source_mix.mix_documents(spark.createDataFrame(one, docs.schema), cut=False, weights=(5, 2, 1), max_epochs=3).collect()
    plain, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in mixed:
        ids = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            expected[r.doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    ends = defaultdict(list)
    for r in rows:
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    for held in ends.values():
        held.sort()
        assert held[0][0] == 0 and held[-1][1] <= 1024 and all(a[1] == b[0] for a, b in itertools.pairwise(held))
    assert len(ends) <= math.ceil(sum(r.length for r in rows) / 1024) * 1.05 + 1
