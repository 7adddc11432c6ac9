"""Source divergence audit: how far the term frequencies of a language's sources lie apart, by pair-task sparse merge.

A group is a (lang, source). A language keeps the terms that at least `min_docs` of its documents hold, V of them,
numbered in order of their UTF-8 bytes. A group's counts are stored as arrays sorted by term number, a row for each
block of `block_terms` numbers, absent terms left out. With N the counts of a group in all, a kept term's share is

    p = 1 + floor(10^9 (count + 2) / (N + 2 V))

and two shares lie f(p, q) = floor((p - q)^2 / (p + q)) apart. Every unordered pair of a language's groups is a task a
block: the arrays of both groups meet in one place, the shorter array gallops through the longer, and terms of both, of
the one and of the other are priced. Terms of neither have one price, taken as often as there are such terms, which
the counts of what was met give. f does not care for the order, so a task serves both directions.

A pair's result is a sum over its blocks, so no task holds more than a block of two groups, whatever the vocabulary.
An array goes to as many tasks as its language has other groups, which the contract's rows, one a pair, call for too.
Terms are counted in the tasks that read the text, which flush a bounded table of counts; a hot group or term arrives
as one count a flush. All arithmetic is in whole numbers, shares by long division.

Cases: null text, lang and source are ''; a group without terms or in a language without kept terms has rows in `pair`
(value 0 if V = 0) and none in `term`; a language of one group has none in `pair`; repeated rows count as documents of
their own; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered

SCALE = 1_000_000_000
BLOCK_TERMS = 1 << 14
FLUSH_TERMS = 200_000
#: Bytes of a term stay, A-Z become lower case, all others separate.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"
GALLOP_RUN = 32


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and bytes beyond ASCII, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split()


def _flushed(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), own in counts.items():
        held = docs[lang, source]
        terms = list(own)
        n = len(terms)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([held[t] for t in terms], pa.int64())],
            ["lang", "source", "term", "n", "docs"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each term; the term '' stands for the group itself."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            group = (lang or "", source or "")
            own, held = counts[group], docs[group]
            words = terms_of(text or b"")
            own[b""] += 0
            own.update(words)
            held.update(set(words))
        if sum(map(len, counts.values())) > FLUSH_TERMS:
            yield from _flushed(counts, docs)
            counts.clear()
            docs.clear()
    yield from _flushed(counts, docs)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); each group also has the term ''."""
    found = docs.select("text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).mapInArrow(_count, COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), by long division in steps of a thousand, so nothing overflows."""
    below = np.int64(total + 2 * kept)
    out, rest = np.divmod(np.asarray(counts, np.int64) + 2, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so squares fit."""
    return (p - q) ** 2 // (p + q)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where each value of `short` stands in `long`, or would; both rise strictly.

    The first value of every run of `GALLOP_RUN` is met by doubling steps from where the last one was, and the rest of
    the run by bisection within the stretch that lies between two such places.
    """
    heads = short[::GALLOP_RUN].tolist()
    edges, at, n = [], 0, len(long)
    for value in heads:
        step, low = 1, at
        while low + step < n and long[low + step] < value:
            low += step
            step *= 2
        at = low + int(np.searchsorted(long[low : min(n, low + step) + 1], value))
        edges.append(at)
    edges.append(n)
    out = np.empty(len(short), np.int64)
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        run = short[i * GALLOP_RUN : (i + 1) * GALLOP_RUN]
        out[i * GALLOP_RUN : i * GALLOP_RUN + len(run)] = low + np.searchsorted(long[low:high], run)
    return out


def price(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], total_a: int, total_b: int, kept: int) -> tuple[int, int]:
    """What the terms of either group differ in all, and how many they are. a, b: rising term numbers and their counts."""
    if len(a[0]) > len(b[0]):
        a, b, total_a, total_b = b, a, total_b, total_a
    (ids, counts), (other_ids, other_counts) = a, b
    p, q = shares(counts, total_a, kept), shares(other_counts, total_b, kept)
    none_p, none_q = shares(np.zeros(1), total_a, kept), shares(np.zeros(1), total_b, kept)
    if not len(other_ids):
        return 0, 0
    at = gallop(ids, other_ids)
    met = at < len(other_ids)
    met[met] = other_ids[at[met]] == ids[met]
    partner = at[met]
    alone = np.ones(len(other_ids), bool)
    alone[partner] = False
    value = apart(p[met], q[partner]).sum() + apart(p[~met], none_q).sum() + apart(none_p, q[alone]).sum()
    return int(value), len(ids) + int(alone.sum())


def _price_task(key: tuple, rows: pa.Table) -> pa.Table:
    lang, a, b, block = (k.as_py() for k in key)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    arrays = [[x.values.to_numpy() for x in rows.column(c)] for c in ("ids", "counts")]  # a scalar's values are a slice, not a copy
    held = dict(zip(rows.column("source").to_pylist(), zip(*arrays, strict=True), strict=True))
    first = {n: rows.column(n)[0].as_py() for n in ("total_a", "total_b", "kept")}
    value, met = price(held.get(a, empty), held.get(b, empty), first["total_a"], first["total_b"], first["kept"])
    return pa.table({"lang": [lang], "a": [a], "b": [b], "value": pa.array([value], pa.int64()), "met": pa.array([met], pa.int64())})


class Counts:
    """kept: lang, term, place, n (in the language), kept; groups: lang, source, total, kept; arrays: lang, source, block, ids, counts."""

    def __init__(self, docs: DataFrame, *, min_docs: int, block_terms: int):
        counts = materialize(term_counts(docs), "divergence-counts")
        words = counts.where(F.col("term") != "").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        self.kept = materialize(numbered(words.drop("docs"), ["lang"], ["term"], "divergence-terms").withColumnRenamed("total", "kept"), "divergence-terms")
        self.held = materialize(counts.select("lang", "source", "term", "n").join(self.kept.select("lang", "term", "place"), ["lang", "term"]), "divergence-held")
        totals = self.held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        of_lang = self.kept.groupBy("lang").agg(F.max("kept").alias("kept"), F.sum("n").alias("lang_total"))
        groups = counts.where(F.col("term") == "").select("lang", "source").join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
        zero = F.lit(0).cast("long")
        self.groups = materialize(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")]), "divergence-groups")
        block = F.floor(F.col("place") / block_terms).alias("block")
        entries = F.array_sort(F.collect_list(F.struct(F.col("place").alias("id"), F.col("n").alias("count"))))
        arrays = self.held.groupBy("lang", "source", block).agg(entries.alias("e"))
        self.arrays = materialize(arrays.select("lang", "source", "block", F.col("e.id").alias("ids"), F.col("e.count").alias("counts")), "divergence-arrays")


def pair_values(held: Counts) -> DataFrame:
    """lang, a, b, value for each two sources of a language, a before b."""
    g = held.groups
    pairs = g.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "kept").join(g.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b")), "lang").where(F.col("a") < F.col("b"))
    pairs = materialize(pairs, "divergence-pairs")
    sides = pairs.withColumn("source", F.explode(F.array("a", "b")))
    tasks = held.arrays.join(sides, ["lang", "source"])
    priced = tasks.groupBy("lang", "a", "b", "block").applyInArrow(_price_task, "lang string, a string, b string, value long, met long")
    priced = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    zero = F.lit(0).cast("long")
    no = share(zero, F.col("total_a"), F.col("kept")), share(zero, F.col("total_b"), F.col("kept"))
    whole = pairs.join(priced, ["lang", "a", "b"], "left")
    absent = F.when(F.col("kept") == 0, zero).otherwise((F.col("kept") - F.coalesce("met", zero)) * distance(*no))
    return whole.select("lang", "a", "b", (F.coalesce("value", zero) + absent).alias("value"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """`shares` as a column expression."""
    below = F.greatest(total + 2 * kept, F.lit(1))
    over = count + 2
    out, rest = F.call_function("div", over, below), over % below
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, below), (rest * 1000) % below
    return out + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def best_terms(held: Counts, most: int) -> DataFrame:
    """lang, source, item, value, rank: a group's terms that it holds more often than its language, the `most` farthest.

    Each slice of term numbers gives its best, so a hot group is ranked in as many tasks as it has slices.
    """
    terms = held.held.join(held.kept.select("lang", "term", F.col("n").alias("lang_n")), ["lang", "term"]).join(held.groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    priced = terms.where(F.col("n") > 0).select("lang", "source", "term", "place", p.alias("p"), q.alias("q")).where(F.col("p") > F.col("q"))
    priced = priced.select("lang", "source", "term", "place", F.floor(F.col("place") / 4096).alias("slice"), distance(F.col("p"), F.col("q")).alias("value"))
    order = (F.col("value").desc(), F.col("place"))
    near = priced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "slice").orderBy(*order))).where(F.col("rank") <= most)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= most).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def audit(docs: DataFrame, *, min_docs: int = 10, most_terms: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    held = Counts(docs, min_docs=min_docs, block_terms=block_terms)
    pairs = materialize(pair_values(held), "divergence-values")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(columns).unionByName(best_terms(held, most_terms).withColumn("part", F.lit("term")).select(columns))
