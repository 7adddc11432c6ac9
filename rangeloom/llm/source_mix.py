"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

The plan is DataFrame operations only. Per document it moves four numbers, never the text:

1. size every document once and write (document, source, size, hash) to the scratch folder;
2. sum sizes by source and by slices of the hash, which is the only shuffle over all documents
   and combines on the map side;
3. fill the sources: in order of cap / weight a source is clamped when its cap lies at or below the
   water level that the rest would have, and the final level prices the sources left open;
4. a source that needs `whole` epochs and a remainder takes every document `whole` times, then walks
   its documents in hash order until the remainder is used up. The last document of that walk is
   repeated in part, so the words taken equal the rounded target. Whole hash slices below the
   boundary slice need no ordering; only the boundary slice, 1 / `slices` of a source, is sorted.

Cases: null text and texts without words have size 0 and are taken 0 times; a null source is a source
of its own, ordered last; documents without an id are ordered by the hash of their source and text, so
they spread over the slices as others do; repeated rows are documents of their own, and share their repetitions in any
order; columns named as the plan's own (size, part, row and the like) keep their values; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, seeded_hash, word_count

_HASH_BITS = 60


def _slice(mark: Column, slices: int) -> Column:
    return F.shiftright(mark, _HASH_BITS - (slices.bit_length() - 1))


def _mark(seed: int) -> Column:
    nameless = F.concat(F.lit("null:"), F.coalesce("source", F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return seeded_hash(seed, F.coalesce(F.col("doc_id").cast("string"), nameless)).alias("mark")


def size_documents(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _mark(seed))


def fill_sources(sized: DataFrame, weights: Sequence[int], max_epochs: int, slices: int) -> DataFrame:
    """A row for each source: its size, target, whole epochs, and where its partial epoch ends."""
    by_slice = sized.groupBy("source", _slice(F.col("mark"), slices).alias("part")).agg(F.sum("size").alias("words"))
    by_slice = materialize(by_slice, "mix-slices")
    by_source = by_slice.groupBy("source").agg(F.sum("words").alias("source_size"))

    # From here on the rows are sources, not documents.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sources = (
        by_source.withColumn("weight", F.element_at(cycle, (rank % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("clamped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_onward", F.sum("weight").over(onward))
        .withColumn("level_here", (F.col("budget") - F.col("clamped_before")).cast("double") / F.col("weight_onward"))
        .withColumn("clamped", F.col("cap").cast("double") / F.col("weight") <= F.col("level_here"))
        .withColumn("clamped_sum", F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("open_weight", F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(
                F.least(F.col("cap").cast("double"), ((F.col("budget") - F.col("clamped_sum")) * F.col("weight")).cast("double") / F.col("open_weight"))
            ),
        )
        .withColumn("words_due", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words_due div source_size")).otherwise(F.lit(0).cast("long")))
        .withColumn("extra", F.col("words_due") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "extra")
    )
    running = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = by_slice.withColumn("upto", F.sum("words").over(running)).withColumn("below", F.col("upto") - F.col("words")).alias("p")
    s = sources.alias("s")
    edge = (
        s.join(parts, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("below") <= F.col("extra")) & (F.col("extra") < F.col("upto")), "left")
        .select("s.*", F.col("p.part").alias("edge_part"), F.col("p.below").alias("edge_below"))
    )
    return materialize(edge, "mix-sources")


def mix_plan(
    docs: DataFrame,
    *,
    weights: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 0,
    slices: int = 1024,
    carry: bool = False,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words, repeats counted), whole, part.

    `part` is the words of the partial repetition. carry: adds the whole row of docs as a struct `row`.
    """
    sized = materialize(size_documents(docs, seed), "mix-sizes")
    sources = fill_sources(sized, weights, max_epochs, slices)
    rows = sized
    if carry:
        rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _mark(seed), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    d, s = rows.alias("d"), sources.alias("s")
    joined = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", *[F.col(f"s.{c}") for c in sources.columns if c != "source"])
    here = _slice(F.col("mark"), slices)
    on_edge = F.coalesce(here == F.col("edge_part"), F.lit(False))
    clear = joined.where(~on_edge).withColumn("part", F.when(here < F.col("edge_part"), F.col("size")).otherwise(F.lit(0).cast("long")))
    walk = Window.partitionBy("source").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        joined.where(on_edge)
        .withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("extra") - F.col("edge_below") - (F.sum("size").over(walk) - F.col("size")))))
    )
    out = clear.unionByName(edge).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "whole", "part", *["row"] * carry)


def mix_documents(docs: DataFrame, *, cut: bool = True, **options) -> DataFrame:
    """The mixed corpus: docs with a row for each repetition.

    A partial repetition holds the first `part` words of its text, joined by blanks. cut=False: it holds the whole
    text if half its words or more are due or no other copy of it is taken, and else is left out, so a source's words
    are within a document of its target and no text is shortened. Documents without
    words carry nothing to mix and are not repeated. `n_chars`, if there is one, follows the text.
    """
    plan = mix_plan(docs, carry=True, **options)
    copies = plan.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("whole"), F.lit(0).cast("long")) + 1)))
    last = F.col("copy") > F.col("whole")
    if not cut:
        due = (2 * F.col("part") >= F.col("size")) | ((F.col("whole") == 0) & (F.col("part") > 0))
        copies = copies.withColumn("part", F.when(due, F.col("size")).otherwise(F.lit(0).cast("long")))
    shortened = last & (F.col("part") < F.col("size"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD_PATTERN), F.lit(0)), 1, F.col("part").cast("int")), " ")
    copies = copies.where((F.col("size") > 0) & (~last | (F.col("part") > 0))).withColumn("head", F.when(shortened, head))
    new = {"text": F.coalesce("head", "row.text"), "n_chars": F.coalesce(F.length("head").cast("long"), "row.n_chars") if "n_chars" in docs.columns else None}
    return copies.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
