"""Lists told only by their links: ranked, named and cut in parallel by jumps of doubling length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialize


def _jump(open_rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows that have come as far as `at` go on as far as that one has."""
    on = state.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
    met = open_rows.join(on, "at")
    return met.select("id", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open"))


def _doubled(first: DataFrame, max_steps: int) -> DataFrame:
    """(id, at, steps) once every row has come to a row that is not open. first: id, at, steps, open.

    Each round doubles the distance that rows have come, so a list of n rows takes log2(n) rounds whatever the
    partitions. A row has at most one predecessor, so the jumps of a round meet different rows and no key is hot. Rows
    that have arrived are written once.
    """
    state, reach, done = materialize(first, "list-jumps"), 1, []
    while True:
        done.append(state.where(~F.col("open")))
        under_way = state.where("open")
        if not under_way.limit(1).count():
            break
        if reach > max_steps:
            example = under_way.select(F.col("id").cast("string").alias("id")).orderBy("id").head()["id"]
            raise ValueError(f"a cycle, or a list of over {max_steps} rows: {example} reaches no end")
        at = under_way
        for d in done:
            at = at.unionByName(d)
        state = materialize(_jump(under_way, at), "list-jumps")
        reach *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "at", "steps")


def run_to_stops(links: DataFrame, *, max_steps: int = 1 << 40) -> DataFrame:
    """How far each id is from the next stop on its list: id, at (the stop), steps. links: id, next, stop.

    id is of any type that joins; a row with `stop`, or without `next`, is its own stop. Rows still under way after
    `max_steps` are on a cycle: an error.
    """
    stopped = F.col("stop") | F.col("next").isNull()
    first = links.select("id", F.when(stopped, F.col("id")).otherwise(F.col("next")).alias("at"), F.when(stopped, 0).otherwise(1).cast("long").alias("steps"), (~stopped).alias("open"))
    return _doubled(first, max_steps)


def ranked_lists(links: DataFrame, anchors: DataFrame, *, max_steps: int = 1 << 40) -> DataFrame:
    """Every row by its list: id, end (the list's last id), rank (rows after it), name. links: id, next; anchors: id, name.

    Anchors are a sample of the rows, told which list they are of. All rows first run to the next anchor, a few steps
    away; then only the anchors are ranked, and hand on how far it is from them to the end. A list whose rows meet no
    anchor, or anchors of different names, or no end within max_steps, is an error. Nothing but the links says how rows
    follow one another.
    """
    named = materialize(anchors.groupBy("id").agg(F.min("name").alias("name"), F.max("name").alias("_other")), "list-anchors")
    held = links.join(named.select("id", F.lit(True).alias("stop")), "id", "left").select("id", "next", F.coalesce("stop", F.lit(False)).alias("stop"))
    near = materialize(run_to_stops(held, max_steps=max_steps), "list-near")
    # An anchor's next anchor: one step on, then as far as that row runs.
    after = links.select("id", "next").join(named, "id").select("id", "next")
    hops = after.join(near.select(F.col("id").alias("next"), F.col("at").alias("_stop"), (F.col("steps") + 1).alias("_hop")), "next", "left")
    hops = materialize(hops.select("id", F.col("_stop").alias("next"), F.coalesce("_hop", F.lit(0)).alias("hop")), "list-hops")
    ends = near.join(named.select(F.col("id").alias("at")), "at", "left_anti").select("at").distinct()  # ends that are no anchors
    weighed = hops.unionByName(ends.select(F.col("at").alias("id"), F.lit(None).cast(hops.schema["next"].dataType).alias("next"), F.lit(0).cast("long").alias("hop")))
    far = _weighed_ends(weighed, max_steps)
    names = near.join(named, near["at"] == named["id"], "left").select(near["id"].alias("id"), "at", "steps", "name", "_other")
    whole = names.join(far.select(F.col("id").alias("at"), "end", "distance"), "at").select("id", "end", (F.col("steps") + F.col("distance")).alias("rank"), "name", "_other")
    told = whole.groupBy("end").agg(F.min("name").alias("_name"), F.max("_other").alias("_last"))
    wrong = F.when(F.col("_name").isNull(), "no anchor names the list that ends in ").when(F.col("_name") != F.col("_last"), "anchors of several lists lead to ")
    checked = F.when(wrong.isNull(), F.col("_name")).otherwise(F.raise_error(F.concat(wrong, F.col("end").cast("string"))))
    return whole.select("id", "end", "rank").join(told.select("end", checked.alias("name")), "end").select("id", "end", "rank", "name")


def _weighed_ends(links: DataFrame, max_steps: int) -> DataFrame:
    """(id, end, distance) over links (id, next, hop)."""
    stopped = F.col("next").isNull()
    first = links.select("id", F.coalesce("next", "id").alias("at"), F.when(stopped, 0).otherwise(F.col("hop")).cast("long").alias("steps"), (~stopped).alias("open"))
    return _doubled(first, max_steps).select("id", F.col("at").alias("end"), F.col("steps").alias("distance"))


def reached_heads(heads: DataFrame, jumps: DataFrame) -> DataFrame:
    """All ids that jumps lead to from heads, themselves included. heads: id; jumps: id, next (null at the end).

    Each round takes in what the jumps lead to from all that is known and doubles the jumps, so rounds are the
    logarithm of the longest way. Jumps may meet (many ids can lead to one); what they lead to from heads is made distinct.
    """
    known = materialize(heads.select("id").distinct(), "chain-heads")
    count = known.count()
    jumps = materialize(jumps.where(F.col("next").isNotNull()).select("id", "next"), "chain-jumps")
    while True:
        found = known.join(jumps, "id").select(F.col("next").alias("id"))
        before, known = known, materialize(known.unionByName(found).distinct(), "chain-heads")
        discard(before)
        more = known.count()
        if more == count:
            return known
        count, before = more, jumps
        jumps = materialize(jumps.join(jumps.select(F.col("id").alias("next"), F.col("next").alias("_next")), "next").select("id", F.col("_next").alias("next")), "chain-jumps")
        discard(before)


def successor_records(visits: DataFrame, occurrences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records of a graph's visits: keys, handle, occurrence, next_handle, next_occurrence; of the walks' order nothing else stays.

    visits: keys, path_id, ord, handle, next_ord (null at the end of a walk); occurrences: keys, path_id, ord, handle, occurrence.
    """
    own = occurrences.select(*keys, "path_id", "ord", "handle", "occurrence")
    after = own.select(*keys, "path_id", F.col("ord").alias("next_ord"), F.col("handle").alias("next_handle"), F.col("occurrence").alias("next_occurrence"))
    held = own.join(visits.select(*keys, "path_id", "ord", "next_ord"), [*keys, "path_id", "ord"]).join(after, [*keys, "path_id", "next_ord"], "left")
    return held.select(*keys, "handle", "occurrence", "next_handle", "next_occurrence", "path_id")


def walks_from_records(records: DataFrame, anchors: DataFrame, keys: Sequence[str], *, max_steps: int = 1 << 40) -> DataFrame:
    """Walks rebuilt from successor records: keys, path_id, walk.

    records: keys, handle, occurrence, next_handle, next_occurrence (null at a walk's end); anchors: keys, handle,
    occurrence, path_id, a sample of the records. A record's place in its walk is its rank in the list of links.
    """
    def at(handle: str, occurrence: str) -> Column:
        return F.struct(*[F.col(k).alias(k) for k in keys], F.col(handle).alias("handle"), F.col(occurrence).alias("occurrence"))

    links = records.select(at("handle", "occurrence").alias("id"), F.when(F.col("next_handle").isNotNull(), at("next_handle", "next_occurrence")).alias("next"))
    ranked = ranked_lists(links, anchors.select(at("handle", "occurrence").alias("id"), F.col("path_id").alias("name")), max_steps=max_steps)
    packed = ranked.groupBy(*[F.col(f"id.{k}").alias(k) for k in keys], F.col("end"), F.col("name").alias("path_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("place"), F.col("id.handle").alias("handle")))).alias("s"))
    return packed.select(*keys, "path_id", F.transform("s", lambda s: s["handle"]).alias("walk"))
