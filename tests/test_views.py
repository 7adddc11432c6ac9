"""Bounded view state: the same snapshot in whatever order tiles come, and never more than the budget held."""

import random
import uuid
from collections import Counter

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from rangeloom.streaming import views

BUDGETS = {"node": 7, "edge": 9, "lane": 3}
SCHEMA = "view string, kind string, item string, priority long, weight long"


def _rows(rng):
    """Four views, one of which has most rows; nodes and edges recur, so what they sum must be whole."""
    out = []
    for _ in range(3_000):
        view = rng.choice(["hot"] * 6 + ["a", "b", "c"])
        a, b = rng.randrange(25), rng.randrange(25)
        out.append((view, "node", str(a), a, 1))
        out.append((view, "edge", f"{a}>{b}", max(a, b), rng.choice([None, 1, 2])))
        out.append((view, "lane", f"w{rng.randrange(400)}", -rng.randrange(20), 5))
        out.append((view, "other", "x", 1, 1))
    return out + [(None, "node", "1", 1, 1), ("a", None, "1", 1, 1), ("a", "node", None, 1, 1), ("a", "node", "1", None, 1)]


def _brute(rows):
    seen, weight, decoded = Counter(), Counter(), Counter()
    for view, kind, item, priority, w in rows:
        if None not in (view, kind, item, priority):
            seen[view, kind, priority, item] += 1
            weight[view, kind, priority, item] += w or 0
            decoded[view, kind] += 1
    out = []
    for view in {k[0] for k in seen}:
        nodes = {i for _, i in sorted((p, i) for v, k, p, i in seen if (v, k) == (view, "node"))[: BUDGETS["node"]]}
        for kind, places in BUDGETS.items():
            items = sorted((p, i) for v, k, p, i in seen if (v, k) == (view, kind))
            if kind == "edge":
                items = [(p, i) for p, i in items if set(i.split(">")) <= nodes]
            items = items[:places]
            total = decoded[view, kind]
            out += [(view, kind, n + 1, i, seen[view, kind, p, i], weight[view, kind, p, i], total, total - len(items)) for n, (p, i) in enumerate(items)]
    return sorted(out, key=repr)


def _held(spark, rows, folder, files, shards):
    path, name = f"{folder}/{uuid.uuid4().hex}", uuid.uuid4().hex
    for n in range(files):
        spark.createDataFrame(rows[n::files], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return views.run_views(stream, BUDGETS, str(folder), name, shards=shards), f"{folder}/{name}"


COLUMNS = ["view", "kind", "place", "item", "seen", "weight", "decoded", "omitted"]


def _snapshot(held):
    return rows_of(views.snapshot(held, BUDGETS, {"edge": ("node", F.split("item", ">"))}), COLUMNS)


@pytest.mark.parametrize(("seed", "files", "shards"), [(1, 1, 1), (2, 4, 3)])
def test_snapshot_is_the_same_in_any_order(spark, tmp_path, seed, files, shards):
    rows = _rows(random.Random(0))
    random.Random(seed).shuffle(rows)
    held, out = _held(spark, rows, tmp_path, files, shards)
    assert _snapshot(held) == _brute(rows)
    # Every version of the state that a micro-batch left, not only the last.
    versions = spark.read.parquet(out)
    assert versions.select("batch").distinct().count() == files
    most = {r["kind"]: r["most"] for r in versions.groupBy("kind").agg(F.max(F.size("items")).alias("most")).collect()}
    assert most["other"] == 0 and all(most[k] <= n for k, n in BUDGETS.items()) and most["lane"] == BUDGETS["lane"]


def test_stored_state_keeps_to_the_budget(spark, tmp_path):
    """What Spark's state store itself holds after the last batch."""
    rows = _rows(random.Random(5))
    _, out = _held(spark, rows, tmp_path, 2, 2)
    stored = spark.read.format("statestore").load(f"{out}-log").select("key.kind", "value.*")
    state = stored.select("kind", "groupState.*") if "groupState" in stored.columns else stored
    sizes = state.select("kind", F.size("items").alias("n")).collect()
    assert sizes and all(r["n"] <= BUDGETS.get(r["kind"], 0) for r in sizes)


def test_no_rows_give_no_snapshot(spark, tmp_path):
    held, _ = _held(spark, [(None, "node", "1", 1, 1)], tmp_path, 1, 2)
    assert _snapshot(held) == []
