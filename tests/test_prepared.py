"""Prepared membership files: a sound one has no problems, each planted fault is named, and a hot group is many lines."""

from helpers import rows_of
from pyspark.sql import functions as F

from rangeloom.sources import archive

TILES = [(0, 10), (10, 20), (20, 30)]
PATHS = 600


def _file(spark, folder, *, paths=range(PATHS), spare=0, drop=(), weight=0, unique=0, extra=(), more_lines=()):
    """Tile 0-10 has one walk that all paths share, some on both strands; the others a walk of one path each."""
    members = [(0, 10, [2, 4], p, 1 + p % 2, False) for p in range(PATHS)] + [(0, 10, [2, 4], p, 1, True) for p in range(0, PATHS, 3)]
    members += [(10, 20, [6], 5, 2, False), (20, 30, [8], 7, 1, False), *extra]
    members = spark.createDataFrame([m for m in members if m[:2] not in drop], "start long, end long, walk array<long>, path_id long, multiplicity long, reversed boolean")
    groups = members.groupBy("start", "end", "walk").agg((F.sum("multiplicity") + weight).alias("weight"), (F.count_distinct("path_id") + unique).alias("unique_paths"))
    catalog = spark.createDataFrame([(p, f"p{p}") for p in paths], "path_id long, canonical_name string")
    lines = archive.prepared_lines(catalog, groups, members, spare)
    for line in more_lines:
        lines = lines.unionByName(spark.createDataFrame([line], "type string, start long, end long, walk array<long>"), allowMissingColumns=True)
    path = f"{folder}/lines"
    archive.write_json(lines, path)
    return archive.read_prepared(spark, path)


def _problems(spark, lines):
    return rows_of(archive.prepared_problems(lines, spark.createDataFrame(TILES, "start long, end long")), ["start", "end", "problem", "n"])


def test_sound_file_and_lines_of_a_hot_group(spark, tmp_path):
    lines = _file(spark, tmp_path)
    assert _problems(spark, lines) == []
    hot = lines.where((F.col("type") == "group") & (F.col("start") == 0)).select(F.size("memberships").alias("n")).collect()
    assert len(hot) == -(-PATHS // archive.LINE_IDS) and max(r["n"] for r in hot) <= 2 * archive.LINE_IDS


def test_faults_are_named(spark, tmp_path):
    assert _problems(spark, _file(spark, tmp_path / "a", drop=[(10, 20)])) == [(10, 20, "tile is missing", 1)]
    assert _problems(spark, _file(spark, tmp_path / "b", extra=[(30, 40, [2], 1, 1, False)])) == [(30, 40, "tile is not in the graph", 1)]
    each = [(0, 10), (10, 20), (20, 30)]
    assert _problems(spark, _file(spark, tmp_path / "c", weight=1)) == [(*t, "weight differs", 1) for t in each]
    assert _problems(spark, _file(spark, tmp_path / "d", unique=-1)) == [(*t, "number of paths differs", 1) for t in each]


def test_faults_of_the_catalog(spark, tmp_path):
    # Without path 5 its two memberships of the hot group's tile and tile 10-20 point nowhere, and 6 does not follow.
    gap = _problems(spark, _file(spark, tmp_path / "a", paths=[p for p in range(PATHS) if p != 5]))
    assert gap == sorted([(0, 10, "path is not in the catalog", 1), (10, 20, "path is not in the catalog", 1), (None, None, "path id does not follow", 1)], key=repr)
    twice = _problems(spark, _file(spark, tmp_path / "b", paths=[*range(PATHS), 0]))
    assert twice == [(None, None, "path id does not follow", 1)]
    assert _problems(spark, _file(spark, tmp_path / "c", spare=-1)) == [(None, None, "paths are not as many as declared", 1)]
    odd = _problems(spark, _file(spark, tmp_path / "d", more_lines=[("tile", 0, 10, [2]), ("group", 20, 30, [])]))
    assert odd == sorted([(None, None, "unknown line", 1), (20, 30, "empty walk", 1)], key=repr)


def test_empty_file(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "part.json").write_text("")
    found = _problems(spark, archive.read_prepared(spark, str(tmp_path / "none")))
    assert found == sorted([(None, None, "paths are not as many as declared", 1), *[(*t, "tile is missing", 1) for t in TILES]], key=repr)
