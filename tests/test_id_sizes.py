"""Code sizes of a part's ids, without collecting them."""

from rangeloom.jobs import exchange_queries
from rangeloom.sources import payload


def test_sizes_collect_no_ids(spark, tmp_path):
    ids = [0, 1, 128, 300, 20_000, 3_000_000]
    rows = [(1, i) for i in ids + ids[:2]] + [(2, 127), (3, 128)]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    sizes = exchange_queries.id_codec_sizes(spark, str(tmp_path))
    assert {r.key: r.bytes for r in sizes.collect()} == {1: len(payload.encode_ids(ids)), 2: 1, 3: 2}
    plan = sizes._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "collect_set" not in plan
