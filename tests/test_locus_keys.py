"""Locus keys of whole texts."""

from rangeloom.jobs import catalogue


def test_keys_of_whole_texts(spark, tmp_path):
    texts = ["\f A" + "b É" * 3000 + "Z \r\n", "AB", " \t", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.key for r in catalogue.queries()["locus_keys"](spark, str(tmp_path)).collect()}
    assert got == {0: "a" + "b É" * 3000 + "z", 1: "ab", 2: "", 3: "", 4: None}
