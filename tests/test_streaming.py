from pyspark.sql import functions as F

from termweave.streaming.linking import link_mentions, read_stream, run_to_table


def test_stream_links_as_the_batch_does(spark, tmp_path):
    rows = [(1, "Heart", "A"), (2, "lung", "A"), (3, "none", "A"), (4, None, None)]
    spark.createDataFrame(rows, "id long, name string, type string").write.parquet(str(tmp_path / "in"))
    d = spark.createDataFrame([("heart", "A", "C1"), ("HEART", "A", "C0"), ("lung", "B", "C2")], "concept_name string, semantic_type string, CUI string")
    q = run_to_table(link_mentions(read_stream(spark, str(tmp_path / "in")), d), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = sorted((r["id"], r["CUI"]) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "CUI").collect())
    want = sorted((r["id"], r["CUI"]) for r in link_mentions(spark.read.parquet(str(tmp_path / "in")), d).select("id", F.col("CUI")).collect())
    assert got == want == [(1, "C0"), (2, None), (3, None), (4, None)]
