from sectorlake.plans import load_reference_queries


def test_frames_behind_the_index_are_checked(spark, tmp_path):
    docs = spark.range(4300).selectExpr("id as doc_id", "'some text' as text", "'src1' as source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = load_reference_queries()[0]["rule_violations"](spark, str(tmp_path)).collect()
    assert sorted(r["frame"] for r in found if r["rule"] == "V11") == list(range(3, 4300, 17))
    assert {r["rule"] for r in found if r["frame"] is None} >= {"V2", "V3"}
