from lodestem.plans.queries import levenshtein_pairs


def test_pairs_of_length_difference_three(spark, tmp_path):
    spark.createDataFrame([(1, "ade readers glaciar")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in levenshtein_pairs(spark, str(tmp_path)).collect()}
    assert {("reader", "ade", 3), ("reader", "readers", 1), ("glaciar", "glaciar", 0)} <= got
