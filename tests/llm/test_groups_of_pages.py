from lodestem.llm.queries import p6_groups
from tests.llm.test_pages import PAGE


def test_pages_are_grouped_by_their_whole_article(spark, tmp_path):
    begin = " ".join(f"start{i}, of." for i in range(400))
    ends = ["", " ".join(f"left{i}, of." for i in range(900)), " ".join(f"right{i}, of." for i in range(900))]
    pages = [(i + 1, PAGE.replace("A second paragraph", f"{begin} {ends[e]} paragraph")) for i, e in enumerate((1, 1, 2))] + [(7, None), (8, "")]
    spark.createDataFrame([(i, f"http://h{i}.example/", h) for i, h in pages], "id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    meta = [(i, f"http://h{i}.example/", "t", 9, begin[:1200]) for i in (2, 3)]  # the same start; no record of the copy
    spark.createDataFrame(meta, "doc_id long, url string, title string, length int, snippet_text string").write.parquet(f"{tmp_path}/doc_meta.parquet")
    got = {r["doc_id"]: r["group_id"] for r in p6_groups(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 7: 7, 8: 8}
