import re

from lodestem.plans.queries import snippet_hit


def window(text, words):
    """By plain Python, as the library does it."""
    found = [m.start() for w in words if (m := re.search(rf"\b{w}\b", text.lower()))]
    best = min(found, default=None)
    cut = text[:320] if best is None else text[max(0, best - 80) : best + 160]
    return ("…" if best is not None and best > 80 else "") + cut.strip() + ("…" if len(text) > (best or 0) + 160 else "")


def test_every_document_has_a_row(spark, tmp_path):
    texts = [
        "plain words, then a glacier and more", "Für die Größe: " + "ä" * 90 + " Glacier élan " + "ö" * 200, "überglacier und readeré, ein Reader", "ЛЕДНИК " * 60 + "reader конец", "日本 " * 150, "kein Treffer – é",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["snippet"] for r in snippet_hit(spark, str(tmp_path)).collect()}
    assert got == {i: window(t, ("glacier", "reader")) for i, t in enumerate(texts)}
