import random
import re
from collections import defaultdict

import numpy as np

from lodestem.llm import markup, sitelines
from lodestem.llm.minhash import banded, signatures
from lodestem.llm.queries import p2_found
from tests.llm.test_pages import found, table

NOTICE = "<p>Share this {} with all the readers of our open encyclopedia, who are many</p>"


def written(spark, rows, folder, parts=6):
    """A table of pages in so many parts: with four or fewer pages of a site to a part nothing is decided within one."""
    table(spark, rows).repartition(parts).select("id", "url", "html").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_bands_of_signatures():
    texts = ["one line", "another line", "", "one line"]
    got = banded(texts, 3, 2)
    assert got.shape == (3, 4) and np.array_equal(got[:, 0], got[:, 3]) and np.array_equal(got[0], signatures(texts))
    assert len({*got[:, 0]}) == 3 and banded([], 3, 2).shape == (3, 0)


def test_found_lines_are_of_clusters(spark, tmp_path, monkeypatch):
    """What no cluster on enough pages holds is not found, and the lines of a cluster are so only by their own letters."""
    words = ["page", "leaf", "note", "item", "line", "text"]
    rows = [(i, f"http://s.example/{i}", "<p>See also</p>\n" + NOTICE.format(words[i])) for i in range(6)]
    folder = written(spark, rows, tmp_path)
    handed = []
    kept = sitelines._candidates

    def candidates(rows, least):
        keys = kept(rows, least)
        handed.append({r["key"] for r in keys.collect()})
        return keys

    monkeypatch.setattr(sitelines, "_candidates", candidates)
    assert found(p2_found(spark, folder), "id", "line_no") == [(i, 0) for i in range(6)]
    assert len(handed[0]) > 4  # the notices, each of other letters, as well
    monkeypatch.setattr(sitelines, "_candidates", lambda rows, least: kept(rows, least).limit(0))
    assert p2_found(spark, folder).count() == 0


def test_same_lines_by_brute_force(spark, tmp_path):
    rng = random.Random(6)
    lines = [NOTICE.format(w) for w in ("page", "PAGE!", "pa<b>ge</b> 7", "leaf", "note")] + ["Print", "p r i n t", "12 – 13", "", "<i>Größe</i>", "grösse", "May 3"]
    rows = [(i, f"http://{'st'[i % 2]}.example/{i}", "\n".join(rng.choice(lines) + rng.choice(["", "", f" x{chr(97 + i % 26)}"]) for _ in range(rng.randrange(5)))) for i in range(60)]
    rows += [rows[7], rows[8], (None, "http://s.example/", "Print"), (90, None, "Print"), (91, "http://s.example/", None)]
    on = defaultdict(set)
    for i, url, html in rows:
        for n, text in enumerate(markup.visible_lines(html or "") if i is not None else []):
            if key := re.sub(r"[\W\d_]", "", text).lower():
                on[markup.site(url), key].add((i, n))
    want = sorted({p for places in on.values() if len({i for i, _ in places}) >= 5 for p in places})
    for parts in (1, 20):
        got = p2_found(spark, written(spark, rows, tmp_path / f"{parts}", parts))
        assert found(got, "id", "line_no") == want and want
