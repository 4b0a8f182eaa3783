import random
import re
from array import array
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestem.llm import bpe, garbled, leaks, near
from tests.conftest import DATA

DOCS = "doc_id long, text string, key string, class string, at string, ids string"
ITEMS = "item_id long, text string, doc_id string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], DOCS)


# ---- encoding

@pytest.fixture(scope="module")
def encoders():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.encode_special_tokens = True
    return bpe.Encoder(bpe.default_vocabulary()), library


def ids(encoder, text):
    out = array("i")
    encoder.append(text, out)
    return list(out)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abe nrt'\n0", max_size=80)))
def test_ids_of_any_text(encoders, text):
    assert ids(encoders[0], text) == encoders[1].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|> a", "a" * 3000, "ab" * 2000, " " * 999 + "x", "é" * 500, "😀👍🏽", "'ll 'LL don't", "٣٤٥"])
def test_ids_of_odd_texts(encoders, text):
    assert ids(encoders[0], text) == encoders[1].encode(text, add_special_tokens=False).ids


def test_ids_of_the_corpus(spark, encoders):
    df = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = {r["doc_id"]: encoders[1].encode(r["text"] or "", add_special_tokens=False).ids for r in df.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in bpe.encode(df, "doc_id", "text").collect()} == want


def test_ids_of_nothing(spark):
    got = bpe.encode(docs(spark, [(1, None), (2, ""), (2, "")]), "doc_id", "text").collect()
    assert [(r["doc_id"], r["ids"]) for r in got] == [(1, []), (2, []), (2, [])]
    assert bpe.encode(docs(spark, []), "doc_id", "text").count() == 0


# ---- leaks

def leaked(documents, items, window=10):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    out = set()
    for i, t in items:
        w = words(t)
        grams = {tuple(w[k : k + window]) for k in range(len(w) - window + 1)}
        for d, u in documents:
            v = words(u)
            if d is not None and i is not None and any(tuple(v[k : k + window]) in grams for k in range(len(v) - window + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("limit", [leaks.BLOCK_WINDOWS, 7])
def test_leaks(spark, limit):
    rng = random.Random(5)
    word = lambda: rng.choice("red fox owl log sun sea".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 10, 14])))) for i in range(12)] + [(20, None), (21, ""), (None, "red " * 12), (22, "same " * 15), (23, "Same-" * 11)]
    documents = [(i, " ".join(word() for _ in range(60))) for i in range(60)]
    documents += [(100 + k, "before, " + t.upper().replace(" ", " -- ") + " after") for k, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (202, "same same " * 400), (None, "same " * 20), documents[0]]
    items.append((30, " ".join(documents[3][1].split()[20:32])))
    got = leaks.leaked_items(docs(spark, documents), spark.createDataFrame([(*r, "x") for r in items], ITEMS), block_windows=limit)
    rows = [(r["doc_id"], r["item_id"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == leaked(documents, items) and (3, 30) in rows


def test_leaks_of_ids_with_several_texts(spark):
    word = lambda k: " ".join(f"{k}{i}" for i in range(14))
    items = [(1, word("a")), (1, word("b")), (2, word("a")), (3, word("c")), (3, word("c"))]
    documents = [(7, "x " + word("a")), (8, word("b") + " y"), (9, word("c")), (9, "z " + word("b")[:-4])]
    got = leaks.leaked_items(docs(spark, documents), spark.createDataFrame([(*r, "x") for r in items], ITEMS)).collect()
    assert sorted(tuple(r) for r in got) == [(7, 1, 5), (7, 2, 5), (8, 1, 5), (9, 1, 4), (9, 3, 5)]


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], ITEMS)
    assert leaks.leaked_items(docs(spark, [(1, "a b")]), none).count() == 0
    assert leaks.leaked_items(docs(spark, []), spark.createDataFrame([(1, "a " * 20, "x")], ITEMS)).count() == 0


# ---- similar records

def similar(rows, words, least):
    sets = []
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        s = set(zip(*(w[k:] for k in range(words))))
        if s and i is not None:
            sets.append((i, s))
    return {(min(a, b), max(a, b)) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1 :] if a != b and len(s & t) >= least * len(s | t)}


@pytest.mark.parametrize(("words", "least"), [(3, 0.5), (5, 0.8), (1, 0.5), (2, 0.9)])
def test_similar_pairs(spark, words, least):
    rng = random.Random(words)
    base = [[rng.choice([f"w{k}" for k in range(30)]) for _ in range(rng.choice([3, 8, 25]))] for _ in range(25)]
    rows = []
    for i in range(150):
        w = list(base[i % 25])
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(5)}"
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "one"), (None, rows[0][1]), rows[3], (503, rows[0][1].upper())]
    got = [(r["id_a"], r["id_b"]) for r in near.similar_pairs(docs(spark, rows), "doc_id", "text", near.Form(words), least).collect()]
    assert len(got) == len(set(got)) and set(got) == similar(rows, words, least)


@pytest.mark.parametrize("split", [near.SPLIT, 7])
def test_chunks_and_few_ordered(spark, monkeypatch, split):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(12))) for i in range(80)]
    monkeypatch.setattr(near, "ORDERED", 3 if split > 7 else 100)
    monkeypatch.setattr(near, "SPLIT", split)
    monkeypatch.setattr(near, "BROADCAST_IDS", 0)
    got = {(r["id_a"], r["id_b"]) for r in near.similar_pairs(docs(spark, rows), "doc_id", "text", near.Form(1), 0.7).collect()}
    assert got == similar(rows, 1, 0.7)


def test_groups(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, a), (3, a + " x"), (9, a + " x y"), (7, a), (2, b), (8, "alone in the whole world"), (6, None), (11, "Δύο λέξεις"), (10, "δύο – λέξεις!"), (12, "δύο"), (14, "検索索引保存"), (13, "検索 索引、保存"), (15, "…")]
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in near.similar_groups(docs(spark, rows), "doc_id", "text").collect()}
    assert got == {5: (3, 2), 3: (3, 2), 9: (3, 2), 7: (3, 2), 2: (2, 0), 8: (8, 0), 10: (10, 0), 11: (10, 0), 12: (12, 0), 13: (13, 0), 14: (13, 0)}
    assert near.similar_groups(docs(spark, []), "doc_id", "text").count() == 0


def test_prefixes_do_not_grow_with_copies_or_tasks(spark):
    """Classes come before counts and prefixes: copies of one text, in any number of tasks, leave the same rows."""
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(200)}" for _ in range(40)) for _ in range(3)]
    seen = set()
    for copies, tasks in ((500, 2), (2000, 2), (2000, 8)):
        rows = spark.range(copies).select("id", F.element_at(F.array(*map(F.lit, base)), (F.col("id") % 3 + 1).cast("int")).alias("text")).withColumn("h", F.xxhash64("text")).repartition(tasks)
        form = near.Form(3)
        texts = near._texts(rows, near._signatures(rows, form).distinct())
        prefixes = near._prefixes(texts, form, 0.5, near._frequent(near._counts(texts, form)))
        seen.add((texts.count(), prefixes.count(), prefixes.agg(F.sum(F.hash("cell"))).first()[0]))
    assert len(seen) == 1 and next(iter(seen))[0] == 3


def test_prefixes_are_narrow_in_a_shuffle(spark):
    """What differs between two prefix rows of a text is a few bytes, side by side (14.4 bytes a row when it was not)."""
    rng = random.Random(4)
    rows = docs(spark, [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(200))) for i in range(200)])
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return [sum(getattr(stages.apply(i), f"shuffleWrite{x}")() for i in range(stages.size())) for x in ("Bytes", "Records")]

    prefixes = near._prefixes(rows, near.Form(3), 0.5, near._frequent(near._counts(rows, near.Form(3))))
    before = written()
    assert near._met(prefixes, 0.5).count() == 0
    size, count = (y - x for x, y in zip(before, written()))
    assert 20_600 <= count < 20_700 and size < 13.7 * count


def test_cells_that_agree_by_chance_give_no_pair(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(near, "_CELL", np.uint64(0xF << 60))
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(12))) for i in range(60)]
    got = [(r["id_a"], r["id_b"]) for r in near.similar_pairs(docs(spark, rows), "doc_id", "text", near.Form(1), 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == similar(rows, 1, 0.7)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 -é\u212aß\n_", max_size=30)), max_size=12), st.sampled_from([8, 1 << 20]))
@settings(max_examples=60, deadline=None)
def test_plain_words(texts, at_once):
    import numpy as np

    words = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    near._AT_ONCE, kept = at_once, near._AT_ONCE
    try:
        hashes, counts = near._PlainWords()(texts)
    finally:
        near._AT_ONCE = kept
    flat = [w for x in words for w in x]
    assert counts.tolist() == [len(x) for x in words] and len({*zip(flat, hashes.tolist())}) == len(set(flat)) == len(np.unique(hashes))


def test_similar_records(spark):
    text = " ".join(f"a{k}" for k in range(30))
    rows = [(5, text), (3, text), (4, text.upper() + "!"), (9, text + " end"), (9, text + " end"), (7, "of its own, only"), (8, "two words"), (6, None), (None, text)]
    got = near.similar_records(docs(spark, rows), "doc_id", "text", near.Form(3), 0.5).collect()
    assert sorted(tuple(r) for r in got) == [(3, 3, 1), (4, 3, 1), (5, 3, 1), (7, 7, 0), (9, 9, 1)]
    assert near.similar_records(docs(spark, []), "doc_id", "text").count() == 0


def test_connected_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = {r["node"]: r["root"] for r in near.connected(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# ---- garbled texts

CLEAN = ["Die Bücher ergänzen die Gewässer für Åskvin.", "Les élèves complètent les forêts où règne l’été…", "Les señales añaden índices todavía.", "Książki zawierają rzeki wśród ciągłych zapytań.", "Реки хранят ссылки через словари, часто.", "Τα αρχεία αλλάζουν οι πόλεις συχνά.", "索引が保存する検索を。", "She said “no” — twice, it’s 5 °C ± 1."]


@pytest.fixture(scope="module")
def model():
    return garbled.Classifier.fit(Counter(x for t in CLEAN * 20 for x in garbled._TOKENS(t) if not x.isascii()))


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(model, text):
    assert garbled.repaired(text, model) == (False, text, 0, True)


@pytest.mark.parametrize("chain", [k for k, (w, r) in enumerate(garbled.CHAINS) if w == "utf-8" and r in ("latin-1", "cp1252", "cp437", "cp1251", "mac_roman")])
@pytest.mark.parametrize("text", [CLEAN[0], CLEAN[2], CLEAN[4], CLEAN[6]])
def test_restores_utf8_chains(model, chain, text):
    bad = garbled.garble(text, chain)
    assert bad is not None and garbled.restore(bad, chain) == text
    found, new, _, whole = garbled.repaired(bad, model)
    assert found and new == text and whole


def test_restores_double_and_cyrillic(model):
    once = garbled.garble(CLEAN[0], 1)
    found, new, _, _ = garbled.repaired(garbled.garble(once, 1), model)
    assert found and new == CLEAN[0]
    bad = CLEAN[4].encode("cp1251").decode("koi8-r")
    assert garbled.repaired(bad, model)[:2] == (True, CLEAN[4])


def test_lost_and_cited(model):
    found, new, n, whole = garbled.repaired("les for�ts", model)
    assert found and new == "les for�ts" and n == 1 and not whole
    for cited in ("The repair table maps â€™ → ’ and leaves all else alone.", "Read Å‚ for ł, always.", "The bytes of “ü” turn into `Ã¼` when a page is read with the wrong charset.", 'A test string such as "â€“" is shown.'):
        assert not garbled.repaired(cited, model)[0]


def test_garbled_table(spark):
    rows = [(i, CLEAN[i % 8]) for i in range(160)] + [(200, None), (201, ""), (202, "plain"), (203, "Die BÃ¼cher"), (204, "x " * 9000 + "fÃ¼r"), (203, "Die BÃ¼cher")]
    got = garbled.garbled_texts(docs(spark, rows))
    assert sorted((r["doc_id"], r["restored"][:10]) for r in got.collect()) == [(203, "Die Bücher"), (203, "Die Bücher"), (204, "x x x x x ")]
    assert garbled.garbled_texts(docs(spark, rows[:0])).count() == 0


@pytest.fixture(scope="module")
def held_out(spark):
    """A model fitted on half of the test data, and the other half's documents that it finds nothing in."""
    rows = [r for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").where(F.length("text") > 0).collect() if not r["text"].isascii()]
    model = garbled.Classifier.fit(Counter(x for r in rows[::2] for x in garbled._TOKENS(r["text"]) if not x.isascii()))
    return model, [r["text"] for r in rows[1::2] if not garbled.repaired(r["text"], model)[0]]


@pytest.mark.parametrize("chain", range(len(garbled.CHAINS)), ids=["-".join(c) for c in garbled.CHAINS])
def test_garbled_held_out(held_out, chain):
    """Held-out documents of ten or more words that the chain changes come out whole, but for one in eight."""
    model, texts = held_out
    found = whole = total = 0
    for text in texts:
        bad = garbled.garble(text, chain)
        if bad is None or garbled.restore(bad, chain) != text or sum(a != b for a, b in zip(set(text.split()), map(lambda t: garbled.garble(t, chain) or t, set(text.split())))) < 10:
            continue
        got = garbled.repaired(bad, model)
        total, found, whole = total + 1, found + got[0], whole + (got[1] == text)
        if total == 25:
            break
    assert total >= 3 and found >= 0.95 * total and whole >= 0.87 * total


def test_partly_garbled(held_out):
    """Of a record garbled in one place only the words there change."""
    model, texts = held_out
    text = next(t for t in texts if "ż" in t and len(t) > 300)
    at = text.index(" ", len(text) // 2)
    bad = text[:at] + text[at:].encode("cp1250", "replace").decode("cp1252", "replace")
    found, new, _, _ = garbled.repaired(bad, model)
    assert found and new[:at] == text[:at] and sum(a == b for a, b in zip(new.split(), text.split())) >= 0.9 * len(text.split())


def test_training_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(garbled, "SAMPLE_ROWS", 20)
    rows = [(i, f"é{i} ü plain") for i in range(3000)] + [(5000, None), (5001, ""), (5002, "ascii"), (5003, "長" * 500)]
    got = garbled.training_tokens(docs(spark, rows), "doc_id", "text")
    assert got["ü"] in (19, 20) and 19 <= sum(x.startswith("é") for x in got) <= 20
    assert garbled.training_tokens(docs(spark, rows[-4:]), "doc_id", "text") == {"長" * garbled.TOKEN_SIZE: 1}
    assert garbled.training_tokens(docs(spark, []), "doc_id", "text") == {}
