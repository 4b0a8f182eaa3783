"""Lines repeated across one site's pages (problem 2).

Lines are masked and clustered within their site by locality-sensitive hashing, and clusters that stand on many
distinct pages are found. Two forms of each line are clustered:

* its letters alone (numbers, dates in digits, signs and markup masked away). :func:`same_lines` clusters them in
  ``LETTER_BANDS`` bands of ``LETTER_ROWS`` MinHash rows over their 5-grams (similarity 0.9 meets with 96 %, 0.8 with 79 %,
  equal letters always). The lines of a cluster on ``min_pages`` pages are candidates; of these a line is found if its own
  letters stand on so many pages. Names and months are not masked here: they are told by case and by word, which lines of
  the same letters need not share.
* its words with names (runs of capitalised words) and month names masked too: its form. Only a line of ``LEAST_WORDS``
  distinct words left, which hold at least ``SHARE`` of its letters, has one; so lines of like forms agree in most of
  their letters. Forms of one site are like if their sets of words have Jaccard similarity ``SIMILARITY``; they meet in
  ``BANDS`` bands of ``ROWS`` MinHash rows each (similarity 0.8 meets with 99.8 %, 0.7 with 96 %), are verified on the
  words, and joined to clusters over their links. A line is ``near`` if its cluster stands on ``near_pages`` pages.
  :func:`repeated_lines` and :func:`clean_pages` take these, and as ``exact`` a plain count of equal letters.

Letters met on enough pages within one block of a task are decided there: their lines leave the task as found, and one row
goes on to tell other tasks. So a notice on a third of all pages reaches the shuffle as one row for each block. The same
holds for a cluster of letters. In the plain count the letters of one signature are spread over ``SPREAD`` groups.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestem.llm import markup
from lodestem.llm.groups import reduce_sorted
from lodestem.llm.minhash import banded, signatures
from lodestem.llm.near import connected
from lodestem.sources.staging import staged

MIN_PAGES, NEAR_PAGES = 5, 20
SPREAD = 16
#: Forms of a band that its words are ordered by.
ORDERED_BY = 20_000
#: Repeated letters, forms and ids delivered again are handed to all tasks up to this many (8 bytes each).
BROADCAST_KEYS = 2_000_000
#: Lines held by a task before it passes on what it has.
BLOCK_LINES = 400_000
EXACT, NEAR, DECIDED, TOLD, CANDIDATE, MEMBER, CLUSTER = range(7)
#: MinHash bands, and rows of a band, that the letters of lines meet in.
LETTER_BANDS, LETTER_ROWS = 3, 4
#: Distinct words and share of the line's letters that masking has to leave for a line to have a form.
LEAST_WORDS, SHARE = 4, 2 / 3
#: Forms of this Jaccard similarity of words are like; MinHash bands and rows of a band that let them meet.
SIMILARITY, BANDS, ROWS = 0.7, 12, 4
#: Month names masked as dates (English, German, French, Spanish).
MONTHS = frozenset(
    "january february march april may june july august september october november december "
    "januar februar märz mai juni juli oktober dezember "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
)
_NAMES = re.compile(r"\b[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[  ]+[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)+")
_WORDS = re.compile(r"[^\W\d_]+")


def _left(text: str) -> list[str]:
    return [w for w in _WORDS.findall(_NAMES.sub(" ", text).lower()) if w not in MONTHS]


def masked(text: str) -> str:
    """Words of a line, lower case, without numbers, names and months."""
    return " ".join(_left(text))


def form(text: str, letters: int | None = None) -> list[str]:
    """Distinct words of the masked line; none where masking leaves too little of the line's ``letters`` to tell it by."""
    left = _left(text)
    if len(left) < LEAST_WORDS or sum(map(len, left)) < SHARE * (len(markup.letters(text)) if letters is None else letters):
        return []
    words = sorted(set(left))
    return words if len(words) >= LEAST_WORDS else []


def _form_key(site: str, words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join([site, "", *words]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forms(sites: list[str], letters: list[str], texts: list[str]) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Key and hashed words (of the site's own) of each line's form; None for lines without one."""
    keys, words = np.zeros(len(texts), np.uint64), []
    for i, (site, key, text) in enumerate(zip(sites, letters, texts)):
        own = form(text, len(key))
        if own:
            keys[i] = _form_key(site, own)
            seed = xxhash.xxh32_intdigest(site)
            words.append(np.unique(np.array([xxhash.xxh32_intdigest(w, seed) for w in own], np.uint32)).view(np.int32))
        else:
            words.append(None)
    return keys, words


def _clusters(buckets: np.ndarray, own: np.ndarray, ids: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Whether each line of a block is in a cluster that stands on enough pages within it, and rows to tell other blocks
    by: one of each such cluster, the members of the others. ``buckets``: of each line, for each band."""
    many = np.zeros(len(own), bool)
    rows = []
    for of_line in buckets:
        order = np.lexsort((ids, of_line[at]))
        line, page = at[order], ids[order]
        bucket = of_line[line]
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        pages = np.bincount(np.cumsum(new) - 1, weights=new | np.r_[True, page[1:] != page[:-1]])
        told = (pages >= least)[np.cumsum(new) - 1]
        many[line[told]] = True
        for chosen, state in ((told & new, CLUSTER), (~told, MEMBER)):
            rows.append([bucket[chosen].view(np.int64), own[line[chosen]].view(np.int64), page[chosen], np.full(chosen.sum(), -1, np.int32), np.full(chosen.sum(), state, np.int8)])
    return many, rows


def _block(sites: list[str], keys: list[str], texts: list[str], where: list[list[tuple[int, int]]], least: int, near: bool) -> list[pa.Array]:
    """Rows (group, key, id, line_no, state, words) of one block: distinct (site, letters) with their places. Only
    near rows have words, and of the rows of a form only the first. Without ``near``, rows of clusters of letters."""
    seeds = np.array([xxhash.xxh64_intdigest(s) for s in sites], np.uint64)
    own = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64) ^ seeds
    group = (signatures(keys) ^ seeds) + own % np.uint64(SPREAD) if near else own
    sizes = np.array([len(w) for w in where])
    ids = np.fromiter((i for w in where for i, _ in w), np.int64, sizes.sum())
    lines = np.fromiter((n for w in where for _, n in w), np.int32, sizes.sum())
    k, g = np.repeat(own, sizes).view(np.int64), np.repeat(group, sizes).view(np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((lines, ids, k))
    a, b, c, d = k[order], g[order], ids[order], lines[order]
    first_key = np.r_[True, a[1:] != a[:-1]]
    first_id = first_key | np.r_[True, c[1:] != c[:-1]]
    of = np.cumsum(first_key) - 1
    pages = np.bincount(of, weights=first_id).astype(np.int64)
    decided = pages[of] >= least
    told = decided & first_key
    open_ = ~decided
    state = np.full(len(order), EXACT, np.int8)
    clusters: list[list[np.ndarray]] = []
    if not near:
        many, clusters = _clusters(banded(keys, LETTER_BANDS, LETTER_ROWS) ^ seeds, own, ids, at, least)
        state[many[at[order]]] = CANDIDATE
    spread = c[decided] * np.int64(-7046029254386353131)  # anywhere, but one place for a page
    rows = [
        [b[open_], a[open_], c[open_], d[open_], state[open_]],
        [b[told], a[told], c[told], np.full(told.sum(), -1, np.int32), np.full(told.sum(), TOLD, np.int8)],
        [spread, a[decided], c[decided], d[decided], np.full(decided.sum(), DECIDED, np.int8)],
        *clusters,
    ]
    words: list[np.ndarray] = []
    if near:
        forms, of_form = _forms(sites, keys, texts)
        has = np.array([w is not None for w in of_form])
        _, first = np.unique(forms, return_index=True)
        first = first[has[first]]
        begin = np.cumsum(sizes) - sizes
        told_at = begin[first]  # the first place of each form's first line
        place = np.flatnonzero(has[at])
        place = np.r_[told_at, np.setdiff1d(place, told_at, assume_unique=True)]
        key = forms[at[place]].view(np.int64)
        rows.append([key, key, ids[place], lines[place], np.full(len(place), NEAR, np.int8)])
        words = [of_form[i] for i in first]
    columns = [pa.array(np.concatenate(x)) for x in zip(*rows)]
    total, before = len(columns[0]), len(columns[0]) - (len(rows[-1][0]) if near else 0)
    counts = np.zeros(total, np.int64)
    counts[before : before + len(words)] = [len(w) for w in words]
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    return [*columns, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(words) if words else np.empty(0, np.int32)))]


_COLUMNS = ("group", "key", "id", "line_no", "state", "words")


def _rows(pages: DataFrame, least: int, near: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], int] = {}
        texts: list[str] = []
        where: list[list[tuple[int, int]]] = []
        count = 0

        def give() -> pa.RecordBatch:
            columns = _block([s for s, _ in held], [k for _, k in held], texts, where, least, near)
            return pa.RecordBatch.from_arrays(columns, names=list(_COLUMNS))

        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                b = whole.slice(start, 64)
                for i, url, source in zip(*(c.to_pylist() for c in b.columns)):
                    if not source:
                        continue
                    host = markup.site(url)
                    for n, text in enumerate(markup.visible_lines(source)):
                        key = markup.letters(text)
                        if not key:
                            continue
                        at = held.setdefault((host, key), len(held))
                        if at == len(where):
                            texts.append(text)
                            where.append([(i, n)])
                        else:
                            where[at].append((i, n))
                        count += 1
                if count > BLOCK_LINES:
                    yield give()
                    held, texts, where, count = {}, [], [], 0
        if held:
            yield give()

    schema = T.StructType([T.StructField("group", T.LongType()), T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("state", T.ByteType()), T.StructField("words", T.ArrayType(T.IntegerType()))])
    return pages.select("id", "url", "html").where(F.col("id").isNotNull() & F.col("html").isNotNull()).mapInArrow(run, schema)


def _banded(words: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Band keys of sets of hashed words, one array for each band."""
    h = words.view(np.uint32).astype(np.uint64)
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    odd = np.random.default_rng(7).integers(1, 1 << 62, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for band in range(BANDS):
        key = np.full(len(starts), band, np.uint64)
        for k in odd[band]:
            key = (key ^ np.minimum.reduceat(h * k, starts)) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(31)
        out.append(key)
    return out


def _bands(forms: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = b.column(1)
                starts = own.offsets.to_numpy()[:-1] - own.offsets[0].as_py()
                for key in _banded(own.flatten().to_numpy(), starts):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0)], names=["band", "key"])

    return forms.select("key", "words").mapInArrow(run, "band long, key long")


def _linked(shared: DataFrame) -> DataFrame:
    """``x``, ``y``: like forms of a band. Within it each form is held against those that no earlier one was like, and
    linked with all of these that it is like; further links come from the other bands.

    Two like sets share a word among the first |x| - ceil(``SIMILARITY`` |x|) + 1 of each, in one order of all words; so a
    form meets only those that an index of these words gives, not its whole band. The order is by rarity among the first
    ``ORDERED_BY`` forms of the band, the others' words come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank: Counter[int] | None = None  # of the band that is at work, once enough of it is seen
        held: list[tuple[int, frozenset[int]]] = []
        leaders: list[tuple[int, frozenset[int]]] = []
        index: dict[int, list[int]] = {}
        x: list[int] = []
        y: list[int] = []

        def work() -> None:
            nonlocal rank
            if rank is None:
                rank = Counter()
                for _, own in held:
                    rank.update(own)
            for key, own in held:
                first = sorted(own, key=lambda w: (rank[w], w))[: len(own) - math.ceil(SIMILARITY * len(own) - 1e-9) + 1]
                alone = True
                for at in {i for w in first for i in index.get(w, ())}:
                    other, theirs = leaders[at]
                    if other == key:
                        alone = False
                        continue
                    both = len(own & theirs)
                    if both >= SIMILARITY * (len(own) + len(theirs) - both) - 1e-9:
                        x.append(key), y.append(other)
                        alone = False
                if alone:
                    for w in first:
                        index.setdefault(w, []).append(len(leaders))
                    leaders.append((key, own))
            held.clear()

        band: int | None = None
        for whole in batches:
            for v, key, words in zip(*(c.to_pylist() for c in whole.columns)):
                if v != band:
                    work()
                    band, rank, leaders, index = v, None, [], {}
                held.append((key, frozenset(words)))
                if len(held) >= ORDERED_BY:
                    work()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])
            x.clear(), y.clear()
        work()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return shared.select("band", "key", "words").repartition("band").sortWithinPartitions("band", "key").mapInArrow(run, "x long, y long").distinct()


def _near_forms(places: DataFrame, near_pages: int) -> DataFrame:
    """``key`` and ``words`` of the forms whose cluster stands on enough pages; staged."""

    def several(t: dict[str, np.ndarray]) -> np.ndarray:
        order = np.lexsort((t["key"], t["band"]))
        band, key = t["band"][order], t["key"][order]
        new = np.r_[True, band[1:] != band[:-1]]
        other = new | np.r_[True, key[1:] != key[:-1]]  # the same form from several blocks
        of = np.cumsum(new) - 1
        wanted = np.empty(len(order), bool)
        wanted[order] = other & (np.bincount(of, weights=other)[of] > 1)
        return wanted

    forms = places.where(F.size("words") > 0).select("key", "words")
    shared = staged(reduce_sorted(_bands(forms), "band", several, ["band", "key"]))
    met = forms.join(shared.select("key").distinct(), "key").dropDuplicates(["key"])
    edges = staged(_linked(shared.join(met, "key")))
    roots = connected(edges).withColumnsRenamed({"node": "key", "root": "cluster"})
    of = staged(places.select("key", "id").distinct().join(roots, "key", "left").select("key", F.coalesce("cluster", "key").alias("cluster"), "id"))
    many = of.groupBy("cluster", "id").agg(F.lit(1).alias("one")).groupBy("cluster").agg(F.count("one").alias("n")).where(F.col("n") >= near_pages)
    wanted = of.select("key", "cluster").distinct().join(many, "cluster").select("key")
    return staged(wanted.join(forms, "key").dropDuplicates(["key"]))


def _decided(rows: DataFrame, min_pages: int, out: list[str]) -> DataFrame:
    """Columns ``out`` of the rows whose letters stand on enough pages."""

    def keep(t: dict[str, np.ndarray]) -> np.ndarray:
        order = np.lexsort((t["id"], t["key"]))
        key, ids, state = t["key"][order], t["id"][order], t["state"][order]
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_id = new_key | np.r_[True, ids[1:] != ids[:-1]]
        of = np.cumsum(new_key) - 1
        pages_of = np.bincount(of, weights=new_id)[of]
        told = np.bincount(of, weights=state == TOLD)[of] > 0
        wanted = np.empty(len(order), bool)
        wanted[order] = (pages_of >= min_pages) | told | (state == DECIDED)
        return wanted & ((t["line_no"] >= 0) | ("line_no" not in out))

    return reduce_sorted(rows.where(F.col("state") != NEAR).drop("words"), "group", keep, out)


def _candidates(rows: DataFrame, min_pages: int) -> DataFrame:
    """``key`` of the letters that, by all blocks, are in a cluster on enough pages; staged."""

    def many(t: dict[str, np.ndarray]) -> np.ndarray:
        order = np.lexsort((t["id"], t["group"]))
        group, ids = t["group"][order], t["id"][order]
        new = np.r_[True, group[1:] != group[:-1]]
        of = np.cumsum(new) - 1
        pages = np.bincount(of, weights=new | np.r_[True, ids[1:] != ids[:-1]])
        told = np.bincount(of, weights=t["state"][order] == CLUSTER) > 0
        wanted = np.empty(len(order), bool)
        wanted[order] = ((pages >= min_pages) | told)[of]
        return wanted & (t["state"] == MEMBER)

    members = rows.where(F.col("state").isin(MEMBER, CLUSTER)).select("group", "key", "id", "state")
    return staged(reduce_sorted(members, "group", many, ["key"]).distinct())


def same_lines(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``id``, ``line_no``: lines whose letters stand on ``min_pages`` distinct pages of their site. Clusters of letters on so
    many pages give the candidates, and a count of equal letters decides among them. Pages and lines as in
    :func:`repeated_lines`."""
    rows = staged(_rows(pages, min_pages, False))
    keys = _candidates(rows, min_pages)
    told = rows.where(F.col("state") == EXACT).join(keys, "key", "left_semi").select(*_COLUMNS)
    found = _decided(rows.where(F.col("state").isin(CANDIDATE, TOLD)).unionByName(told), min_pages, ["id", "line_no"])
    return found.unionByName(rows.where(F.col("state") == DECIDED).select("id", "line_no")).distinct()


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES, near_pages: int = NEAR_PAGES) -> DataFrame:
    """``id``, ``line_no``, ``exact``: lines of clusters on many pages of their site; ``exact`` if the line's own
    letters stand on ``min_pages`` distinct pages.

    Repeated rows of an id are one page. Null or empty pages have no lines; a null URL is a site of its own; lines
    without letters belong to no cluster.
    """
    rows = staged(_rows(pages, min_pages, True))
    found = _decided(rows, min_pages, ["id", "line_no"]).withColumn("exact", F.lit(True))
    places = rows.where(F.col("state") == NEAR)
    near = places.drop("words").join(_near_forms(places, near_pages), "key").select("id", "line_no", F.lit(False).alias("exact"))
    found = found.unionByName(near)
    return found.groupBy("id", "line_no").agg(F.max("exact").alias("exact"))


def clean_pages(pages: DataFrame, min_pages: int = MIN_PAGES, near_pages: int = NEAR_PAGES) -> DataFrame:
    """``id``, ``text``: what :func:`without_repeated` gives with :func:`repeated_lines`. No HTML is shuffled: the letters
    and forms that are repeated, few for each site, go to a second scan while they are at most ``BROADCAST_KEYS``."""
    rows = staged(_rows(pages, min_pages, True))
    exact = staged(_decided(rows.where(F.col("state") != DECIDED), min_pages, ["key"]).distinct())
    near = _near_forms(rows.where(F.col("state") == NEAR), near_pages)
    twice = pages.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if exact.count() + near.count() + twice.count() > BROADCAST_KEYS:
        return without_repeated(pages, repeated_lines(pages, min_pages, near_pages))
    keys = [np.sort(k.toPandas()["key"].to_numpy(np.int64)) for k in (exact, near)]
    # a line of a form holds all its words, the least by hash too: most lines are ruled out by that
    anchors = near.select(F.array_min("words").alias("w")).distinct().toPandas()["w"].to_numpy(np.int64)
    shared = pages.sparkSession.sparkContext.broadcast([*keys, anchors.astype(np.int32).view(np.uint32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, forms, least = (set(k.tolist()) for k in shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                b = whole.slice(start, 64)
                out = []
                for url, source in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    site = markup.site(url)
                    seed, seed_of_words = xxhash.xxh64_intdigest(site), xxhash.xxh32_intdigest(site)

                    def kept(text: str, site: str = site, seed: int = seed, seed_of_words: int = seed_of_words) -> bool:
                        own = markup.letters(text)
                        if not own:
                            return True
                        if _signed(xxhash.xxh64_intdigest(own) ^ seed) in letters:
                            return False
                        if not any(xxhash.xxh32_intdigest(w, seed_of_words) in least for w in _WORDS.findall(text.lower())):
                            return True
                        return not (f := form(text, len(own))) or _signed(_form_key(site, f)) not in forms

                    out.append(None if source is None else "\n".join(x for t in markup.visible_lines(source) if (x := " ".join(t.split())) and kept(t)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    scan = lambda df: df.select("id", "url", "html").mapInArrow(run, "id long, text string")
    pages = pages.where(F.col("id").isNotNull())
    several = scan(pages.join(F.broadcast(twice), "id", "left_semi")).groupBy("id").agg(F.max("text").alias("text"))
    return scan(pages.join(F.broadcast(twice), "id", "left_anti")).unionByName(several)


def _cut(pages: DataFrame, lines: DataFrame, keep: bool) -> DataFrame:
    """``id``, ``text``: visible text of each page, only of ``lines`` or all but these; blank lines left out."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                b = whole.slice(start, 64)
                out = []
                for source, named in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    named = set(named or ())
                    out.append(None if source is None else "\n".join(x for n, x in enumerate(" ".join(t.split()) for t in markup.visible_lines(source)) if x and (n in named) == keep))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    named = lines.groupBy("id").agg(F.collect_set("line_no").alias("named"))  # the lines of one page
    one = pages.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("html").alias("html"))
    return one.join(named, "id", "left").select("id", "html", "named").mapInArrow(run, schema)


def without_repeated(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """``id``, ``text``: visible text of each page without ``lines`` (of :func:`repeated_lines`); null stays null, and
    repeated rows of an id give one result row."""
    return _cut(pages, lines, False)


def only_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """``id``, ``text``: the same of ``lines`` alone; empty for a page that has none of them."""
    return _cut(pages, lines, True)
