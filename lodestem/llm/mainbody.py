"""The main body of web pages (problem 4), by tag-path ratios.

Text and punctuation are added up for each tag path (the elements from the root to the one that holds a run of text,
with class, id and role, digits masked) over all pages of a site:

1. *Ratio.* A path's ratio is its text per place, times one more than its punctuation per place, times the share of its
   text outside links, times the share of its texts that differ from page to page: a notice that stands on every page
   counts as text once. Pages that hold one article twice (equal title and equal longest text) count as one page.
2. *Smoothing.* Each ratio is drawn to those of its neighbours, as if ``NEIGHBOURS`` more places had their mean: the
   geometric mean of the paths with the same parent and of the paths with the same last element, both of that site.
3. *Threshold.* The logarithms of all ratios, weighted by places, form one histogram over all sites; the cut between
   its two classes (largest variance between classes) is the threshold. Paths below it hold no content.
4. *Fusing.* The ratios of the places in an element are summed, ``DECAY`` of those one level below; the mean of these sums
   over all elements of a path tells how much content such an element holds on its site. A page's body is the element
   whose own sum and whose path's mean, fused with the weights 1 - ``SITE`` and ``SITE``, are highest. Its places whose
   paths reach the threshold are the content.

No element name, word or position is judged. What a path cannot tell, prompts that stand between paragraphs as
paragraphs do, is told by repetition: a chosen line whose letters stand under ``REPEATED`` or more different heads
(title and first chosen line) of one site is no article text. Copies of an article begin alike, so they do not drive each other out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestem.llm import markup
from lodestem.llm.groups import reduce_sorted
from lodestem.sources.staging import staged

REPEATED = 5
NEIGHBOURS = 5
SITE = 0.8
DECAY = 0.25
#: Bins of the histogram of log(1 + ratio), this many to a unit.
BINS = 8
#: Statistics of paths are handed to all tasks up to this many (24 bytes each); beyond it pages are joined with their site's.
BROADCAST_PATHS = 2_000_000
#: Sites with at least this share of the pages are joined apart; at most 1 / HOT_SITE of them.
HOT_SITE = 0.01
_MARKS = re.compile(r"[.,;:!?。、！？]")
_MASK, _ODD = (1 << 64) - 1, 0x9E3779B97F4A7C15

#: One row of a page: its elements that hold text, in document order, and its places, one for each line and block.
_ELEMENTS = {"parent": pa.int32(), "element": pa.int64()}
_PLACES = {"line": pa.int32(), "block": pa.int32(), "path": pa.int64(), "up": pa.int64(), "over": pa.int64(), "last": pa.int64(), "letters": pa.int64(), "chars": pa.int32(), "marks": pa.int32(), "linked": pa.int32()}


def _key(a: int, b: int) -> int:
    x = ((a ^ b) * _ODD) & _MASK
    return x ^ (x >> 29)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def page_paths(source: str, site: str) -> tuple[int, int, dict[str, list[int]]]:
    """Identity of a page's article (title and longest text), its title's letters, and the page's row (``_ELEMENTS``, ``_PLACES``)."""
    nodes, leaves = markup.tree(source)
    places: dict[tuple[int, int], list] = {}
    for x in leaves:
        p = places.setdefault((x.line, x.block), ["", 0])
        p[0] += x.text
        p[1] += len(x.text) if x.linked else 0
    seed = xxhash.xxh64_intdigest(site)
    at: dict[int, int] = {}
    signs: list[int] = []
    keys: list[int] = []
    parents: list[int] = []

    def element(node: int) -> int:
        got = at.get(node)
        if got is None:
            n = nodes[node]
            up = element(n.parent) if n.parent >= 0 else -1
            sign = xxhash.xxh64_intdigest(n.sign)
            got = at[node] = len(keys)
            signs.append(_key(sign, seed ^ _ODD)), keys.append(_key(keys[up] if up >= 0 else seed, sign) + 1 & _MASK), parents.append(up)
        return got

    found: list[tuple[int, ...]] = []
    longest, identity = -1, 0
    for (line, block), (text, linked) in places.items():
        share = linked / len(text)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if not text:
            continue
        letters = markup.letters(text)
        mark = xxhash.xxh64_intdigest(letters) or 1 if letters else 0
        if len(text) > longest:
            longest, identity = len(text), mark
        found.append((line, at.get(block) or element(block), mark if mark < 1 << 63 else mark - (1 << 64), len(text), len(_MARKS.findall(text)), round(share * len(text)) if share else 0))
    line, block, letters, chars, marks, linked = map(list, zip(*found)) if found else ([], [], [], [], [], [])
    own = [_signed(x) for x in keys]
    last = [_signed(x) for x in signs]
    up = [own[p] if p >= 0 else 0 for p in parents]
    over = [up[p] if p >= 0 else 0 for p in parents]
    row = {"line": line, "block": block, "path": [own[k] for k in block], "up": [up[k] for k in block], "over": [over[k] for k in block], "last": [last[k] for k in block], "letters": letters, "chars": chars, "marks": marks, "linked": linked}
    title = xxhash.xxh64_intdigest(markup.letters(markup.title_of(source)))
    return _signed(_key(identity, title)), _signed(title), {"parent": parents, "element": own, **row}


def _lists(rows: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(rows), kind.to_pandas_dtype(), offsets[-1])))


def _parsed(pages: DataFrame, texts: bool = False) -> DataFrame:
    """Rows of pages with text: ``id``, ``site``, ``page`` (identity), ``title`` and the lists of :func:`page_paths`; with
    ``texts`` the visible text of the lines that hold places too (``at``, ``text``). No shuffle."""
    lists = _ELEMENTS | _PLACES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                ids, sites, marks, titles, numbers, visible = [], [], [], [], [], []
                columns: dict[str, list[list[int]]] = {c: [] for c in lists}
                for i, url, source in zip(*(c.to_pylist() for c in b.columns)):
                    if not source:
                        continue
                    site = markup.site(url)
                    mark, title, row = page_paths(source, site)
                    if not row["line"]:
                        continue
                    ids.append(i), sites.append(_signed(xxhash.xxh64_intdigest(site))), marks.append(mark), titles.append(title)
                    for c, v in row.items():
                        columns[c].append(v)
                    if texts:
                        lines = markup.visible_lines(source)
                        numbers.append(sorted(set(row["line"])))
                        visible.append([" ".join(lines[n].split()) for n in numbers[-1]])
                arrays = [pa.array(ids, pa.int64()), pa.array(sites, pa.int64()), pa.array(marks, pa.int64()), pa.array(titles, pa.int64()), *(_lists(v, lists[c]) for c, v in columns.items())]
                arrays += [_lists(numbers, pa.int32()), pa.array(visible, pa.list_(pa.string()))] if texts else []
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "site", "page", "title", *lists, *(("at", "text") if texts else ())])

    number = {pa.int32(): "int", pa.int64(): "long"}
    schema = "id long, site long, page long, title long, " + ", ".join(f"{c} array<{number[t]}>" for c, t in lists.items()) + (", at array<int>, text array<string>" if texts else "")
    return pages.select("id", "url", "html").where(F.col("id").isNotNull() & F.col("html").isNotNull()).mapInArrow(run, schema)


def _ratios(parsed: DataFrame) -> DataFrame:
    """``site``, ``path``, ``up``, ``over``, ``n`` (places) and the smoothed ``ratio`` of every path."""
    one = parsed.select("id", "site", "page", F.explode(F.arrays_zip(*(c for c in _PLACES if c != "block"))).alias("x")).select("id", "site", "page", "x.*")
    text = F.when(F.col("letters") != 0, F.col("letters")).otherwise(F.xxhash64("id", "line"))
    paths = one.groupBy("site", "path", "up", "over", "last").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("marks").alias("marks"), F.sum("linked").alias("linked"),
        F.approx_count_distinct(text).alias("texts"), F.approx_count_distinct(F.xxhash64(text, "page")).alias("uses"),
    )
    own = (F.col("chars") - F.col("linked")) / F.col("n") * (1 + F.col("marks") / F.col("n")) * F.least(F.lit(1.0), F.col("texts") / F.col("uses"))
    paths = staged(paths.select("site", "path", "up", "over", "last", "n", F.greatest(F.lit(0.0), own).alias("own")))
    mean = F.sum(F.col("own") * F.col("n")) / F.sum("n")
    beside = paths.groupBy("site", "up").agg(mean.alias("beside"))
    alike = paths.groupBy("site", "last").agg(mean.alias("alike"))
    near = paths.join(beside, ["site", "up"]).join(alike, ["site", "last"])
    smooth = (F.col("n") * F.col("own") + NEIGHBOURS * F.sqrt(F.col("beside") * F.col("alike"))) / (F.col("n") + NEIGHBOURS)
    return near.select("site", "path", "up", "over", "n", smooth.alias("ratio"))


def cut(counts: dict[int, int]) -> float:
    """The ratio that parts the histogram (bin: places) into two classes with the largest variance between them."""
    bins = sorted(counts)
    if len(bins) < 2:
        return 0.0
    n = np.array([counts[b] for b in bins], float)
    x = np.array(bins, float)
    left, sums = np.cumsum(n)[:-1], np.cumsum(n * x)[:-1]
    between = left * (n.sum() - left) * (sums / left - ((n * x).sum() - sums) / (n.sum() - left)) ** 2
    return math.expm1(bins[int(np.argmax(between)) + 1] / BINS)


def path_scores(parsed: DataFrame) -> DataFrame:
    """``site``, ``path``, ``value`` (the smoothed ratio, 0 below the threshold), ``held`` (mean sum of an element)."""
    ratios = staged(_ratios(parsed))
    bins = ratios.groupBy(F.floor(F.log1p("ratio") * BINS).cast("int").alias("bin")).agg(F.sum("n").alias("n")).collect()  # some hundred at most
    least = cut({r["bin"]: r["n"] for r in bins})
    value = F.when(F.col("ratio") >= least, F.col("ratio")).otherwise(F.lit(0.0))
    valued = ratios.withColumn("value", value)
    sums = valued.where("up <> 0").select("site", F.col("up").alias("path"), (F.col("value") * F.col("n")).alias("sum"))
    sums = sums.unionByName(valued.where("over <> 0").select("site", F.col("over").alias("path"), (F.col("value") * F.col("n") * DECAY).alias("sum")))
    sums = sums.groupBy("site", "path").agg(F.sum("sum").alias("sum"))
    held = F.array_distinct(F.flatten(F.array(_of_element("up"), _of_element("over"))))
    number = parsed.select("site", F.explode(held).alias("k"), "element").select("site", F.element_at("element", F.col("k") + 1).alias("path")).groupBy("site", "path").agg(F.count(F.lit(1)).alias("elements"))
    means = sums.join(number, ["site", "path"]).select("site", "path", (F.col("sum") / F.col("elements")).alias("held"))
    return valued.groupBy("site", "path").agg(F.max("value").alias("value")).join(means, ["site", "path"], "full").select("site", "path", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("held", F.lit(0.0)).alias("held"))


def _of_element(which: str) -> F.Column:
    """Numbers of the elements one level (``up``) or two (``over``) around a page's blocks."""
    parent = lambda k: F.element_at("parent", k + 1)
    up = F.filter(F.transform(F.array_distinct("block"), parent), lambda k: k >= 0)
    return up if which == "up" else F.filter(F.transform(F.array_distinct(up), parent), lambda k: k >= 0)


def _chosen(n_pages: int, parent: np.ndarray, of_parent: np.ndarray, value: np.ndarray, held: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Which places of several pages are content. Elements and places are numbered through; ``parent`` is -1 for roots,
    ``of_parent`` the page of each element."""
    m = len(parent)
    up = parent[block]
    over = np.where(up >= 0, parent[np.maximum(up, 0)], -1)
    own = np.bincount(np.maximum(up, 0), value * (up >= 0), m) + np.bincount(np.maximum(over, 0), value * (over >= 0) * DECAY, m)
    score = own ** (1 - SITE) * held**SITE
    best = np.lexsort((np.arange(m), -score, of_parent))  # the first of the highest of each page
    first = best[np.r_[True, of_parent[best][1:] != of_parent[best][:-1]]]
    inside = np.zeros(m, bool)
    inside[first[score[first] > 0]] = True
    while True:  # as deep as the elements are nested
        more = inside | (inside[np.maximum(parent, 0)] & (parent >= 0))
        if (more == inside).all():
            break
        inside = more
    return (value > 0) & (up >= 0) & inside[np.maximum(up, 0)]


def _selected(parsed: DataFrame, scores: DataFrame, repeated: int) -> DataFrame:
    """Chosen lines as ``key`` (site and letters), ``head`` (the page's title and first line), ``id``, ``line_no``. A key seen under enough
    heads in one block of pages comes as ``repeated`` rows with ``line_no`` -1 in place of its lines."""
    spark = parsed.sparkSession
    wanted = parsed.select("id", "site", "title", "parent", "element", "line", "block", "path", "letters")
    if scores.count() <= BROADCAST_PATHS:
        t = scores.select("path", "value", "held").toPandas().sort_values("path")
        shared = spark.sparkContext.broadcast((t["path"].to_numpy(np.int64), t["value"].to_numpy(), t["held"].to_numpy()))
    else:
        shared = None
        of_site = staged(scores.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("path", "value", "held"))).alias("s")).select("site", *(F.col(f"s.{c}").alias(f"s_{c}") for c in ("path", "value", "held"))))
        counts = parsed.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
        hot = F.broadcast(counts.where(F.col("n") >= HOT_SITE * parsed.count()).select("site"))
        apart = wanted.join(F.broadcast(of_site.join(hot, "site")), "site")
        wanted = apart.unionByName(wanted.join(hot, "site", "left_anti").join(of_site.hint("merge"), "site"))
    names = wanted.columns

    def lookup(b: pa.RecordBatch, keys: np.ndarray, of: np.ndarray, what: int) -> np.ndarray:
        if shared is not None:
            known, *values = shared.value
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            return np.where(known[at] == keys, values[what][at], 0.0)
        own = b.column(names.index("s_path"))
        rows = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
        known = {(r, k): v for r, k, v in zip(rows.tolist(), own.flatten().to_pylist(), b.column(names.index(("s_value", "s_held")[what])).flatten().to_pylist())}
        return np.array([known.get(x, 0.0) for x in zip(of.tolist(), keys.tolist())])

    def flat(b: pa.RecordBatch, c: str) -> np.ndarray:
        return b.column(names.index(c)).flatten().to_numpy(zero_copy_only=False)

    def lines(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        n = b.num_rows
        elements = np.diff(b.column(names.index("parent")).offsets.to_numpy()).astype(np.int64)
        places = np.diff(b.column(names.index("line")).offsets.to_numpy()).astype(np.int64)
        of_element, of_place = np.repeat(np.arange(n), elements), np.repeat(np.arange(n), places)
        begin = np.cumsum(elements) - elements
        parent = flat(b, "parent").astype(np.int64)
        parent = np.where(parent >= 0, parent + begin[of_element], -1)
        block = flat(b, "block") + begin[of_place]
        take = _chosen(n, parent, of_element, lookup(b, flat(b, "path"), of_place, 0), lookup(b, flat(b, "element"), of_element, 1), block)
        page, line, letters = of_place[take], flat(b, "line")[take].astype(np.int64), flat(b, "letters")[take].view(np.uint64)
        order = np.lexsort((line, page))
        page, line, letters = page[order], line[order], letters[order]
        new = np.r_[True, (page[1:] != page[:-1]) | (line[1:] != line[:-1])] if len(page) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        if not len(starts):
            return (np.zeros(0, np.int64),) * 4
        lettered = letters != 0
        k = np.add.reduceat(letters * np.uint64(_ODD) * lettered, starts)  # the letters of a line's places
        page, line = page[starts], line[starts]
        first = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
        head = np.repeat(k[first], np.diff(np.r_[first, len(page)])) ^ b.column(names.index("title")).to_numpy()[page].view(np.uint64)
        ids = b.column(names.index("id")).to_numpy()[page]
        site = b.column(names.index("site")).to_numpy()[page].view(np.uint64)
        alone = ids.view(np.uint64) * np.uint64(_ODD) + line.view(np.uint64) + np.uint64(1)  # a line without letters
        key = np.where(np.logical_or.reduceat(lettered, starts), k, alone) ^ (site * np.uint64(0xC2B2AE3D27D4EB4F))
        return key.view(np.int64), head.view(np.int64), ids, line

    schema = pa.schema([("key", pa.int64()), ("head", pa.int64()), ("id", pa.int64()), ("line_no", pa.int32())])

    def block(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, head, ids, line = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((head, key))
        key, head, ids, line = key[order], head[order], ids[order], line[order]
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_head = new_key | np.r_[True, head[1:] != head[:-1]]
        of = np.cumsum(new_key) - 1
        told = np.bincount(of, weights=new_head)[of] >= repeated
        rank = np.cumsum(new_head)
        rank = rank - rank[new_key][of] + 1
        stay = np.where(told, new_head & (rank <= repeated), True)
        columns = (key[stay], head[stay], np.where(told, 0, ids)[stay], np.where(told, -1, line)[stay].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                got = lines(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in whole.slice(start, 1024).columns], names=names))
                if len(got[0]):
                    held.append(got)
                    count += len(got[0])
                if count > 1_000_000:
                    yield block(held)
                    held, count = [], 0
        if held:
            yield block(held)

    return wanted.mapInArrow(run, "key long, head long, id long, line_no int")


def main_lines(pages: DataFrame, repeated: int = REPEATED) -> DataFrame:
    """Problem 4: ``id``, ``line_no`` (from 0) of every line of the main body.

    Null or empty pages have none; a page without any place of content has none; repeated rows of an id give one result.
    Pages are parsed once, into a staged table of their places. Statistics of paths are combined within splits; one
    shuffle of chosen lines by site and letters follows. A line met under ``repeated`` heads within a task leaves it as
    at most that many rows, so no site and no line gathers its pages in one task.
    """
    return _main_lines(staged(_parsed(pages)), repeated)


def main_text(pages: DataFrame, repeated: int = REPEATED) -> DataFrame:
    """``id``, ``text``: the visible text of the main body's lines, one row for each id; empty for a page without any, null for
    null. Lines are taken from the staged places, so no HTML is shuffled or read twice."""
    parsed = staged(_parsed(pages, True))
    named = _main_lines(parsed, repeated).groupBy("id").agg(F.collect_set("line_no").alias("named"))  # the lines of one page
    kept = F.filter(F.arrays_zip("at", "text"), lambda x: F.array_contains("named", x["at"]))
    texts = parsed.select("id", "at", "text").join(named, "id").groupBy("id").agg(F.max(F.array_join(F.transform(kept, lambda x: x["text"]), "\n")).alias("text"))
    every = pages.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.col("html").isNotNull()).alias("is"))
    return every.join(texts, "id", "left").select("id", F.coalesce("text", F.when(F.col("is"), "")).alias("text"))


def _main_lines(parsed: DataFrame, repeated: int) -> DataFrame:

    def keep(t: dict[str, np.ndarray]) -> np.ndarray:
        order = np.lexsort((t["head"], t["key"]))
        key, head = t["key"][order], t["head"][order]
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_head = new_key | np.r_[True, head[1:] != head[:-1]]
        group = np.cumsum(new_key) - 1
        heads = np.bincount(group, weights=new_head)
        wanted = np.empty(len(order), bool)
        wanted[order] = heads[group] < repeated
        return wanted & (t["line_no"] >= 0)

    scores = staged(path_scores(parsed))
    return reduce_sorted(_selected(parsed, scores, repeated), "key", keep, ["id", "line_no"]).distinct()
