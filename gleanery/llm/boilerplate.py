"""Main content of pages by tag-path ratios, over the lines of plain-text pages."""

from __future__ import annotations

import gc
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.scale import heavy_limit, hot_cold_join, materialise

#: What parts the items of a row of links.
PARTS = re.compile(r"\s*[|/·•>»›]\s*|\s+[-–—]\s+|\t+|\s{2,}|::")
BULLET = re.compile(r"^(?:[-*•–]|\d+[.)])\s+")
#: A line that ends like a sentence; a reference in brackets may follow.
SENTENCE_END = re.compile(r"[.!?…][\"'»”)\]]*(?:\s*[\[(][^\])]*[\])])?$")
SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+")
WORD = re.compile(r"[^\W\d_]+|\d+|[§¤]")
NUMBER = re.compile(r"\d+")
SITE = re.compile(r"(?:[a-zA-Z][\w+.-]*://)?(?:www\.)?([^/:?#\s.]+)")
TITLE_TAIL = re.compile(r"\s+(?:\||::|-|–|»|·)\s+")

FORMS = ("query", "row", "item", "word", "label", "named", "title", "sentence", "short")
QUERY, ROW, ITEM, ONE_WORD, LABEL, NAMED, TITLE, SENTENCE_FORM, SHORT = range(9)
#: Forms of a line that may be a link, a heading or a notice, but no running text.
LINKS = (ONE_WORD, LABEL, NAMED, TITLE)

#: Kinds of leaf paths: the whole line, what precedes its first colon, one of its sentences, how a piece without an end begins, and the line as if it preceded a colon,
#: and its first word likewise.
WHOLE, PREFIX, SENTENCE, START, HEADING, FIRST = range(6)
#: Between these shares of the pages lies the emptiest part of the distribution of paths, which parts furniture from content; and the same for nodes' ratios.
SHARES, STRICT_SHARES, RATIOS = (0.01, 0.04), (0.02, 0.05), (0.88, 0.98)
#: Margin for chance, in root counts: items and sentences are more alike by chance than other lines.
LOOSE, STRICT = 1.2, 2.0
#: Least lines of a node whose ratio counts.
NODE_LINES = 20


def site_of(url: str | None) -> str:
    m = SITE.match((url or "").strip().lower())
    return m.group(1) if m else ""


def title_of(title: str | None) -> str:
    return TITLE_TAIL.split(" ".join((title or "").lower().split()))[0]


def form_of(line: str) -> int:
    """query, row, item, word, label (`X: Y`), named (`X: y`), title, sentence or short."""
    if line[0] == "#":
        return QUERY
    if SENTENCE_END.search(line):
        return SENTENCE_FORM if line.count(" ") >= 16 or len(WORD.findall(line)) >= 6 else SHORT
    if len([x for x in PARTS.split(line) if x]) >= 3:
        return ROW
    if BULLET.match(line) or line[0].islower():
        return ITEM
    if len(WORD.findall(line)) <= 2:
        return ONE_WORD
    if ": " in line:
        return LABEL if line.split(": ", 1)[1][:1].isupper() else NAMED
    return TITLE


def key_of(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path)


def masked(low: str, digits: bool, site: str, title: str) -> str:
    """The line in lower case, with signs for the page's title, its site's name and numbers."""
    if len(title) > 3 and title in low:
        low = low.replace(title, "¤")
    if len(site) > 3 and site in low:
        low = low.replace(site, "§")
    return NUMBER.sub("0", low) if digits else low


def leaf_paths(m: str, form: int) -> list[tuple[int, str]]:
    """[(kind, path)] of a masked line; a path's root is its class of form: strict (s), loose (l) or prefixes (p, n)."""
    paths = [(WHOLE, f"{'s' if form in (ITEM, SENTENCE_FORM) else 'l'}>{m}")]
    if form != SENTENCE_FORM and ": " in m:
        paths.append((PREFIX, f"p>{m.split(': ', 1)[0]}"))
    if ". " in m or "! " in m or "? " in m:
        pieces = SENTENCE_GAP.split(m)
        if len(pieces) > 1:
            paths += [(SENTENCE, f"s>{p}") for p in pieces]
            if form not in (SENTENCE_FORM, SHORT, ITEM):  # a piece without an end: buttons may follow its words in any order
                begin = pieces[-1].split()[:4]
                if len(begin) == 4:
                    paths.append((START, f"n>{' '.join(begin)}"))
    if form in (ONE_WORD, TITLE):
        paths.append((HEADING, f"p>{m}"))
        if " " in m:
            paths.append((FIRST, f"p>{m.split(' ', 1)[0]}"))
    return paths


def node_paths(m: str, form: int) -> list[str]:
    """The inner nodes above a link-like line, from the root: its form, then its first word, then its first two, and its first and last."""
    words = WORD.findall(m)
    if not words:
        return []
    return [f"{FORMS[form]}>{words[0]}", f"{FORMS[form]}>{words[0]}>{words[1] if len(words) > 1 else ''}", f"{FORMS[form]}>{words[0]}>..>{words[-1]}"]


PAGE_SCHEMA = (
    "eid string, site long, line_no array<int>, form array<tinyint>, own array<tinyint>, weight array<int>, node array<long>,"
    " at array<int>, kind array<tinyint>, chars array<int>, fresh array<boolean>, path array<long>"
)
_LISTS = [pa.int32(), pa.int8(), pa.int8(), pa.int32(), pa.int64(), pa.int32(), pa.int8(), pa.int32(), pa.bool_(), pa.int64()]
#: A mark of punctuation tells as much of running text as so many letters.
MARK = 10
#: Nodes a line has at most; 0 stands for none.
NODES = 3


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page as the paths of its lines. What is kept in memory holds no cycles, so the collector need not walk through it."""
    gc.disable()
    try:
        yield from _parsed(batches)
    finally:
        gc.enable()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text is read and matched once, and a line that comes again is known."""
    shapes: dict[str, tuple] = {}
    memory: dict[str, tuple] = {}

    def shape(line: str) -> tuple:
        if len(shapes) > 100_000:  # content never ends
            shapes.clear()
        low = " ".join(line.lower().split())
        marks = low.count(".") + low.count(",") + low.count(";") + low.count(":") + low.count("!") + low.count("?")
        shapes[line] = found = (form_of(line), low, NUMBER.search(low) is not None, len(low) + MARK * marks)
        return found

    def paths_of(known: str, m: str, form: int) -> tuple:
        if len(memory) > 100_000:
            memory.clear()
        kinds, leaves = zip(*leaf_paths(m, form))
        nodes = [_signed(key_of(p)) for p in node_paths(m, form)] if form in LINKS else []
        counted = [k < HEADING for k in kinds]
        memory[known] = found = (kinds, [_signed(key_of(p)) for p in leaves], [len(p) for p in leaves], counted, nodes + [0] * (NODES - len(nodes)))
        return found

    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            eids, sites, out, ends, path_ends = [], [], [[] for _ in _LISTS], [0], [0]
            numbers, forms, owns, weights, nodes, ats, kinds, chars, fresh, paths = out
            for eid, url, title, body in zip(*(c.to_pylist() for c in batch.slice(start, 1000).columns)):
                site, title, seen, n = site_of(url), title_of(title), set(), 0
                near = 8 + len(site)
                for no, raw in enumerate(body.split("\n")):
                    line = raw.strip()
                    if not line:
                        continue
                    form, low, digits, weight = shapes.get(line) or shape(line)
                    m = masked(low, digits, site, title)
                    known = f"{form}{m}"
                    mine, keys, sizes, counted, inner = memory.get(known) or paths_of(known, m, form)
                    numbers.append(no)
                    forms.append(form)
                    owns.append(0 if m[0] != "¤" and m[0] not in " ." else 2 if m.strip(" .") == "¤" else 1 if m[0] == "¤" and len(m) < near else 0)  # the page's own title, or it with the site's name
                    weights.append(weight)
                    nodes += inner
                    kinds += mine
                    chars += sizes
                    paths += keys
                    if len(keys) == 1:
                        ats.append(n)
                        fresh.append(keys[0] not in seen)
                        seen.add(keys[0])
                    else:
                        ats += [n] * len(keys)
                        for k, c in zip(keys, counted):
                            fresh.append(c and k not in seen)
                            if c:
                                seen.add(k)
                    n += 1
                eids.append(eid)
                sites.append(_signed(key_of(site)))
                ends.append(len(numbers))
                path_ends.append(len(ats))
            cols = [pa.array(eids, pa.string()), pa.array(sites, pa.int64())]
            for i, (values, kind) in enumerate(zip(out, _LISTS)):
                offsets = np.array(ends) * (NODES if i == 4 else 1) if i < 5 else np.array(path_ends)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind)))
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PAGE_SCHEMA.split(", ")])


def within(path: np.ndarray, site: np.ndarray) -> np.ndarray:
    """The key of a path below its site."""
    with np.errstate(over="ignore"):
        z = path.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ site.astype(np.uint64)
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (z ^ (z >> np.uint64(29))).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, site, strict, k): pages of a site that have a path, each path once a page, summed within a batch."""
    for batch in batches:
        lists = batch.column("path").value_lengths().to_numpy()
        site = np.repeat(batch.column("site").to_numpy(), lists)
        fresh = batch.column("fresh").flatten().to_numpy(zero_copy_only=False)
        path, kind = batch.column("path").flatten().to_numpy()[fresh], batch.column("kind").flatten().to_numpy()[fresh]
        at = batch.column("at").flatten().to_numpy()[fresh]
        form = batch.column("form").flatten().to_numpy()
        first = np.repeat(np.r_[0, np.cumsum(batch.column("form").value_lengths().to_numpy())][:-1], lists)[fresh]
        strict = (kind == SENTENCE) | ((kind == WHOLE) & np.isin(form[first + at], (ITEM, SENTENCE_FORM)))
        pair = within(path, site[fresh])
        _, one, k = np.unique(pair, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(path[one]), pa.array(site[fresh][one]), pa.array(strict[one]), pa.array(k)], names=["path", "site", "strict", "k"])


class Pages:
    """A batch of parsed pages as flat arrays, with the verdict of the leaf paths: 1 furniture, 0 not.

    `found` holds the keys of furniture paths, or is None where each page brings its own in the column `found`.
    """

    def __init__(self, batch: pa.RecordBatch, found: np.ndarray | None):
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        self.size = batch.column("form").value_lengths().to_numpy()
        self.ends = np.r_[0, np.cumsum(self.size)]
        self.form, self.own, self.weight, self.node = flat("form"), flat("own"), flat("weight"), flat("node").reshape(-1, NODES)
        many = batch.column("at").value_lengths().to_numpy()
        line = flat("at") + np.repeat(self.ends[:-1], many)
        kind, chars, path = flat("kind"), flat("chars").astype(np.float64), flat("path")
        page = np.repeat(np.arange(len(many)), many)
        if found is None:
            own = batch.column("found")
            found = np.unique(within(own.flatten().to_numpy(), np.repeat(np.arange(len(many)), own.value_lengths().fill_null(0).to_numpy())))
            hits = lambda keys, of: _among(within(keys, of), found)
        else:
            hits = lambda keys, of: _among(keys, found)
        hit = hits(path, page) | hits(within(path, batch.column("site").to_numpy()[page]), page)
        self.known = np.isin(self.form, LINKS) & (self.own < 2) & hits(self.node.ravel(), np.repeat(np.arange(len(many)), self.size * NODES)).reshape(-1, NODES).any(axis=1)
        begun = np.flatnonzero((kind == START) & hit)
        hit[begun - 1] = True  # the piece of which it is the start
        n = len(self.form)
        count = lambda on: np.bincount(line[on], minlength=n) > 0
        piece = kind == SENTENCE
        covered = np.bincount(line[piece & hit], chars[piece & hit], n) >= 0.5 * np.maximum(1, np.bincount(line[piece], chars[piece], n))
        self.head = count((kind == HEADING) & hit)
        verdict = (self.form == ROW) | count(hit & np.isin(kind, (WHOLE, PREFIX, FIRST, START))) | covered | self.head
        self.verdict = np.where((self.own > 0) | (self.form == QUERY), 0, verdict).astype(np.int8)

    def judged(self) -> np.ndarray:
        """Leaves and inner nodes fused: what the paths of whole lines leave open, the ratios of the nodes above decide."""
        return self.smoothed(np.maximum(self.smoothed(self.verdict), self.known))

    def smoothed(self, verdict: np.ndarray) -> np.ndarray:
        """The verdict of each line from those around it."""
        out, link = verdict.tolist(), np.isin(self.form, LINKS).tolist()
        form, own, head = self.form.tolist(), self.own.tolist(), self.head.tolist()
        text = np.isin(self.form, (SENTENCE_FORM, ITEM, QUERY, SHORT)).tolist()
        for a, b in zip(self.ends.tolist(), self.ends.tolist()[1:]):
            # titles under a heading of a list of links belong to it
            listed = False
            for i in range(a, b):
                if head[i]:
                    listed = True
                elif listed and link[i] and own[i] < 2:
                    out[i] = 1
                else:
                    listed = False
            body = [i for i in range(a, b) if not out[i] and text[i]]
            # what stands before the page's own title is furniture, unless running text does
            title = next((i for i in range(a, b) if own[i]), a)
            if not body or body[0] > title:
                out[a:title] = [1] * (title - a)
            # so are links after the last text from the first furniture on
            seen = False
            for i in range(body[-1] + 1 if body else b, b):
                if out[i]:
                    seen = True
                elif seen and link[i] and own[i] < 2:
                    out[i] = 1
        return np.array(out, np.int8)


def _among(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ones found."""
    if not len(found):
        return np.zeros(len(keys), bool)
    return found[np.minimum(np.searchsorted(found, keys), len(found) - 1)] == keys




def _nodes(found: np.ndarray | None):
    """(node, furniture, all, lines): text of the link-like lines under each inner node, with punctuation as text, and what of it the leaves call furniture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = Pages(batch, found)
            verdict = pages.smoothed(pages.verdict)
            on = np.isin(pages.form, LINKS) & (pages.own < 2)
            node, weight, bad = pages.node[on].ravel(), np.repeat(pages.weight[on], NODES), np.repeat(verdict[on], NODES)
            key, inverse, lines = np.unique(node, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(np.bincount(inverse, weight * bad, len(key))), pa.array(np.bincount(inverse, weight, len(key))), pa.array(lines)],
                names=["node", "furniture", "whole", "lines"],
            )

    return run


def _judge(found: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = Pages(batch, found)
            eid = batch.column("eid").take(pa.array(np.repeat(np.arange(batch.num_rows), pages.size)))
            yield pa.RecordBatch.from_arrays([eid, batch.column("line_no").flatten(), pa.array(pages.judged() == 0)], names=["eid", "line_no", "content"])

    return run


def valley(values: DataFrame, value: str, weight: str, lo: float, hi: float, steps: int = 8) -> float:
    """The middle of the emptiest of `steps` equal parts between lo and hi, by the summed weights of the values there and in the parts beside it."""
    step = (hi - lo) / steps
    at = F.floor((F.col(value) - lo) / step).cast("int")
    rows = values.select(at.alias("at"), F.col(weight).alias("w")).filter((F.col("at") >= -1) & (F.col("at") <= steps)).groupBy("at").agg(F.sum("w").alias("w")).collect()
    had = {r["at"]: float(r["w"]) for r in rows}
    filled = [had.get(i - 1, 0.0) / 2 + had.get(i, 0.0) + had.get(i + 1, 0.0) / 2 for i in range(steps)]
    # of equally empty parts those in the middle
    least = [i for i, w in enumerate(filled) if w == min(filled)]
    return lo + (least[len(least) // 2] + 0.5) * step


def furniture_paths(pages: DataFrame) -> DataFrame:
    """(key, rows): the leaf paths that more pages share than content does, in the whole collection or below one site."""
    per = pages.select("site", "form", "at", "kind", "fresh", "path").mapInArrow(_counts, "path long, site long, strict boolean, k long")
    per = materialise(per.groupBy("path", "site").agg(F.first("strict").alias("strict"), F.sum("k").alias("k")))
    # few sites may own most paths, so these are met where they lie
    sizes = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages")).join(per.groupBy("site").agg(F.count(F.lit(1)).alias("paths")), "site")
    per = hot_cold_join(per, sizes, "site", "paths", heavy_limit(per.count(), pages.sparkSession))
    margin = F.when(F.col("strict"), STRICT).otherwise(LOOSE)
    ratio = lambda n: F.log10((F.col(n) - margin * F.sqrt(n)) / F.col("pages")).alias("ratio")
    whole = per.groupBy("path", "strict").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("sites"), F.sum("pages").alias("pages"))
    whole = materialise(whole.filter((F.col("n") >= 3) & (F.col("sites") >= 2)).select("path", "strict", "n", ratio("n")))
    local = materialise(per.filter(F.col("k") >= 3).select("path", "site", "strict", F.col("k").alias("n"), ratio("k")))
    gap = lambda rows, between: valley(rows, "ratio", "n", *(math.log10(x) for x in between))
    apart = {False: gap(whole.filter(~F.col("strict")), SHARES), True: gap(whole.filter("strict"), STRICT_SHARES)}
    # one site's lists of links have no gap of their own; its sentences have
    below = gap(local.filter("strict"), STRICT_SHARES)
    whole = whole.filter(F.col("ratio") >= F.when(F.col("strict"), apart[True]).otherwise(apart[False]))
    local = local.filter(F.col("ratio") >= below).select(F.col("path"), "site", "n")
    keyed = local.mapInArrow(_within, "key long, rows long")
    return materialise(whole.select(F.col("path").alias("key"), F.col("n").alias("rows")).unionByName(keyed).groupBy("key").agg(F.max("rows").alias("rows")))


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(within(b.column(0).to_numpy(), b.column(1).to_numpy())), b.column(2)], names=["key", "rows"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(eid, key): the distinct paths and nodes of each page, paths also below their site."""
    for batch in batches:
        lists = batch.column("path").value_lengths().to_numpy()
        path, page = batch.column("path").flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists)
        node = batch.column("node")
        key = np.concatenate([path, within(path, batch.column("site").to_numpy()[page]), node.flatten().to_numpy()])
        page = np.concatenate([page, page, np.repeat(np.arange(batch.num_rows), node.value_lengths().to_numpy())])
        _, one = np.unique(within(key, page), return_index=True)
        yield pa.RecordBatch.from_arrays([batch.column("eid").take(pa.array(page[one])), pa.array(key[one])], names=["eid", "key"])


def _with_found(pages: DataFrame, found: DataFrame, broadcast_rows: int) -> tuple[DataFrame, np.ndarray | None]:
    """(pages, keys): the keys themselves where they are few enough to travel with the function (8 bytes each), else each page with its own."""
    if found.count() <= broadcast_rows:
        return pages, np.sort(np.array([r["key"] for r in found.select("key").distinct().collect()], np.int64))
    hit = hot_cold_join(pages.select("eid", "site", "node", "path").mapInArrow(_keys, "eid string, key long"), found, "key", "rows")
    return pages.join(hit.groupBy("eid").agg(F.collect_list("key").alias("found")), "eid", "left"), None


def page_lines(df: DataFrame, id_col: str, url_col: str, title_col: str, body_col: str, broadcast_rows: int = 500_000) -> DataFrame:
    """Which of a page's lines are its own content: (eid, line_no, content), a row for each non-blank line.

    Line numbers count from 0 after splitting at LF. Pages without id or text give no row; each row of df is a page of its
    own id. Null urls count as one site without a name, null titles as none.

    Plain text has no tags, so the root-to-leaf path of a line is: its form (row of links, item, sentence, ..), then its words, ending in the whole text with the
    site's name, the page's title and numbers masked; parts before a colon and single sentences are leaves too. Over the whole collection:

    * The ratio of a leaf is the number of pages that have it, less a margin for chance, to the pages of the sites that have it, and the same below each site. The
      emptiest part of the distribution of these ratios parts furniture from content. A line of several sentences is furniture if most of its text is.
    * The ratio of an inner node is that part of the text under it, in letters and punctuation, which its leaves and their surroundings call furniture; it
      decides the lines that leaves leave open, again from the emptiest part of the distribution on.
    * The verdicts are smoothed along the page: links under the heading of a list of links, before the page's own title, and after its last text.

    All pages count for all of this. Keys of furniture paths go to the tasks up to `broadcast_rows`, beyond that they meet the pages' paths by a join.
    """
    slim = df.select(F.col(id_col).cast("string").alias("eid"), F.col(url_col).alias("url"), F.col(title_col).alias("title"), F.col(body_col).alias("body"))
    slim = slim.filter(F.col("eid").isNotNull() & (F.length("body") > 0))
    pages = materialise(slim.mapInArrow(_parse, PAGE_SCHEMA))
    leaves = furniture_paths(pages)
    own, keys = _with_found(pages, leaves, broadcast_rows)
    nodes = own.mapInArrow(_nodes(keys), "node long, furniture double, whole double, lines long").filter(F.col("node") != 0).groupBy("node")
    nodes = nodes.agg((F.sum("furniture") / F.sum("whole")).alias("ratio"), F.sum("whole").alias("text"), F.sum("lines").alias("rows")).filter(F.col("rows") >= NODE_LINES)
    nodes = materialise(nodes)
    least = valley(nodes, "ratio", "text", *RATIOS)
    found = materialise(leaves.unionByName(nodes.filter(F.col("ratio") >= least).select(F.col("node").alias("key"), "rows")))
    own, keys = _with_found(pages, found, broadcast_rows)
    return own.mapInArrow(_judge(keys), "eid string, line_no int, content boolean")
