"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

1. Every page is read into structural tokens and text runs (``html_pages``).  A token's occurrence
   vector is how often it occurs on each page of its host; it is kept as an order-free 128-bit sum.
2. Tokens of one host with equal vectors form an equivalence class; classes of two tokens or more
   on at least half of the host's pages are candidates.  A class is valid when its tokens come in
   one order on the pages and its occurrences nest with those of the other classes; the valid
   classes, nested, are the host's template.  A text run may be a template token outside articles
   only, since copies of an article share it.
3. What stands between template tokens are slots.  The slots' text over all pages of the host says
   which of them hold the article; their runs on each page are its text.

Pages of frequent hosts meet their host's template by broadcast, the others by a shuffle, so no host
is put into one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm import html_pages as P
from fidelis.session import checkpoint_dir

#: A host with this share of all pages or more is frequent: there are 1 / FREQUENT at most.
FREQUENT = 1e-3
#: Templates of frequent hosts are broadcast while they hold this many tokens and slots together at most.
BROADCAST_TOKENS = 1_000_000
#: A class is valid when it is out of order or not nested on no more than this share of its pages.
TOLERANCE = 0.05
#: A text run is a template token only on so many pages.
TEXT_PAGES = 3
#: Share of a host's plain text that the article's element must hold where no name tells it.
DOMINANT = 0.5
NO_SLOT = 0
Template = dict[int, tuple[int, int, int]]  # token -> (class, place in the class, size of the class)


def host_of(url: str = "url"):
    """Lower-case host of a URL; a null URL, or one without a host, has the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


# ------------------------------------------------------------------ one page

class Walk:
    """Where a page stands in its host's template: the open occurrences of classes, innermost last.

    A class that is out of order, or whose occurrence is cut by another's, is put into ``broken``;
    of two that overlap, that with the lower rank (the later class number) is blamed.
    """

    def __init__(self, template: Template):
        self.template, self.stack, self.broken, self.seen = template, [], set(), set()

    def token(self, token: int) -> None:
        found = self.template.get(token)
        if found is None:
            return
        of, place, size = found
        self.seen.add(of)
        stack = self.stack
        if place == 0:
            stack.append([of, 1, size])
            return
        while stack and not (stack[-1][0] == of and stack[-1][1] == place):
            if not any(x[0] == of and x[1] == place for x in stack):
                self.broken.add(of)
                return
            top = stack.pop()  # left open inside this occurrence
            self.broken.add(max(top[0], of) if top[0] != of else of)
        if not stack:
            self.broken.add(of)
            return
        stack[-1][1] += 1
        if stack[-1][1] == size:
            stack.pop()

    def slot(self) -> int:
        return P.hashed("slot", self.stack[-1][0], self.stack[-1][1]) if self.stack else NO_SLOT

    def end(self) -> None:
        self.broken.update(x[0] for x in self.stack)


def template_of(tokens: list[dict] | None) -> Template:
    return {t["token"]: (t["class"], t["place"], t["size"]) for t in tokens or ()}


def chosen_runs(source: str, template: Template, level: int, slots: set[int], box: int) -> list[P.Run]:
    """The page's runs in the host's article slots; of a page that has none there, those its own names
    or its dominant box tell."""
    events, runs, boxes = P.read_page(source)
    walk, mine, constant = Walk(template), [], set()
    for e in events:
        if isinstance(e, int):
            walk.token(e)
        else:
            if e.node.level < P.OF_MAIN and not e.node.bad and e.size and template:
                token = e.token()
                if token in template:
                    walk.token(token)
                    constant.add(id(e))
            if level and not e.node.bad and e.node.level >= level and walk.slot() in slots:
                mine.append(e)
    if any(r.size for r in mine):
        return mine
    free = [r for r in runs if not r.node.bad and id(r) not in constant]
    own = max((r.node.level for r in free if r.size), default=0)
    if own:
        return [r for r in free if r.node.level >= own]
    here = [n for n in boxes if n.path == box] if box else []
    if not here:
        total = sum(r.size for r in free if not r.node.link)
        here = [n for n in (max((n for n in boxes if n.chars >= DOMINANT * total), key=lambda n: n.depth, default=None),) if n and total]
    within = {id(n): True for n in here}

    def inside(node: P.Node | None) -> bool:
        trail = []
        while node is not None and id(node) not in within:
            trail.append(node)
            node = node.parent
        found = node is not None and within[id(node)]
        within.update((id(x), found) for x in trail)
        return found

    return [r for r in free if inside(r.node)] if here else free


# ------------------------------------------------------------------ tables

def read_streams(pages: DataFrame, html_col: str) -> DataFrame:
    """Each page as its stream: structural tokens and text runs in order, and the text under its boxes.

    ``tokens`` with ``sizes`` (-1: structural; else a run's characters), ``levels`` (-1: boilerplate by name) and
    ``kinds`` (distinct tokens) with ``counts``; ``boxes``, ``depths`` and ``chars``.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                rows = []
                for source in part.column(2).to_pylist():
                    events, _, boxes = P.read_page(source or "")
                    tokens, sizes, levels, counts = [], [], [], {}
                    for e in events:
                        if isinstance(e, int):
                            token, size, level = e, -1, 0
                        elif e.size:
                            token, size, level = e.token(), e.size, -1 if e.node.bad else e.node.level
                        else:
                            continue
                        tokens.append(token)
                        sizes.append(size)
                        levels.append(level)
                        if size < 0 or 0 <= level < P.OF_MAIN:
                            key = (token, size < 0)
                            counts[key] = counts.get(key, 0) + 1
                    at: dict[int, list[int]] = {}
                    for n, c in boxes.items():
                        if c:
                            at.setdefault(n.path, [n.depth, 0])[1] += c
                    rows.append((tokens, sizes, levels, [k[0] for k in counts], [k[1] for k in counts], list(counts.values()), list(at), [v[0] for v in at.values()], [v[1] for v in at.values()]))
                kinds = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int8(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]],
                                                 names=["row", "host", "tokens", "sizes", "levels", "kinds", "structural", "counts", "boxes", "depths", "chars"])

    return pages.select("row", "host", html_col).mapInArrow(
        batches, "row bigint, host string, tokens array<bigint>, sizes array<int>, levels array<tinyint>, kinds array<bigint>, structural array<boolean>, counts array<int>, "
        "boxes array<bigint>, depths array<int>, chars array<bigint>")


def equivalence_classes(streams: DataFrame, hosts: DataFrame) -> DataFrame:
    """Candidate classes: one row per host and token (host, token, class, place, size).

    The vector of a token is kept as two order-free sums over (page, count); classes are numbered from
    the widest on (pages, then tokens), and a class's tokens take the order of the first page that has them.
    """
    token = streams.select("host", "row", F.posexplode(F.arrays_zip("kinds", "structural", "counts")).alias("pos", "x"))
    vectors = token.groupBy("host", F.col("x.kinds").alias("token"), F.col("x.structural").alias("structural")).agg(
        F.bit_xor(F.xxhash64("row", "x.counts")).alias("v1"), F.bit_xor(F.xxhash64("x.counts", F.lit(1), "row")).alias("v2"),
        F.count(F.lit(1)).alias("pages"), F.min(F.struct("row", "pos")).alias("first"))
    often = vectors.where(F.col("structural") | (F.col("pages") >= TEXT_PAGES)).join(hosts, "host").where(F.col("pages") * 2 >= F.col("n_pages"))
    members = often.groupBy("host", "v1", "v2").agg(F.max("pages").alias("pages"), F.count(F.lit(1)).alias("size"),
                                                    F.sort_array(F.collect_list(F.struct("first.pos", "token"))).alias("members"))
    # classes of a host hold no more tokens than twice its mean page
    ranked = members.where("size >= 2").groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("p"), (-F.col("size")).alias("s"), "v1", "v2", "members"))).alias("c"))
    one = ranked.select("host", F.posexplode("c").alias("class", "c")).select("host", "class", F.posexplode("c.members").alias("place", "m"), F.size("c.members").alias("size"))
    return one.select("host", F.col("m.token").alias("token"), "class", "place", "size")


def with_host(pages: DataFrame, table: DataFrame, frequent: DataFrame, small: bool) -> DataFrame:
    """``pages`` with the columns of ``table`` (one row a host; null where it has none): rows of frequent
    hosts by broadcast when their part of the table is small, all others by a shuffle."""
    if not small:
        return pages.join(table, "host", "left")
    hot = F.broadcast(frequent)
    usual = pages.join(hot, "host", "left_anti").join(table.join(hot, "host", "left_anti"), "host", "left")
    return pages.join(hot, "host", "left_semi").join(F.broadcast(table.join(hot, "host", "left_semi")), "host", "left").unionByName(usual)


def tokens_by_host(classes: DataFrame, name: str = "template") -> DataFrame:
    return classes.groupBy("host").agg(F.collect_list(F.struct("token", "class", "place", "size")).alias(name))


def _per_page(joined: DataFrame, rows: Callable, schema: str) -> DataFrame:
    """``rows(column lists)`` for each batch of pages with their streams and templates."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates: dict[str, Template] = {}
        for b in it:
            found = []
            hosts = b.column("host").to_pylist()
            own = b.column("template")
            for k, (host, tokens, sizes, levels) in enumerate(zip(hosts, *(b.column(c).to_pylist() for c in ("tokens", "sizes", "levels")))):
                if host not in templates:
                    if len(templates) >= 200:
                        templates.clear()
                    templates[host] = template_of(own[k].as_py())
                found += rows(host, tokens, sizes, levels, templates[host])
            names = [c.strip().split(" ")[0] for c in schema.split(",")]
            kinds = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[c.strip().split(" ")[1]] for c in schema.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=names)

    return joined.select("host", "tokens", "sizes", "levels", "template").mapInArrow(batches, schema)


def class_faults(joined: DataFrame) -> DataFrame:
    """(host, class, pages, faults): on how many pages each class occurs, and is out of order or not nested."""
    def rows(host, tokens, sizes, levels, template):
        walk = Walk(template)
        for t in tokens:
            walk.token(t)
        walk.end()
        return [(host, c, 1, int(c in walk.broken)) for c in walk.seen]
    return _per_page(joined, rows, "host string, class int, pages bigint, faults bigint").groupBy("host", "class").agg(F.sum("pages").alias("pages"), F.sum("faults").alias("faults"))


def slot_text(joined: DataFrame) -> DataFrame:
    """(host, slot, level, chars): the text in each slot of each host's template, boilerplate by name left out."""
    def rows(host, tokens, sizes, levels, template):
        walk, chars = Walk(template), {}
        for t, size, level in zip(tokens, sizes, levels):
            if size < 0 or 0 <= level < P.OF_MAIN:
                walk.token(t)
            if size > 0 <= level and not (level < P.OF_MAIN and t in template):
                key = (walk.slot(), level)
                chars[key] = chars.get(key, 0) + size
        return [(host, s, v, c) for (s, v), c in chars.items()]
    return _per_page(joined, rows, "host string, slot bigint, level int, chars bigint").groupBy("host", "slot", "level").agg(F.sum("chars").alias("chars"))


def article_slots(text: DataFrame) -> DataFrame:
    """(host, level, slots): the level of naming that holds most named text, and the slots most of whose text has it."""
    named = text.where("level > 0").groupBy("host", "level").agg(F.sum("chars").alias("c")).groupBy("host").agg(F.max(F.struct("c", "level")).alias("best"))
    per = text.join(named.select("host", F.col("best.level").alias("top")), "host")
    slots = per.groupBy("host", "slot", "top").agg(F.sum("chars").alias("all"), F.sum(F.when(F.col("level") >= F.col("top"), F.col("chars")).otherwise(0)).alias("own"))
    return slots.groupBy("host", F.col("top").alias("level")).agg(F.collect_list(F.when(F.col("own") * 2 >= F.col("all"), F.col("slot"))).alias("slots"))


def dominant_boxes(streams: DataFrame) -> DataFrame:
    """(host, box): the deepest box that holds ``DOMINANT`` of the host's plain text."""
    boxes = streams.select("host", F.explode(F.arrays_zip("boxes", "depths", "chars")).alias("x")).groupBy("host", F.col("x.boxes").alias("box")).agg(
        F.max("x.depths").alias("depth"), F.sum("x.chars").alias("chars"))
    most = boxes.groupBy("host").agg(F.max("chars").alias("most"))
    return boxes.join(most, "host").where(F.col("chars") >= DOMINANT * F.col("most")).groupBy("host").agg(F.max(F.struct("depth", "chars", "box")).alias("x")).select("host", F.col("x.box").alias("box"))


def deduce_templates(streams: DataFrame, hosts: DataFrame, frequent: DataFrame, folder: str) -> DataFrame:
    """One row per host: its valid classes as ``template``, and which level, slots and box hold the article."""
    spark = streams.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    classes = kept(equivalence_classes(streams, hosts), "classes")
    small = classes.join(F.broadcast(frequent), "host", "left_semi").count() <= BROADCAST_TOKENS
    faults = class_faults(with_host(streams, tokens_by_host(classes), frequent, small))
    valid = faults.where(F.col("faults") <= TOLERANCE * F.col("pages")).select("host", "class")
    template = kept(tokens_by_host(classes.join(valid, ["host", "class"], "left_semi")), "template")
    text = slot_text(with_host(streams, template, frequent, small))
    found = hosts.select("host").join(template, "host", "left").join(article_slots(text), "host", "left").join(dominant_boxes(streams), "host", "left")
    return kept(found, "found")


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: (id, url, text, n_chars), one row for each row of ``pages``.

    Of a null or empty page, or one without an article, the text is empty.  Repeated rows give a
    row each; pages of one host with one article all keep it.  An empty table gives no rows.  A
    very long page is read whole in one task (some hundred bytes an element).  A host with a
    single page has a template of its own tags.  Text is kept whole: named boilerplate, and runs
    that a host repeats outside articles, are all that is left out of the article's element.
    """
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/html-{uuid.uuid4().hex}"
    kind = dict(pages.dtypes)[id_col]
    read = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host_of(url_col).alias("host"),
                        F.monotonically_increasing_id().alias("row"))
    read_streams(read, "html").write.option("compression", "zstd").parquet(f"{folder}/streams")
    streams = spark.read.parquet(f"{folder}/streams")
    streams.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).write.parquet(f"{folder}/hosts")
    hosts = spark.read.parquet(f"{folder}/hosts")
    total = hosts.agg(F.sum("n_pages")).first()[0] or 0
    frequent = hosts.where(F.col("n_pages") >= max(1.0, FREQUENT * total)).select("host")
    found = deduce_templates(streams, hosts, frequent, folder)
    hot = found.join(F.broadcast(frequent), "host", "left_semi")
    small = (hot.agg(F.sum(F.coalesce(F.size("template"), F.lit(0)) + F.coalesce(F.size("slots"), F.lit(0)))).first()[0] or 0) <= BROADCAST_TOKENS
    joined = with_host(read.drop("row"), found, frequent, small)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in it:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                texts = []
                for k, (host, source) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist())):
                    if host not in known:
                        if len(known) >= 200:
                            known.clear()
                        known[host] = (template_of(part.column("template")[k].as_py()), part.column("level")[k].as_py() or 0,
                                       set(part.column("slots")[k].as_py() or ()), part.column("box")[k].as_py() or 0)
                    texts.append(P.blocks(chosen_runs(source or "", *known[host])))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["id", "url", "text", "n_chars"])

    out = joined.select("id", "url", "host", "html", "template", "level", "slots", "box").mapInArrow(batches, f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_col)
