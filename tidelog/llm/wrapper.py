"""HTML extraction by wrapper induction.

Every page becomes a tree of its block elements and block texts, once.  A host's
wrapper has a reference tree for its most frequent layout, with which all its
pages are aligned by simple tree matching, and one for each other layout that
several pages have, with which those are aligned, too; so what one layout lacks
is found in another, and empty or odd pages are no reference.  For each text of
a reference the values are counted over the host's different pages: a text that
stays the same on enough of them is template, one that varies is a slot.

Template texts go.  Of the slots, those in page furniture (menus, footers,
adverts, forms ...) go by their element's role, as they vary like content; where
a page names its article or main element, its slots are the content, else all
that are left and aren't mostly links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import dom
from tidelog.llm.common import join_side, pages, small_batches, stored
from tidelog.llm.linkgraph import host_of

#: A text is template if this share of the aligned pages, and this many, have it in one place ...
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.5, 3
#: ... and within an article, where pages may have passages in common, these.
ARTICLE_SHARE, ARTICLE_PAGES = 0.8, 10

TREE = "labels array<string>, depths array<int>, hashes array<long>, inside array<boolean>"
PAGE = f"host string, page_id long, url string, digest long, layout long, {TREE}, places array<int>, words array<string>"
RESULT = "page_id long, url string, text string"

_KINDS = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def read_page(source: str) -> tuple:
    """layout, the tree, and of the texts that may be content the places in the tree and the words."""
    root = dom.parse(source)
    labels, depths, hashes, nodes = dom.flat(root)
    main = {id(x) for r in dom.content_roots(root) for x in (r, *dom.below(r))}
    inside = [id(x) in main for x in nodes]
    may = {id(x) for x in dom.main_texts(root)}
    places = [k for k, x in enumerate(nodes) if id(x) in may]
    return dom.skeleton(labels, depths, inside), labels, depths, hashes, inside, places, [nodes[k].words for k in places]


def trees(table: DataFrame) -> DataFrame:
    """A row of PAGE for each page (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(c.split(" ") for c in PAGE.split(", ")))
        for b in batches:
            rows = [read_page(source) for source in b.column(4).to_pylist()]
            arrays = [pa.array([r[k] for r in rows], _KINDS[kind]) for k, kind in enumerate(kinds[4:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *arrays], list(names))

    html = F.coalesce("html", F.lit(""))
    rows = table.select(host_of(F.col("url")).alias("host"), "page_id", "url", F.xxhash64(html).alias("digest"), html.alias("html"))
    return rows.mapInArrow(run, PAGE)


def tree_bytes() -> Column:
    return F.size("tree.labels") * 28 + F.octet_length("host") + 40


def references(every: DataFrame) -> DataFrame:
    """host, layout, pages and tree of each reference; layout is null for that of the host's most frequent layout.

    pages is the number of different pages that are aligned with it.  A layout's
    reference is its page of the smallest page_id; pages without a text don't count.
    """
    first = F.struct(F.col("page_id").isNull(), "page_id", "digest")
    layouts = stored(every.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("pages"), F.min_by("tree", first).alias("tree")), "page-layouts")
    most = stored(layouts.groupBy("host").agg(F.sum("pages").alias("all_pages"), F.max(F.struct("pages", "layout")).alias("most")), "host-layouts")
    joined = join_side(layouts, most.filter(F.col("all_pages") >= TEMPLATE_PAGES), ["host"], F.octet_length("host") + 40)
    main = F.col("layout") == F.col("most.layout")
    return joined.filter(main | (F.col("pages") >= TEMPLATE_PAGES)).select("host", F.when(~main, F.col("layout")).alias("layout"), F.when(main, F.col("all_pages")).otherwise(F.col("pages")).alias("pages"), "tree")


def aligned(rows: DataFrame) -> DataFrame:
    """host, layout, node, hash: the texts of the pages' trees by the nodes of their reference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Matchers()
        for b in batches:
            hosts, layouts, nodes, hashes = [], [], [], []
            for r in b.to_pylist():
                for x, y in held.of(r["host"], r["layout"], r["tree"]).align(r["labels"], r["depths"], r["hashes"]).items():
                    hosts.append(r["host"])
                    layouts.append(r["layout"])
                    nodes.append(x)
                    hashes.append(r["hashes"][y])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(layouts, pa.int64()), pa.array(nodes, pa.int32()), pa.array(hashes, pa.int64())], ["host", "layout", "node", "hash"])

    return rows.select("host", "layout", "tree", "labels", "depths", "hashes").mapInArrow(run, "host string, layout long, node int, hash long")


class Matchers:
    """The matchers of the references that were met last."""

    KEPT = 64

    def __init__(self) -> None:
        self.held: dict[tuple, dom.Matcher] = {}

    def of(self, host: str, layout: int | None, tree: dict) -> dom.Matcher:
        key = (host, layout)
        if key not in self.held:
            if len(self.held) >= self.KEPT:
                self.held.clear()
            self.held[key] = dom.Matcher(tree["labels"], tree["depths"], tree["hashes"])
        return self.held[key]


def wrappers(parsed: DataFrame) -> DataFrame:
    """host, layout, tree and constant (struct(node, hash) of its template texts) of the references that have any.

    Equal pages of a host count once.  The counts are over all pages.
    """
    tree = F.struct("labels", "depths", "hashes", "inside").alias("tree")
    page = F.min_by(F.struct("page_id", "layout", tree), F.struct(F.col("page_id").isNull(), "page_id")).alias("p")
    some = parsed.filter(F.array_contains("labels", "#"))
    every = stored(some.groupBy("host", "digest").agg(page).select("host", "digest", "p.*"), "page-trees")
    known = stored(references(every), "reference-trees")
    flat = every.select("host", F.col("layout").alias("of"), "tree.labels", "tree.depths", "tree.hashes")
    with_main = join_side(flat, known.filter("layout is null"), ["host"], tree_bytes())
    own = known.filter("layout is not null").withColumnRenamed("layout", "of")
    with_own = join_side(flat, own, ["host", "of"], tree_bytes()).withColumn("layout", F.col("of"))
    met = aligned(with_main.unionByName(with_own))
    counted = met.groupBy("host", "layout", "node", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= TEMPLATE_PAGES)
    named = join_side(counted, known, ["host", "layout"], tree_bytes())
    inside = F.element_at("tree.inside", F.col("node") + 1)
    enough = F.when(inside, (F.col("n") >= ARTICLE_PAGES) & (F.col("n") >= ARTICLE_SHARE * F.col("pages"))).otherwise(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    # at most two values of a node are on half of the pages
    constant = stored(named.filter(enough).groupBy("host", "layout").agg(F.collect_list(F.struct("node", "hash")).alias("constant")), "template-texts")
    return join_side(known, constant, ["host", "layout"], F.octet_length("host") + 24 + 16 * F.size("constant"))


def extract(table: DataFrame) -> DataFrame:
    """page_id, url and text of every page (page_id, url, html).

    The text is the article's block texts, references decoded and white space as
    one space, joined by one space; empty for a null or empty html.  Pages with
    a null url, or one without a host, are one host.  Equal pages count once
    for the wrapper.  Repeated rows come back as often; an empty table gives no
    rows; other columns aren't read.  Pages are read once, and kept as trees and
    candidate texts; neither a tree's depth nor its width is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Matchers()
        for b in batches:
            out = []
            for r in b.to_pylist():
                gone: set[int] = set()
                for layout, tree, constant in ((None, r["main"], r["main_constant"]), (r["layout"], r["own"], r["own_constant"])):
                    if constant is not None:
                        fixed = {(c["node"], c["hash"]) for c in constant}
                        matched = held.of(r["host"], layout, tree).align(r["labels"], r["depths"], r["hashes"])
                        gone |= {y for x, y in matched.items() if (x, r["hashes"][y]) in fixed}
                out.append(" ".join(w for k, w in zip(r["places"], r["words"]) if k not in gone))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    small_batches(table.sparkSession)
    parsed = stored(trees(table), "parsed-pages")
    known = stored(wrappers(parsed), "wrappers")
    main = known.filter("layout is null").select("host", F.col("tree").alias("main"), F.col("constant").alias("main_constant"))
    own = known.filter("layout is not null").select("host", "layout", F.col("tree").alias("own"), F.col("constant").alias("own_constant"))
    size_of = lambda t, c: F.size(f"{t}.labels") * 28 + F.octet_length("host") + 40 + 24 * F.size(c)
    rows = join_side(parsed, main, ["host"], size_of("main", "main_constant"), "left")
    rows = join_side(rows, own, ["host", "layout"], size_of("own", "own_constant"), "left")
    return rows.select("page_id", "url", "host", "layout", "labels", "depths", "hashes", "places", "words", "main", "main_constant", "own", "own_constant").mapInArrow(run, RESULT)


def op4_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    done = extract(pages(spark, sf_dir).select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
