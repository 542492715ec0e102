"""Link-graph URL filter and HTML extraction."""

import random
from collections import Counter
from html.parser import HTMLParser

import pytest

from tests.llm.conftest import PAGES
from tidelog.llm import dom, linkgraph, wrapper

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def judge(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for v, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (v, h + p)
    return host, path, best


ODD = [
    (1, "HTTP://WWW.Example.ORG/es/x?y#z", "<p>x</p>"),
    (1, "HTTP://WWW.Example.ORG/es/x?y#z", "<p>x</p>"),
    (2, None, None),
    (3, "no scheme/path", ""),
    (4, "http://notexample.org/es/", "x"),
    (5, "http://example.org", None),
    (6, "http://example.org/en/123?q=/fr/", "x"),
    (7, "a://b://c.com/fr/1", "x"),
    (8, "http://ÄB.com/de/\nx#", "x"),
    (None, "http://x.com:80/fr/", "x"),
    (9, "http://com/fr/", "x"),
]


@pytest.mark.parametrize("table", ["odd", "small"])
def test_rules(spark, small, tmp_path, table):
    if table == "odd":
        spark.createDataFrame(ODD, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    place = str(tmp_path) if table == "odd" else small
    want = Counter()
    for r in spark.read.parquet(f"{place}/pages.parquet").collect():
        host, path, best = judge(r["url"])
        want[r["page_id"], host, path, best and best[1], best and best[0]] += 1
    got = linkgraph.op1_link_graph(spark, place).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got) == want
    assert all(r["verdict"] in ("allow", "block") for r in got)


def spread(links, seeds, rounds, damping):
    out = {}
    for kind, pairs in (("trust", links), ("distrust", Counter({(b, a): n for (a, b), n in links.items()}))):
        total = Counter()
        for (a, _), n in pairs.items():
            total[a] += n
        rank = dict(seeds[kind])
        for _ in range(rounds):
            new = dict(seeds[kind])
            for (a, b), n in pairs.items():
                new[b] = new.get(b, 0) + damping * rank.get(a, 0) * n / total[a]
            rank = new
        out[kind] = rank
    return out


def test_scores_equal_brute_force(spark):
    rnd = random.Random(3)
    links = Counter((f"h{rnd.randrange(30)}", f"h{rnd.randrange(30)}") for _ in range(200))
    links = Counter({(a, b): n for (a, b), n in links.items() if a != b})
    seeds = {"trust": {f"h{k}": 1.0 for k in range(5)}, "distrust": {f"h{k}": 0.5 for k in range(25, 30)}}
    want = spread(links, seeds, 200, 0.85)
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "src string, dst string, links long")
    hosts = spark.createDataFrame([(f"h{k}", seeds["trust"].get(f"h{k}", 0.0), seeds["distrust"].get(f"h{k}", 0.0)) for k in range(30)], "host string, trust double, distrust double")
    got = {r["host"]: r for r in linkgraph.scores(edges, hosts).collect()}
    for kind in want:
        for h, x in want[kind].items():
            assert 0 <= x - got[h][kind] < linkgraph.SHORT


def test_distrust_runs_against_links(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)
    data = [
        (1, "http://bad.com/de/1", ""),
        (2, "http://farm.net/1", link("bad.com", "bad.com")),
        (3, "http://fan.net/1", link("farm.net")),
        (4, "http://good.org/1", link("friend.net")),
        (5, "http://friend.net/1", link("bad.com", "good.org") + link("good.org") * 9),
        (6, "http://alone.net/1", None),
    ]
    got = {r["page_id"]: r["verdict"] for r in linkgraph.judged(spark.createDataFrame(data, PAGES)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_verdicts_equal_brute_force(spark):
    """A graph with chains longer than a dozen links, a hub that very many link to, one that links to very many, and cycles; through whole pages."""
    rnd = random.Random(7)
    links = Counter()
    hosts = [f"h{k}.net" for k in range(120)]
    for a, b in ((rnd.choice(hosts), rnd.choice(hosts)) for _ in range(150)):
        links[a, b] += 1
    for h in hosts[:60]:
        links[h, "hub.net"] += 1
        links["wide.net", h] += 1
    for k in range(19):
        links[f"c{k + 1}.net", f"c{k}.net"] += 1
    links["c0.net", "bad0.com"] += 1
    for k in range(4):
        links[f"good{k}.org", rnd.choice(hosts)] += 2
        links[rnd.choice(hosts), f"bad{max(k, 1)}.com"] += 3
    links["hub.net", "bad1.com"] += 1
    links = Counter({(a, b): n for (a, b), n in links.items() if a != b})
    seeds = {"trust": {f"good{k}.org": 1.0 for k in range(4)}, "distrust": {f"bad{k}.com": 1.0 for k in range(4)}}
    score = spread(links, seeds, 300, 0.85)
    every = sorted({h for pair in links for h in pair})
    want = {}
    for h in every:
        trust, distrust = score["trust"].get(h, 0), score["distrust"].get(h, 0)
        assert abs(distrust - linkgraph.LIMIT) > linkgraph.SHORT and (distrust < linkgraph.LIMIT / 2 or abs(distrust - trust) > linkgraph.SHORT)
        spread_to = distrust >= linkgraph.LIMIT and distrust > trust
        want[h] = "block" if h.endswith(".com") or spread_to and not h.endswith(".org") else "allow"  # rules go first
    out = {}
    for (a, b), n in links.items():
        out.setdefault(a, []).extend([f'<A class=x HREF="https://{b}/p?q=1">l</a>'] * n)
    path = lambda h: "/de/1" if h.endswith(".com") else "/x"
    noise = '<!-- <a href="http://bad0.com/"> --><script>"<a href=http://bad0.com/>"</script><link href="//bad0.com/x"><a data-href="//bad0.com/" href="/in?u=http://bad0.com/">x</a>'
    rows = [(k, f"http://{h}{path(h)}", noise + "".join(out.get(h, []))) for k, h in enumerate(every)]
    got = {r["host"]: r["verdict"] for r in linkgraph.judged(pages_frame(spark, rows)).collect()}
    assert got == want
    assert got["c13.net"] == "block" and sum(v == "block" for h, v in got.items() if h.startswith("h")) > 3 and "allow" in got.values()


def test_links_of_a_page():
    page = """<a href=HTTP://A.com/>x</a><a title="<a href='no'>" href='//b.com/?x=1&amp;y'>y</a><a>z</a><area href=no><a name=href>
    <textarea><a href="no"></textarea><a
    href = "&#104;ttp://c.com/"><a href=""><!-- <a href=no> --><a href="d"><a href=open"""
    assert dom.links(page) == ["HTTP://A.com/", "//b.com/?x=1&y", "http://c.com/", "d"]


def test_empty_links_of_a_page():
    """An address that is empty once its quotes, references and white space are off is none; the first href counts."""
    assert dom.links("""<a href=""><a href=''><a href=" \n"><a href="&#32;"><a href="" href="b"><a href><a href=" c ">""") == ["c"]


class Article(HTMLParser):
    """Text inside article, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag not in ("b", "a", "i"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in ("b", "a", "i"):
            self.out.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.out.append(data)


def test_extraction_of_whole_table(spark, small):
    got = {r["page_id"]: r for r in wrapper.op4_wrapper(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        own = Article()
        own.feed(r["html"])
        own.close()
        assert got[r["page_id"]]["text"] == " ".join("".join(own.out).split())
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


PAGE = """<!doctype html><html><head><title>T</title><style>x</style></head><body class="has-sidebar">
<header><h2>Site</h2></header><div class="cookie-notice">We use cookies</div><div id=top><p>Same slogan everywhere</p></div>
<article class="post"><h1>Title {k}</h1><p>First &amp; <b>bold</b>&nbsp;words {k}<br>more<p>Second<script>var x = "</p>"</script> part {k}
<ul><li>One {k}<li>Two</ul><form><input value=q><p>Search</p></form><div class="advert">Buy</div><!-- not this --><p>Shared passage</p>
<section class="comments"><article><p>A reader says {k}</p></article></section></article>
<aside>Side {k}</aside><div class="comments"><article><p>Another reader {k}</p></article></div><footer>&copy; {k}</footer></body></html>"""


def test_roles_and_slots(spark):
    data = [(k, "http://a.example/x", PAGE.replace("{k}", str(k))) for k in range(4)]
    plain = "<div><p>Always here</p><p>Body text number {k} of the page</p><p><a href=x>only a link {k}</a></p></div>"
    data += [(10 + k, "http://b.example/x", plain.replace("{k}", str(k))) for k in range(4)]
    data += [(20 + k, "http://c.example/x", "<article><p>one article in many copies</p></article>") for k in range(5)]
    data += [(30, None, None), (31, None, ""), (32, "x", "no markup at all"), (32, "x", "no markup at all"), (33, "http://c.example/", "<div>" * 5000 + "deep" + "<p>word" * 2000)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(data, PAGES)).collect()}
    for k in range(4):
        assert got[k] == f"Title {k} First & bold words {k} more Second part {k} One {k} Two Shared passage"
        assert got[10 + k] == f"Body text number {k} of the page"
    assert all(got[20 + k] == "one article in many copies" for k in range(5))
    assert got[30] == got[31] == "" and got[32] == "no markup at all" and got[33].startswith("deep word word")


def test_pages_empty(spark, empty):
    assert wrapper.op4_wrapper(spark, empty).count() == 0
    assert linkgraph.op1_link_graph(spark, empty).count() == 0


def tree_match(a, b):
    """Simple tree matching, plainly."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + tree_match(x, y))
    return m[-1][-1] + 1


def number(shapes, tree):
    return shapes.number(tree[0], tuple(number(shapes, c) for c in tree[1]))


def listed(tree, depth=0):
    """labels, depths and hashes of a tree in preorder; leaves are texts."""
    rows = [("#" if not tree[1] else tree[0], depth, len(tree[0]))]
    for c in tree[1]:
        rows += listed(c, depth + 1)
    return rows


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_tree_matching_equals_brute_force(monkeypatch, cells):
    """Sizes and alignments, by whole tables and by halved ones."""
    monkeypatch.setattr(dom, "MOST_CELLS", cells)
    rnd = random.Random(1)

    def tree(depth):
        return (rnd.choice("ab"), tuple(tree(depth - 1) for _ in range(rnd.randrange(5) if depth else 0)))

    def leaves_as_texts(t):
        return (t[0], tuple(map(leaves_as_texts, t[1]))) if t[1] else ("#", ())

    for _ in range(300):
        a, b = (leaves_as_texts(("r", (*tree(3)[1], ("a", ())))) for _ in range(2))
        shapes = dom.Shapes()
        assert shapes.match_size(number(shapes, a), number(shapes, b)) == tree_match(a, b)
        (labels, depths, hashes), other = zip(*listed(a)), list(zip(*listed(b)))
        met = dom.Matcher(labels, depths, hashes).align(*other)
        assert all(labels[x] == "#" == other[0][y] for x, y in met.items())
        places = sorted(met.items())
        assert [y for _, y in places] == sorted({y for _, y in places})  # keeps order, one to one
        parents = lambda ds: [max((j for j in range(i) if ds[j] == d - 1), default=None) for i, d in enumerate(ds)]
        up, down = parents(depths), parents(other[1])
        inner: dict = {}
        for x, y in met.items():  # top-down: ancestors are matched with ancestors
            while x is not None:
                assert inner.setdefault(x, y) == y and labels[x] == other[0][y]
                x, y = up[x], down[y]
            assert y is None


def test_wide_lists_are_aligned_best():
    """1,100 by 1,100 children, and no fewer pairs than the table gives."""
    rnd = random.Random(4)
    xs, ys = ([(rnd.choice("abc"), ()) for _ in range(1100)] for _ in range(2))
    row = [0] * 1101
    for x in xs:
        last, row = row, [0]
        for j, y in enumerate(ys):
            row.append(max(row[j], last[j + 1], last[j] + (x == y)))
    shapes = dom.Shapes()
    assert len(xs) * len(ys) > dom.MOST_CELLS
    assert shapes.match_size(number(shapes, ("r", tuple(xs))), number(shapes, ("r", tuple(ys)))) == row[-1] + 1


def text_of(source):
    return " ".join(x.words for x in dom.main_texts(dom.parse(source)))


@pytest.mark.parametrize(
    "source, text",
    [
        ("<!DOCTYPE html", ""),
        ("<?xml", ""),
        ("<!x", ""),
        ("</ x", ""),
        ("<!-- never closed", ""),
        ("a<!-- never closed", "a"),
        ("a<!x", "a"),
        ("a<!-->b<!--->c", "abc"),
        ("<", "<"),
        ("a < b", "a < b"),
        ("<!doctype html><p>x</p></ y>z", "x z"),
        ("<script>never closed", ""),
        ("<p>a<table><tr><td><p>b</table>c", "a b c"),
        ("<main><h1>Title</h1><p>Intro</p><article>teaser</article><p>The long body</p></main>", "Title Intro teaser The long body"),
        ("<div>" * 300 + "<nav>menu</nav><article>kept<nav>gone</nav></article>" + "</div>" * 300, "kept"),
        ("<div>" * 300 + "<nav>menu</nav><p>kept", "kept"),
    ],
)
def test_odd_markup(source, text):
    assert text_of(source) == text


def test_deep_and_long_markup_takes_linear_time():
    import time

    began = time.perf_counter()
    for unit, end in (("<div>", "x"), ("<div><p>", "x"), ("<li><div>", "x"), ("</foo>", "x"), ("<foo>", "</bar>" * 50_000 + "x"), ("<td><p>", "x"), ("<dl><dt>", "x")):
        root = dom.parse(unit * 50_000 + end)
        assert text_of(unit * 50_000 + end) == "x"
        labels, depths, hashes, _ = dom.flat(root)
        own = dom.Matcher(labels, depths, hashes)
        assert len(own.align(labels, depths, hashes)) == 1
    assert time.perf_counter() - began < 60


def pages_frame(spark, rows):
    return spark.createDataFrame([(k, u, h, "clash", "clash") for k, u, h in rows], PAGES + ", host string, words string")


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in wrapper.extract(pages_frame(spark, rows)).collect()}


BARE = "<div><div>Home of everything</div><p>Our motto stays</p></div><div><h1>Story {k}</h1><p>Words of story {k}</p></div><div><p>All rights with us</p></div>"


def test_wrapper_decides(spark):
    """A host without article elements: without the wrapper most of its pages come out otherwise."""
    rows = [(k, "http://a.example/", BARE.replace("{k}", str(k * k))) for k in range(12)]
    got = extracted(spark, rows)
    assert got == {k: f"Story {k * k} Words of story {k * k}" for k in range(12)}
    assert all(text_of(h) != got[k] for k, _, h in rows)


def test_wrapper_of_several_layouts(spark):
    """The page of the smallest id is empty, the next has another layout, and a notice is on some pages only."""
    notice = "<section><p>We are hiring</p></section>"
    rows = [(0, "http://a.example/", None), (1, "http://a.example/", "<table><tr><td>lone {k}</table>")]
    rows += [(k, "http://a.example/", (notice if k % 3 else "") + BARE.replace("{k}", str(k * k))) for k in range(2, 20)]
    rows += [(30, "http://b.example/", "<p>One page of its own</p>"), (30, "http://b.example/", "<p>One page of its own</p>")]
    got = extracted(spark, rows)
    assert got[0] == "" and got[1] == "lone {k}" and got[30] == "One page of its own"
    assert {k: got[k] for k in range(2, 20)} == {k: f"Story {k * k} Words of story {k * k}" for k in range(2, 20)}


def test_wrapper_beyond_the_broadcast_limit(spark, monkeypatch):
    from tidelog.llm import common

    rows = [(k, f"http://{'ab'[k % 2]}.example/", BARE.replace("{k}", str(k * k))) for k in range(24)] + [(None, None, "<p>x</p>")]
    whole = extracted(spark, rows)
    real = common.sized
    monkeypatch.setattr(common, "sized", lambda df, row_bytes, limit=0: (df, False) if real(df, row_bytes, limit) else None)
    assert extracted(spark, rows) == whole
