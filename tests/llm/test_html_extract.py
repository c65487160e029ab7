"""HTML extraction (op12): pages whose article is known by construction, and the template deduction itself."""

import random

import pytest

from fidelis.llm import html_extract as X
from fidelis.llm import html_pages as P

COLUMNS = "page_id long, url string, html string, host string, token string, slots int"


def words(rng, n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "wit", "tan"]) + str(rng.randrange(90)) for _ in range(n))


def article(rng, n=4):
    return [words(rng, 4)] + [words(rng, rng.randrange(5, 40)) for _ in range(n)]


def page_named(rng, blocks):
    """Everything by its name: header, menu, notice, advert, aside, form, comments, footer."""
    body = f"<header><h1>{words(rng, 3)}</h1></header>" if rng.random() < 0.5 else "<header>The site</header>"
    return (f"<!DOCTYPE html><html><head><title>{words(rng, 2)}</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body class='has-sidebar'>{body}"
            f"<nav><ul><li><a href='/'>{words(rng, 1)}</a><li><a>{words(rng, 1)}</a></ul></nav><div id='cookie-notice'><p>We use cookies {words(rng, 2)}</p></div><main><article class='post-{rng.randrange(99)}'>"
            f"<header><h1>{blocks[0]}</h1></header><p>{'</p><p>'.join(blocks[1:])}</p><div class='share-buttons'><span>Share</span> {words(rng, 2)}</div></article>"
            f"<section id='comments'><h2>{words(rng, 1)} comments</h2><article class='comment'><p>{words(rng, 9)}</p></article><form><p>{words(rng, 3)}</p><input name=q><textarea>{words(rng, 2)}</textarea></form></section>"
            f"</main><aside><p>{words(rng, 20)}</p></aside><div class=\"ad-slot\"><p>{words(rng, 30)}</p></div><footer>&copy; {words(rng, 3)}</footer></body></html>")


def page_nameless(rng, blocks):
    """Nothing has a telling name: only what the host's pages share shows the template."""
    return (f"<html><body><div><div><a href=/>Home</a> <a href=/a>{words(rng, 1)}</a></div><div><p>Welcome to our pages about everything, read by people all over the world every day of the year.</p></div>"
            f"<div><div><h2>{blocks[0]}</h2><p>{'<p>'.join(blocks[1:])}</div></div><div><p>All rights reserved by the owners.</p></div></div></body></html>")


def page_classes(rng, blocks):
    return f"<html><body><div class=top-menu><ul><li>{words(rng, 1)}</ul></div><div class='entry-content'><h1>{blocks[0]}</h1><p>{'</p><p>'.join(blocks[1:])}</p></div><div class=Sidebar>{words(rng, 30)}</div></body></html>"


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    rows, want = [], {}

    def add(k, url, html, blocks):
        rows.append((k, url, html, "x", "y", 1))
        want[k] = "\n".join(blocks)

    for k in range(30):
        b = article(rng)
        add(k, f"https://Named.example.com/p/{k}?x=1", page_named(rng, b), b)
    for k in range(100, 112):
        b = article(rng, 6)
        add(k, f"http://nameless.example.org:8080/{k}", page_nameless(rng, b), b)
    for k in range(200, 206):
        b = article(rng)
        add(k, f"http://user@classes.example.org/{k}", page_classes(rng, b), b)
    b = article(rng)
    add(300, "http://single.example.org", page_named(rng, b), b)
    add(301, "http://single2.example.org", page_classes(rng, b), b)
    for k in range(400, 420):  # copies and near copies of one article on a host
        c = [*b[:-1], b[-1] if k % 3 else words(rng, 8)]
        add(k, f"https://copies.example.com/{k}", page_named(rng, c), c)
    whole = page_named(rng, b)
    add(500, "https://named.example.com/cut", whole[: whole.index("</article>") - 60], b)  # cut inside the share buttons
    add(501, "https://named.example.com/none", "<html><body><nav><a>menu</a></nav><footer>foot</footer></body></html>", [])
    add(502, None, None, [])
    add(503, "", "", [])
    add(504, "not a url", "just text &amp; more\n  text", ["just text & more text"])
    long_ = [words(rng, 3)] + [words(rng, 400) for _ in range(300)]
    add(505, "https://named.example.com/long", page_named(rng, long_), long_)
    odd = "<article><h1>a &lt;b&gt; &eacute;&#33;&nbsp;&nbsp;x</h1>\n<p>one\n two<br>three<b>four</b>five <i>six</i><!-- gone --><p>seven &am &amp eight<ul><li>nine<li>ten</ul><table><tr><td>c1<td>c2</table></article>"
    add(506, "https://odd.example.com/", odd, ["a <b> é! x", "one two threefourfive six", "seven &am & eight", "nine", "ten", "c1", "c2"])
    rows.append(rows[3])
    return rows, want


def test_extraction_of_known_articles(spark, case):
    rows, want = case
    got = X.extract_text(spark.createDataFrame(rows, COLUMNS).repartition(5)).collect()
    assert len(got) == len(rows) and sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    url = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.text == want[r.page_id], r.page_id
        assert r.url == url[r.page_id] and r.n_chars == len(r.text)


def test_by_shuffle_as_by_broadcast(spark, case, monkeypatch):
    rows, want = case
    monkeypatch.setattr(X, "FREQUENT", 0.3)
    got = X.extract_text(spark.createDataFrame(rows, COLUMNS)).collect()
    assert all(r.text == want[r.page_id] for r in got)
    monkeypatch.setattr(X, "BROADCAST_TOKENS", 0)
    assert sorted(X.extract_text(spark.createDataFrame(rows, COLUMNS)).collect()) == sorted(got)


def streams_of(spark, pages, tmp):
    df = spark.createDataFrame([(k, h, s) for k, (h, s) in enumerate(pages)], "row long, host string, html string")
    X.read_streams(df, "html").write.parquet(f"{tmp}/s")
    s = spark.read.parquet(f"{tmp}/s")
    return s, s.groupBy("host").count().withColumnRenamed("count", "n_pages")


def test_equivalence_classes_equal_brute_force(spark, tmp_path):
    """Tokens with one vector of counts over the host's pages, on half of them at least, two or more."""
    rng = random.Random(8)
    pages = [(f"h{k % 3}", (page_named, page_nameless, page_classes)[k % 3](rng, article(rng, rng.randrange(1, 5)))) for k in range(24)]
    s, hosts = streams_of(spark, pages, tmp_path)
    want = set()
    for h in ("h0", "h1", "h2"):
        own = [(k, x) for k, (g, x) in enumerate(pages) if g == h]
        vector, structural = {}, set()
        for at, (_, x) in enumerate(own):
            for e in P.read_page(x)[0]:
                t = e if isinstance(e, int) else (e.token() if e.size and not e.node.bad and e.node.level < P.OF_MAIN else None)
                if t is not None:
                    vector.setdefault(t, [0] * len(own))[at] += 1
                    structural |= {t} if isinstance(e, int) else set()
        groups = {}
        for t, v in vector.items():
            n = sum(c > 0 for c in v)
            if 2 * n >= len(own) and (t in structural or n >= X.TEXT_PAGES):
                groups.setdefault(tuple(v), set()).add(t)
        want |= {(h, frozenset(g)) for g in groups.values() if len(g) > 1}
    got = {}
    for r in X.equivalence_classes(s, hosts).collect():
        got.setdefault((r.host, r["class"]), []).append(r)
    assert {(h, frozenset(r.token for r in v)) for (h, _), v in got.items()} == want
    assert all(sorted(r.place for r in v) == list(range(len(v))) and {r.size for r in v} == {len(v)} for v in got.values())


def test_classes_out_of_order_are_not_valid(spark, tmp_path):
    """Two blocks that change places from page to page share a vector but have no one order."""
    a, b = "<section class=aa><p>{}</p></section>", "<section class=bb><p>{}</p></section>"
    pages = [("h", "<html><body><div>" + (a + b if k % 2 else b + a).format(k, k + 100) + "</div></body></html>") for k in range(10)]
    s, hosts = streams_of(spark, pages, tmp_path)
    found = X.deduce_templates(s, hosts, hosts.select("host"), str(tmp_path)).collect()[0]
    tokens = {t["token"] for t in found.template or []}
    body = P.hashed(P.hashed(P.hashed(0, "html", ""), "body", ""), "div", "")
    every = {r.token for r in X.equivalence_classes(s, hosts).collect()}
    assert body in every and len(tokens) < len(every)


def test_walk_blames_the_lower_class():
    template = {1: (0, 0, 3), 2: (0, 1, 3), 3: (0, 2, 3), 10: (1, 0, 2), 11: (1, 1, 2)}
    for tokens, broken in (([1, 10, 11, 10, 11, 2, 3], set()), ([1, 10, 2, 11, 3], {1}), ([1, 3, 2], {0}), ([1, 2], {0}), ([10, 11, 1, 2, 3, 10, 11], set()), ([11], {1})):
        w = X.Walk(template)
        for t in tokens:
            w.token(t)
        w.end()
        assert w.broken == broken, tokens


def test_reader_survives_anything():
    rng = random.Random(9)
    parts = ["<p>", "</p>", "<div class='a b'>", "</div>", "<b>", "</b>", "<", ">", "&amp;", "&#x41;", "text", "<!--", "-->", "<script>", "</script>", "<a href=\"x>y\">", "</a>", "<br/>", "<td>", "<li>", "'", '"', "<article>",
             "</article>", "<img src=x", "<![CDATA[", "]]>", "</", "<p title='", "\n", "<html>", "</html>", "\x00", "<table>"]
    for _ in range(3000):
        source = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        events, runs, _ = P.read_page(source)
        opened = sum(isinstance(e, int) for e in events)
        assert opened % 2 == 0 and isinstance(P.blocks(runs), str)
    assert P.read_page("<b>" * 30_000 + "x" + "</i>" * 30_000 + "<p>" * 3000)[1][0].size == 1


def test_empty_table(spark):
    assert X.extract_text(spark.createDataFrame([], COLUMNS)).count() == 0
