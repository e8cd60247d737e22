"""Operators on pages and vectors, and the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import url_filter
from weftline.llm.ann import AnnParams, nearest
from weftline.llm import html_text
from weftline.llm.html_text import HtmlParams, extract, lines_of, main_text
from weftline.llm.queries import URL_RULES
from weftline.llm.url_filter import Rule, Shard, build, judge

URLS = [
    "http://a.net/x", "https://net/", "http://example.net/en/1", "https://b.Example.NET/en/2?q=/fr/", "http://example.com/de/x#y", "http://xexample.com/de/", "http://z.org/fr/1",
    "http://z.org/en/", "http://a.net", "a.net/x", "", None, "x://y://net/", "http://EXAMPLE.com/DE/", "http://net?x", "http://a.b.c.example.net/en/", "http://Ünet.net/", "http://a.net/" + "p" * 9000,
]


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    fits = [r for r in rules if host and (host == r.host.lower() or host.endswith("." + r.host.lower())) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len((r.host + r.path).encode()), len(r.host.encode())), default=None)
    return host, path, best and best.host.lower() + best.path, best.verdict if best else "allow"


#: Ties of two kinds, other scripts, and rules that fit nothing.
HARD_RULES = [*URL_RULES, Rule("b.com", "/aaaa", "block"), Rule("a.b.com", "/aa", "allow"), Rule("ünet.net", "/é", "block"), Rule("net.NET", "/é/日", "allow"), Rule("c.d", "", "block"), Rule("x.c.d", "", "allow")]
HARD_URLS = ["http://a.b.com/aaaa", "http://b.com/aaaa", "http://x.a.b.com/aab", "http://ünet.net/é/日本", "http://net.net/é/日/1", "http://x.c.d", "http://y.c.d?q", "http://c.d/", "http://.c.d/", "http://./", "http://a..net/"]


@pytest.mark.parametrize("shard", [url_filter.SHARD_RULES, 2])
@pytest.mark.parametrize("as_table", [False, True])
def test_urls_match_brute_force(spark, shard, as_table):
    rows = [(k, u) for k, u in enumerate(URLS + HARD_URLS)] + [(0, URLS[0]), (None, URLS[2])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    rules = HARD_RULES
    if as_table:
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in HARD_RULES] + [(None, "/", "block"), ("net", None, "block"), ("net", "/x", None)], "host string, path string, verdict string").withColumn("text", F.lit(1))
    got = sorted((r.page_id if r.page_id is not None else -1, r.host, r.path, r.rule or "", r.verdict) for r in judge(pages, rules, shard_rules=shard).collect())
    assert got == sorted((u if u is not None else -1, *(x or "" for x in brute_verdict(url, HARD_RULES))) for u, url in rows)


def test_many_rules_in_shards(spark):
    """A long list as a table, of which every tenth host is asked for."""
    rules = spark.range(3000).selectExpr("concat('h', id, '.org') as host", "concat('/', id % 7, '/') as path", "if(id % 2 = 0, 'block', 'allow') as verdict")
    pages = spark.range(0, 3000, 10).selectExpr("id as page_id", "concat('http://www.H', id, '.org/', id % 7, '/page') as url")
    got = judge(pages, rules, default="none", shard_rules=400).collect()
    assert len(got) == 300 and all(r.verdict == ("block" if r.page_id % 2 == 0 else "allow") and r.rule == f"h{r.page_id}.org/{r.page_id % 7}/" for r in got)


def test_digests_are_those_of_spark(spark):
    texts = ["", "a", "ünet.net/é", "x" * 31, "y" * 32, "z" * 1000]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("d")).collect()]
    assert got == url_filter.digests_of([t.encode() for t in texts]).tolist()


def test_url_edges(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).collect() == []
    only = judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), []).collect()
    assert only[0].rule is None and only[0].verdict == "allow"


def test_shard_confirms_strings(tmp_path, monkeypatch):
    """All digests collide: only the stored strings tell the rules apart."""
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda *_: 7)
    (tmp_path / "i").write_bytes(build([(b"a.b/", True), (b"c.d/x/", False)]) + b"\n")
    shard = Shard(str(tmp_path / "i"))
    found = shard.find([b"c.d/x/", b"a.b/", b"e.f/"], np.array([7, 7, 7], np.int64))
    assert [shard.text(k) if k >= 0 else None for k in found] == [b"c.d/x/", b"a.b/", None]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="sidebar"><p>Side text that goes on for a while, longer than a menu</p></div>{body}
<section class="comments"><article class="comment"><p>Nice page, thanks for this long and detailed article!</p></article></section>
<form><label>Name</label><input name="n"><textarea>x</textarea></form><footer>&copy; Me</footer></body></html>"""
BODY = "<h1>A &amp; B</h1><p>First  para &eacute;&#233;<b>bo</b>l<script>var x = '<p>';</script><span class='ad'>Buy</span>d<br>next.<p>Unclosed para<div class='ad-box'>Buy!</div><ul><li>one<li>two</ul><p>Ok.</p>"
TEXT = "A & B\nFirst para éébold next.\nUnclosed para\none\ntwo\nOk."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='content'>{}</div>"])
def test_article_text(wrap):
    assert main_text(PAGE.replace("{body}", wrap.format(BODY))) == TEXT


@pytest.mark.parametrize("mark", ['div class="layout has-sidebar"', 'div id="page" class="site no-comments"', 'article class="post comment-open"', 'div class="social-history"'])
@pytest.mark.parametrize("inner", ["<h1>T</h1>{}", "{}", "<article>{}</article>", "<main><h1>T</h1>{}</main>"])
def test_names_of_wrappers_are_only_hints(mark, inner):
    lines = [f"Line {k} of an article with <a class='related-term'>words</a> enough, and more." for k in range(9)]
    body = inner.format("".join(f"<p>{x}</p>" for x in lines))
    comments = "<section class='comments'><h2>All</h2>" + "<article class='comment'><p>A long comment on this article, longer than its lines are on their own.</p></article>" * 9 + "</section>"
    page = f"<body><nav>Home</nav><{mark}>{body}<div class='side-menu sidebar'><p>Side text</p></div></{mark.split()[0]}>{comments}<div class='cookie-notice'>We use cookies</div></body>"
    wanted = ["T"] * ("<h1>" in inner) + [x.replace("<a class='related-term'>", "").replace("</a>", "") for x in lines]
    assert main_text(page) == "\n".join(wanted)


def brute_choice(lines, p=HtmlParams()):
    """Which lines of a page without articles stay, from their text, tags and path: loops instead of arrays."""
    ratio = [0.0 if x.dead else len(x.text) / max(1, x.tags) for x in lines]
    reach, level = max(1, int(3 * p.sigma)), []
    weight = [math.exp(-0.5 * (d / p.sigma) ** 2) for d in range(-reach, reach + 1)]
    for k in range(len(ratio)):
        near = [ratio[min(max(k + d, 0), len(ratio) - 1)] for d in range(-reach, reach + 1)]
        level.append(sum(a * b for a, b in zip(weight, near, strict=True)) / sum(weight))
    low, high = min(level), max(level)
    for _ in range(20):
        upper = [x for x in level if x >= (low + high) / 2]
        lower = [x for x in level if x < (low + high) / 2]
        if not lower:
            break
        low, high = sum(lower) / len(lower), sum(upper) / len(upper)
    border = min((low + high) / 2 if lower else low, max(v for v, x in zip(level, lines, strict=True) if not x.dead))
    content = [x.path for x, v in zip(lines, level, strict=True) if not x.dead and v >= border - 1e-9]
    depth = 0
    while all(len(c) > depth and c[depth] == content[0][depth] for c in content if len(content[0]) > depth) and len(content[0]) > depth:
        depth += 1
    return "\n".join(x.text for x in lines if not x.dead and x.path[:depth] == content[0][:depth])


def test_region_matches_brute_force():
    r = random.Random(8)
    for _ in range(200):
        blocks = []
        for _ in range(r.randrange(1, 6)):
            links = r.random() < 0.5
            inside = "".join(f"<p>{' '.join(f'<a>w{r.randrange(9)}</a>' if links else 'word' * r.randrange(1, 4) for _ in range(r.randrange(1, 20)))}</p>" for _ in range(r.randrange(1, 6)))
            blocks.append(f"<div class='{r.choice(['x', 'content', 'sidebar', 'ad'])}'>{inside}</div>")
        page = f"<body><div>{''.join(blocks)}</div></body>"
        lines = lines_of(page, HtmlParams())
        assert main_text(page) == (brute_choice(lines) if any(not x.dead for x in lines) else "")


PROSE = [f"Sentence {k} of an article that goes on for a while, with words enough to be read as one, and some more." for k in range(6)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in PROSE)


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<body><nav><a>Home</a></nav><form id='form1'><div><h1>T</h1>{}</div></form></body>", ["T", *PROSE]),
        ("<body><form><input name='a'><div>{}<label>Mail</label><button>Go</button></div></form></body>", PROSE),
        ("<body><h1>Title</h1><div id='content'>{}</div></body>", ["Title", *PROSE]),
        ("<body><div class='post'><header><h1>Title</h1></header>{}</div></body>", ["Title", *PROSE]),
        ("<body><header><h1>Site</h1></header><div class='post'><header><h1>Title</h1><p><a>By</a> <a>Me</a></p></header>{}</div></body>", ["Title", *PROSE]),
        ("<body><article><h1>T</h1>{}<section class='discussion'><h2>Discussion</h2>{}</section></article></body>", ["T", *PROSE, "Discussion", *PROSE]),
        ("<body><article>{}<div class='related-work'><h2>Related work</h2>{}</div></article></body>", [*PROSE, "Related work", *PROSE]),
        ("<body><article>{}<div class='related'><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul></div></article></body>", PROSE),
        ("<body><article>{}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p></article></body>", [*PROSE, "Let x=2 here."]),
        ("<body><article>{}</article><article><p>A short one, but an article.</p></article></body>", [*PROSE, "A short one, but an article."]),
        ("<body><article>{}</article><section class='comments'><article class='comment'><p>A comment that is as long as the lines of the article, if not longer than them.</p></article></section></body>", PROSE),
        ("<body><aside>{}</aside><div>{}{}</div></body>", PROSE * 2),
        ("<body><div class='banner'><p>One sentence.</p></div></body>", ["One sentence."]),
        ("<body><div class='no-sidebar'><p>One sentence.</p></div></body>", ["One sentence."]),
        ("<body><div>{}<form class='newsletter'><p>Leave us your mail address, we write each week and never more often.</p><input><button>Go</button></form></div></body>", PROSE),
    ],
)
def test_no_name_or_length_loses_an_article(page, wanted):
    assert main_text(page.replace("{}", PARAGRAPHS)) == "\n".join(wanted)


def tree_lines(html):
    """The lines of a well-formed page once more, by a walk over its tree: text, tags, and what stands around."""
    import xml.etree.ElementTree as ET

    lines, holders, around = [], set(), {}
    state = {"tags": 0, "text": "", "where": None}

    def take(text, where):
        state["text"] += text or ""
        state["where"] = where

    def end():
        text = " ".join(state["text"].split())
        if text:
            lines.append({"text": text, "tags": state["tags"], **state["where"]})
            state["tags"] = 0
        state["text"] = ""

    def walk(node, w):
        words = set((node.get("class") or "").split())
        named = node.tag == "aside" or "ad" in words
        if node.tag in ("article", "main", "h1") and not w["dead"] and not named:
            holders.update(w["named"])
        w = dict(w)
        if node.tag in ("nav", "footer") or node.tag == "header" and not w["zone"] and len(w["path"]) < 2:
            w["dead"] = True
        elif named:
            w["named"] = (*w["named"], id(node))
        elif "related" in words or node.tag == "form" or node.tag == "header" and not w["zone"]:
            w["doubtful"] = (*w["doubtful"], id(node))
        if named and node.tag in ("article", "main"):
            holders.add(id(node))
        if node.tag in ("article", "main") and not w["dead"] and (node.tag == "article" or not w["zone"]):
            w["zone"] = id(node)
            around[id(node)] = w["path"]
        if node.tag in ("body", "div", "section", "article", "main"):
            w["path"] = (*w["path"], id(node))
        w["title"] = w["title"] or node.tag == "h1"
        state["tags"] += 1
        take(node.text, w)
        for child in node:
            block = child.tag not in ("a", "b")
            if block:
                end()
            walk(child, w)
            if block:
                end()
            state["tags"] += 1
            take(child.tail, w)

    walk(ET.fromstring(html), {"dead": False, "named": (), "doubtful": (), "zone": 0, "path": (), "title": False})
    end()
    return lines, holders, around


def plain_levels(lines, p=HtmlParams()):
    ratio = [0.0 if x["dead"] else len(x["text"]) / max(1, x["tags"]) for x in lines]
    reach = max(1, int(3 * p.sigma))
    weight = [math.exp(-0.5 * (d / p.sigma) ** 2) for d in range(-reach, reach + 1)]
    level = [sum(a * ratio[min(max(k + d, 0), len(ratio) - 1)] for d, a in zip(range(-reach, reach + 1), weight)) / sum(weight) for k in range(len(ratio))]
    low, high, border = min(level), max(level), min(level)
    for _ in range(20):
        lower, upper = [x for x in level if x < (low + high) / 2], [x for x in level if x >= (low + high) / 2]
        if not lower:
            border = low
            break
        low, high = sum(lower) / len(lower), sum(upper) / len(upper)
        border = (low + high) / 2
    return level, min(border, max(v for v, x in zip(level, lines) if not x["dead"])) - 1e-9


def plain_extract(html):
    """The whole extraction of a well-formed page, in loops over the lines of its tree."""
    lines, holders, around = tree_lines(html)
    size = lambda rows: sum(len(x["text"]) for x in rows)
    living = [x for x in lines if not x["dead"]]
    plain = [x for x in living if all(k in holders for k in x["named"])]
    wrappers = {k for x in plain for k in x["named"] if 2 * size(y for y in plain if k in y["named"]) > size(plain)}
    if living and not any(all(k in wrappers for k in x["named"]) for x in living):
        chains = list(dict.fromkeys(x["named"] for x in living))
        sizes = [size(y for y in living if y["named"] == c) for c in chains]
        if sizes.count(max(sizes)) > 1:
            return None  # a tie, which the reader's numbers decide
        wrappers = set(chains[sizes.index(max(sizes))])
    for x in lines:
        x["dead"] = x["dead"] or any(k not in wrappers for k in x["named"])
    if all(x["dead"] for x in lines):
        return ""
    level, border = plain_levels(lines)
    high = [x for x, v in zip(lines, level) if not x["dead"] and v >= border]
    gone = set()
    for k in {k for x in lines if not x["dead"] for k in x["doubtful"]}:
        own = [x for x in lines if not x["dead"] and k in x["doubtful"]]
        if size(own) / max(1, sum(x["tags"] for x in own)) < border and 2 * size(x for x in high if k in x["doubtful"]) <= size(high):
            gone.add(k)
    for x in lines:
        x["dead"] = x["dead"] or not x["title"] and any(k in gone for k in x["doubtful"])
    if all(x["dead"] for x in lines):
        return ""
    level, border = plain_levels(lines)
    high = [x for x, v in zip(lines, level) if not x["dead"] and v >= border]
    if any(x["zone"] for x in high):
        beside = {around[x["zone"]] for x in high if x["zone"]}
        kept = [x for x in lines if not x["dead"] and x["zone"] and around[x["zone"]] in beside]
    else:
        depth = 0
        while all(len(x["path"]) > depth and x["path"][depth] == high[0]["path"][depth] for x in high if len(high[0]["path"]) > depth) and len(high[0]["path"]) > depth:
            depth += 1
        kept = [x for x in lines if not x["dead"] and x["path"][:depth] == high[0]["path"][:depth]]
    if not any(x["title"] for x in kept):
        above = [x for x in lines[: lines.index(kept[0])] if not x["dead"] and x["title"]]
        kept = above[-1:] + kept
    return "\n".join(x["text"] for x in kept)


def random_page(r):
    def block(depth):
        mark = r.choice(["", "", "", " class='ad'", " class='x y'", " class='related'"])
        if depth == 0 or r.random() < 0.4:
            kind = r.choice(["p", "p", "p", "h1", "h2", "nav"])
            inside = " ".join(r.choice(["word", "another longer word", "<a>link</a>", "<b>bold</b> end", "more  words"]) for _ in range(r.randrange(1, 12)))
            return f"<{kind}{mark if kind == 'p' else ''}>{inside}</{kind}>"
        kind = r.choice(["div", "section", "article", "main", "form", "aside", "header"])
        inner = 0 if kind == "header" else depth - 1  # an article in a page's header would close it
        return f"<{kind}{mark}>{''.join(block(inner) for _ in range(r.randrange(1, 5)))}</{kind}>"

    return f"<html><body>{''.join(block(r.randrange(0, 4)) for _ in range(r.randrange(1, 7)))}</body></html>"


def test_extraction_matches_a_walk_over_the_tree():
    r = random.Random(3)
    compared = 0
    for _ in range(400):
        page = random_page(r)
        reader = html_text.LineReader()
        reader.feed(page)
        reader.close()
        reader.flush()
        tree = tree_lines(page)[0]
        assert [(x.text, x.tags, x.title) for x in reader.lines] == [(x["text"], x["tags"], x["title"]) for x in tree]
        wanted = plain_extract(page)
        if wanted is not None:
            compared += 1
            assert main_text(page) == wanted, page
    assert compared > 350


def test_pages_with_nothing():
    for html in (None, "", "   ", "<nav>Menu</nav>", "<script>x</script>", "<p></p>", "<!-- c -->"):
        assert main_text(html) == ""
    assert main_text("plain words only") == "plain words only"
    assert main_text("1 <") == "1 <"  # HTML reads a lone bracket as text
    assert main_text("<article>" + "<p>x y</p>" * 5000) == "\n".join(["x y"] * 5000)


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>a b</p></article>"), (1, "u", "<article><p>a b</p></article>"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract(pages).collect())
    assert got == [(0, "", "", 0), (1, "u", "a b", 3), (1, "u", "a b", 3), (2, "v", "", 0)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# --- vectors --------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>"


def brute_nearest(rows, top):
    ids = np.array([u for u, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[k]][:top]
        out[int(ids[k])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_recall_and_ties(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 16)).astype(np.float32)
    x[100:900] = x[7]  # many copies of one vector
    rows = [(int(u), v.tolist()) for u, v in zip(r.permutation(len(x)), x, strict=True)]
    got: dict[int, list] = {}
    for q in sorted(nearest(spark.createDataFrame(rows, VEC), "id % 20 = 0", AnnParams(list_size=64)).collect(), key=lambda q: (q.query_id, q.rank)):
        got.setdefault(q.query_id, []).append((q.vec_id, q.score))
        assert q.rank == len(got[q.query_id])
    want = brute_nearest(rows, 20)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    hits = sum(len({u for u, _ in got[q]} & {u for u, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.95
    for q in want:
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(got[q], got[q][1:], strict=False))
    copies = {u for u, v in rows if v == x[7].tolist()}
    for q in copies & want.keys():
        assert [u for u, _ in got[q]] == [u for u, _ in want[q]]


@pytest.mark.parametrize("p", [AnnParams(), AnnParams(list_size=16, coarse=256, cell=40, top=5)])
def test_double_vectors_are_exact(spark, p):
    """Doubles aren't rounded to floats; lists that are fitted in two levels and split into cells give the same scores."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(900, 8)), np.repeat(r.normal(size=(1, 8)) + 3, 600, axis=0) + r.normal(size=(600, 8)) * 0.01])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 20 = 0", p).collect()
    hits = 0
    for q in range(0, len(x), 20):
        own = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert len(own) == p.top and all(score == pytest.approx(float(x[q] @ x[v]), rel=1e-13) for _, v, score in own)
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({v for _, v, _ in own} & set(np.argsort(-s, kind="stable")[: p.top].tolist()))
    assert hits >= 0.9 * p.top * len(range(0, len(x), 20))


def test_double_vector_of_the_round(spark):
    rows = [(0, [0.1, 0.2]), (1, [0.3, 0.7]), (2, [1e300, 1.0])]
    got = {(g.query_id, g.vec_id): g.score for g in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 20 = 0").collect()}
    assert got == {(0, 1): 0.1 * 0.3 + 0.2 * 0.7, (0, 2): 0.1 * 1e300 + 0.2}


def test_vector_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (20, [0.0, -2.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, [None, 1.0]), (40, [float("inf"), 0.0]), (0, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, VEC).withColumn("score", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("rep", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(vectors, "id % 20 = 0").collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, -1.0)]
    assert nearest(spark.createDataFrame([], VEC), "id % 20 = 0").collect() == []


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    words = [f"{a}{b}" for a in ("al", "be", "ca", "du", "er") for b in ("no", "mi", "ta", "so", "ru")]
    para = lambda n: ". ".join(" ".join(r.choice(words) + str(r.randrange(90)) for _ in range(8)).capitalize() for _ in range(n))
    item, passage = para(4), para(9)
    rows = [(k, para(12), "en", f"s{k % 3}", 1) for k in range(120)]
    rows += [(200 + k, rows[5][1], "en", "s0", 1) for k in range(4)]  # copies
    rows += [(300 + k, f"{para(6)} {passage} {para(6)}", "en", "s1", 1) for k in range(5)]  # a shared passage
    rows += [(400, f"{para(6)} {item} {para(5)}", "en", "s2", 1)]
    rows += [(500 + k, "BUY!! " * 80, "en", "s2", 1) for k in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(u, int(u < 500)) for u, *_ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {x.doc_id: x.text for x in docs.collect()}
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert set(seen[names[0]]) == {u for u, *_ in rows if u < 500}
    assert set(seen[names[1]]) == set(seen[names[0]]) - {200, 201, 202, 203}
    assert all(passage not in t for t in seen[names[2]].values()) and seen[names[2]][0] == rows[0][1]
    assert set(seen[names[3]]) == set(seen[names[2]]) - {400}
    assert set(seen[names[4]]) <= set(seen[names[3]])
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((x.doc_id, x.epoch) for x in final.select("doc_id", "epoch").collect()) == sorted((x.doc_id, x.epoch) for x in docs.select("doc_id", "epoch").collect())
