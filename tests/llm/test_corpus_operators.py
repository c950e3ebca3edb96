"""Near-duplicates, repeated passages, components, urls, pages and the pipeline."""

import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.llm import common, html_extract, near_dedup, recompress, substring_dedup, url_filter
from skyweave.llm.components import components
from tests.oracle import SMALL


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)] + [(300, k) for k in range(301, 330)]
    got = {r.v: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 150: 100, 200: 100, **{k: 300 for k in range(301, 330)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def _family(rnd, n, words, edits):
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randint(0, edits)):
            own[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def _groups(texts, ids, width=2):
    """What near_duplicates has to give, by comparing all pairs: (id, n, component, kept) a row. Rows of one id are one document."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    name = {i: i for i in ids}

    def head(i):
        while name[i] != i:
            i = name[i]
        return i

    for p, a in enumerate(sets):
        for q in range(p):
            if a and 100 * len(a & sets[q]) >= 80 * len(a | sets[q]):
                x, y = sorted((head(ids[p]), head(ids[q])))
                name[y] = x
    return sorted((i, len(s), head(i) if s else i, (head(i) if s else i) == i) for i, s in zip(ids, sets, strict=True))


def _found(spark, texts, ids, width=2):
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, width=width).collect())


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(11)
    texts = [t for n in (30, 12, 5, 2) for t in _family(rnd, n, 120, 14)] + ["x", "X", "a b", None, "", "a  B"]
    rnd.shuffle(texts)
    ids = list(range(len(texts)))
    assert _found(spark, texts, ids) == _groups(texts, ids)


def test_near_duplicates_of_families_below_the_threshold(spark, monkeypatch):
    """Variants that share edits pairwise, at similarities of 0.6 to 0.9; hot keys and buckets in slices, and the shuffled joins of large inputs."""
    rnd = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    edit = lambda words, n: [f"e{k}-{rnd.randrange(3)}" if k in at else w for at in [rnd.sample(range(0, 60, 3), n)] for k, w in enumerate(words)]
    centres = [edit(base, 4) for _ in range(12)]
    texts = [" ".join(edit(rnd.choice(centres), rnd.randrange(3))) for _ in range(90)]
    texts += texts[:9] + ["lone text here"] * 40
    ids = list(range(len(texts)))
    want = _groups(texts, ids)
    assert 5 < len({w[2] for w in want}) < 100
    assert _found(spark, texts, ids) == want
    monkeypatch.setattr(near_dedup, "MOST_IDS", 0)
    monkeypatch.setattr(near_dedup, "SLICE", 7)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert _found(spark, texts, ids) == want


def test_near_duplicates_of_repeated_ids(spark, monkeypatch):
    rnd = random.Random(13)
    a, b, c = (_family(rnd, 4, 80, 3) for _ in range(3))
    texts, ids = [a[0], b[0], a[1], b[1], c[0], c[0], c[1], c[2], b[2], a[0], "", "q"], [5, 5, 6, 7, 9, 9, 8, 10, 5, 5, 12, 12]
    want = _groups(texts, ids)
    assert {w[0]: w[2] for w in want if w[1]}[7] == 5
    for hot in (100, 1):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert [(i, n) for i, n, _, _ in _found(spark, texts, ids)] == [(i, n) for i, n, _, _ in want]
        assert {x for x in _found(spark, texts, ids) if x[1]} == {x for x in want if x[1]}


def test_near_duplicates_edges(spark):
    rows = [(1, None), (5, "x"), (6, "X"), (5, "zz top"), (None, "x"), (7, "x"), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 1, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (7, 5, False), (None, None, True)], key=repr)
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []


def test_equal_windows_have_equal_representatives():
    rnd = random.Random(5)
    for _ in range(200):
        some = rnd.choice([2, 3, 5, 30])
        values = recompress.mix(np.arange(1, some + 1, dtype=np.uint64))

        def draw(n, some=some):
            out = []
            while len(out) < n:
                out += [rnd.randrange(some)] * rnd.choice([1, 1, 1, 2, 3, 4, 5, 6, 9])
            return out[:n]

        core = draw(rnd.randint(35, 60))
        texts = [draw(rnd.randint(0, 30)) + core + draw(rnd.randint(0, 30)) for _ in range(2)]
        apart = [recompress.mix(np.array([10**9 + k], dtype=np.uint64)) for k in range(3)]
        rep = recompress.representatives(np.concatenate([apart[0], values[texts[0]], apart[1], values[texts[1]], apart[2]]), 35)
        seen = {}
        for at, words in ((1, texts[0]), (len(texts[0]) + 2, texts[1])):
            for p in range(len(words) - 34):
                place = int(rep[at + p]) - at - p
                assert 0 <= place <= 35 - recompress.REACH and seen.setdefault(tuple(words[p : p + 35]), place) == place


def _kept(texts, window):
    split, seen = [(t or "").split() for t in texts], {}
    for w in split:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((" ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return out


@pytest.mark.parametrize("most", [substring_dedup.MOST_KEYS, 0])
def test_repeats_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "PIECE", 50)  # long texts in many pieces
    monkeypatch.setattr(substring_dedup, "MOST_KEYS", most)  # 0: the joins of large inputs
    rnd = random.Random(8)
    passages = [" ".join(f"p{rnd.randrange(9)}" for _ in range(n)) for n in (20, 35, 36, 80)]
    texts = [" ".join(rnd.choice([passages[rnd.randrange(4)], *(f"w{rnd.randrange(40)}" for _ in range(6))]) for _ in range(rnd.randint(0, 40))) for _ in range(50)]
    texts += [None, "", "x " * 90, "y " * 35 + "z", texts[0], texts[0]]
    df = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, n_removed string")
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(_kept(texts, 35)))
    assert substring_dedup.remove_repeats(df.limit(0)).collect() == []


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies on this site and you may accept them all</div><div class=ad>Buy now</div>
    <article><h1>Head &amp; line</h1><p>First <b>bold</b>
      text.<p>Short.<form><input>Mail me</form><ul><li>one<li>two</ul><script>var t="</p>";</script></article>
    <section id=comments><p>Nice article, I liked it a lot, thank you for it</p></section><aside>More</aside><footer>&copy; 2020</footer></body></html>"""
    assert html_extract.main_text(page) == "Head & line\n\nFirst bold text.\n\nShort.\n\none\n\ntwo"
    plain = "<body><div class=menu>" + "<a href=x>link</a> " * 9 + "</div><div><h2>A title</h2><p>" + "Long prose here. " * 20 + "</p><p>End.</p></div></body>"
    assert html_extract.main_text(plain).split("\n\n")[::2] == ["A title", "End."]
    assert [html_extract.main_text(x) for x in (None, "", "<nav>x</nav>", "just text", "<p>cut <b>off", "<![bad <p>x")][:5] == ["", "", "", "just text", "cut off"]


def test_html_reads_past_malformed_declarations():
    for bad in ("<p>a <![ b</p>", "<![foo[x]]>", "<![endif]-->", "<![CDATA[x]]>", "<![%x]>", "<!x>", "<!>"):
        text = html_extract.main_text(f"<p>one</p>{bad}<p>rest</p><p>a[0]></p>")
        assert "one" in text and "rest" in text and "a[0]>" in text, (bad, text)
        assert "rest" in html_extract.main_text("<p>one</p>" + " " * (html_extract.PIECE - 12) + f"{bad}<p>rest</p>"), bad
    assert html_extract.main_text("<p>one</p><![bad <p>x").split() == ["one", "x"]
    assert "kept" in html_extract.main_text("<p>one</p><![bad kept")
    assert html_extract.main_text("<p><math><![CDATA[a > b]]></math></p>") == "a > b"


def test_html_wrappers_and_parts():
    body = "<h1>The title</h1>" + "".join(f"<p>Paragraph {k} of the article says a number of things at some length.</p>" for k in range(6))
    side = "<div class=sidebar><p>Side matter</p></div><div id=comments><article><p>A comment</p></article></div>"
    whole = html_extract.main_text(f"<body>{body}</body>")
    assert whole.count("\n\n") == 6 and whole.count("\n") == 12
    for before, after in (
        ('<div class="content-sidebar-wrap"><main>', "</main></div>"), ('<div class="site has-sidebar">', "</div>"), ('<div class="no-sidebar"><div id="promo">', "</div></div>"),
        ("<form action=/ method=post><fieldset>", "</fieldset></form>"), ('<div class="no-comments">', "</div>"), ('<div class="popup"><article>', "</article></div>"),
    ):
        got = html_extract.main_text(f"<body><nav><a href=/>Home</a></nav>{before}{body}{side if 'comments' not in before else ''}{after}<footer>Foot</footer></body>")
        assert got == whole, (before, got)
    title = '<div class="page-header"><h1>The title</h1></div>'
    assert html_extract.main_text(f"<body>{title}<main>{body[18:].removeprefix('</h1>')}</main>{side}</body>").startswith("The title\n\nParagraph")
    parts = html_extract.main_text(f"<body><article>{body}</article><article>{body.replace('Paragraph', 'Further')}</article><p>And an ending outside of both, as long as any of the other paragraphs.</p></body>")
    assert parts.count("Paragraph") == parts.count("Further") == 6 and "And an ending" in parts
    long = "<p>A reader says a great deal about the article, more than it says itself.</p>" * 20
    assert "reader" not in html_extract.main_text(f"<body><article>{body}</article><section id=comments>{long}</section></body>")
    assert html_extract.main_text("<div class=footer><a href=/>Foot</a></div>") == ""


def test_html_doubtful_names(spark):
    prose = lambda w: "".join(f"<p>{w} {k} of the article says a number of things at some length.</p>" for k in range(4))
    for name in ("legal", "related-work", "rail", "popular", "copyright", "disclaimer", "trending"):
        part = f'<section class="{name}"><h2>A part</h2>{prose("Sentence")}</section>'
        got = html_extract.main_text(f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{prose('Paragraph')}{part}</article></body>").split("\n\n")
        assert got[0] == "Title" and len(got) == 10 and got[5] == "A part", name
        links = f'<div class="{name}"><ul>' + "<li><a href=/x>Something else to read here</a></li>" * 5 + "</ul></div>"
        got = html_extract.main_text(f"<body><article><h1>Title</h1>{prose('Paragraph')}{links}</article></body>").split("\n\n")
        assert len(got) == 5, name
    assert html_extract.main_text("<p>one<br>two<br/>three<wbr>four</p>five") == "one two threefour\n\nfive"


@pytest.mark.parametrize("piece", ["<b>x</i>", '<div class="ad">x', "<div class=comments><h1>x</h1>", '<div class="widget">x', "<h1>x", "<table><td>x", "<!--", "<a ", "<a b='", "<svg><![CDATA[", "<?x", "<![", "</a ", "<article><main>x"])
def test_html_takes_linear_time(piece):
    def took(n):
        began = time.process_time()
        html_extract.main_text(piece * n)
        return time.process_time() - began

    took(100)
    assert min(took(20_000) for _ in range(2)) <= 5 * max(took(5000), 0.05)


def test_html_keeps_the_parts_of_an_article():
    prose = lambda w: "".join(f"<p>{w} {k} of the article says a number of things at some length.</p>" for k in range(5))
    heads = lambda h: [x for x in html_extract.main_text(h).split("\n\n") if "says a number" not in x]
    body = f"<h1>T</h1>{prose('P')}"
    assert heads(f"<article><header><h1>Title</h1><h2>Sub</h2><p>by me</p></header>{prose('P')}</article>") == ["Title", "Sub"]
    page = f'<article>{body}<section id="share-prices"><h2>Shares</h2>{prose("S")}</section><section id="notice"><h2>Notice</h2>{prose("N")}</section></article>'
    assert heads(page) == ["T", "Shares", "Notice"] and html_extract.main_text(page).count("says a number") == 15
    assert heads(f'<article>{body}<h2 id="social-history">History</h2><h2 id="comments">On comments</h2>{prose("S")}</article>') == ["T", "History", "On comments"]
    own = '<p class="comment-on-law">The comment on the law stands by itself.</p><div class="widget"><p>The widget has an article paragraph.</p></div>'
    assert heads(f"<article>{body}{own}</article>") == ["T", "The comment on the law stands by itself.", "The widget has an article paragraph."]
    page = f"""<body><header><a href=/>Home</a><h1>Site</h1></header><div id=content><div class="page-header"><h1>T</h1></div>{prose('P')}<section id="share-prices"><h2>Shares</h2>{prose('S')}</section></div>
        <section id=comments>{prose('Reader')}</section><div class="ad-slot-3">{prose('Buy')}</div><aside>{prose('Beside')}</aside><div class="cookie-banner">We use cookies.</div><footer>f</footer>"""
    assert heads(page) == ["T", "Shares"]
    assert not any(w in html_extract.main_text(page) for w in ("Reader", "Buy", "Beside", "cookies"))


def test_html_edges(spark):
    page = "<article><h1>T</h1>" + "<p>Long prose stands here, in a paragraph.</p>" * 20_000 + "</article>"
    rows = [(1, None, 3), (2, "", 4), (3, page, 5), (4, "<p>x</p>", 6), (4, "<p>x</p>", 6), (None, "a &amp; b", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, N_Chars int")
    got = sorted(((r.page_id, r.n_chars, r.text.count("\n\n")) for r in html_extract.extract(df).collect()), key=repr)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (3, 1 + 20_000 * 41, 20_000), (4, 1, 0), (4, 1, 0), (None, 5, 0)], key=repr)
    assert html_extract.extract(df.limit(0)).collect() == []


def test_html_on_pages(spark):
    """The tables' pages hold the article in <article>: the golden text is its paragraphs, read by plain expressions."""
    pages = common.table(spark, SMALL, "pages")
    for r in html_extract.extract(pages).select("html", "text", "n_chars").collect():
        inner = re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->", "", re.search(r"(?s)<article>(.*)</article>", r.html)[1])
        parts = [html.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?(?:h[1-6]|p|ul|ol|li|table|tr|td|th|div|section|blockquote|pre)\b[^>]*>", inner)]
        golden = "\n\n".join(t for x in parts if (t := " ".join(x.split())))
        assert r.text == golden and r.n_chars == len(golden)


def _rule_by_hand(url, rules):
    """(host, path, rule, verdict of the rule) by plain string steps."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("#")[0].split("?")[0]
    fits = [(len(rule), -k, verdict, rule) for k, (verdict, rule) in enumerate(rules) if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
    return host, path, max(fits)[3] if fits else None, max(fits)[2] if fits else None


def test_url_rules_by_hand(spark):
    urls = common.table(spark, SMALL, "pages").select("url").toPandas()["url"].tolist()
    urls += [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?q#f", "https://a.net/es/", "https://a.example.com/en/?x", "x://net/fr/", "x://anet/fr/", "x://a.com", "x://a.com/", "x://a.com?/", "x://ÉX.com/ä", "a://b://c.net/es/", "x://\nnet/es/"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    for r in got:
        host, path, rule, verdict = _rule_by_hand(r.url, url_filter.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert (r.score is None) == (rule is not None)
    assert len(got) == len(urls)


def test_url_edges(spark):
    rows = [(1, None, 5), (1, "x://a.com/b", 6), (1, "x://a.com/b", 6), (2, "x://n.net/es/", None), (3, "x://b.org/" + "y" * 100_000, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, Host int")
    got = sorted((r.page_id, r.host, r.verdict) for r in url_filter.judge(df).collect())
    assert [g[1] for g in got] == ["", "a.com", "a.com", "n.net", "b.org"] and got[1] == got[2] and got[3][2] == "block"
    assert url_filter.judge(df.limit(0)).collect() == []
    assert {r.verdict for r in url_filter.judge(df.where("page_id = 3")).collect()} == {"allow"}


def test_url_trees_on_held_out_urls(spark, monkeypatch):
    """Labels that follow the form of a url, not its words; 350 labelled urls are never seen in training."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcdefghilmnorstu", k=rnd.randint(3, 11)))
    good = [f"https://{rnd.choice(['', 'www.', 'm.'])}{word()}.example.org/{word()}/{k}" for k in range(400)]
    bad = [f"http://{word()}-{word()}-{rnd.randint(10, 999)}.{rnd.choice(['example.org', 'example.com'])}/{word()}/{word()}/{k}?id={k}&ref={word()}" for k in range(100)]
    rows = [(k, u, k >= 400) for k, u in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    labelled = df.select("url", F.col("bad").alias("blocked")).union(spark.createDataFrame([(None, True), ("x", None)], "url string, blocked boolean"))
    for most in (url_filter.MOST_SUFFIXES, 0):
        monkeypatch.setattr(url_filter, "MOST_SUFFIXES", most)
        monkeypatch.setattr(common, "HOT_ROWS", 100 if most else 20)
        got = url_filter.judge(df, rules=(), labelled=labelled, sample=150).collect()
        assert len(got) == len(rows) and sum((r.verdict == "block") == r.bad for r in got) >= 0.95 * len(rows)


def test_url_trees_carry_the_rules_over(spark):
    """Without a labelled table the rules label: what shares the form of ruled urls gets their verdict."""
    rows = [(k, f"https://a{k % 9}.{'net' if k % 2 else 'com'}/{'es' if k % 2 else 'en'}/{k}") for k in range(200)] + [(1000 + k, f"https://b{k}.org/es/{k}") for k in range(5)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[k] == ("block" if k % 2 else "allow") for k in range(200)) and all(got[1000 + k] == "block" for k in range(5))
