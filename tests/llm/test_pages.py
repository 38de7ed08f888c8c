"""HTML extraction, URL verdicts and WARC derivatives."""

import html
import json
import random
import re

import pytest

from pixelweave.llm import extract, queries, urltrees, warc

RULES = queries.URL_RULES


def lcs_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in "ab")
        places = extract.common(a, b)
        rest = iter(b)
        assert places == sorted(set(places)) and all(any(a[i] == y for y in rest) for i in places)
        assert len(places) == lcs_length(a, b)


def texts(df):
    return {r.page_id: r.text for r in extract.extract(df).collect()}


def test_markup_settles_articles(pages_of):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head>
      <body><header>Head</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="top-ad">Buy</div>
      <article><h1>Title &amp; <i>more</i></h1><p>One
        two&nbsp;&nbsp;three.<p>Open <b>bold<br>next line</p><form><input>Search</form><div id="cookie-notice">Notice</div>
        <ul><li>a<li>b</ul><!-- <p>hidden</p> --><a title="x > y">link</a>&lt;tag&gt; caf&eacute; &#x4e2d;
        <section class="comments"><p>Reader says</p></section><p>Last</article><aside>Side</aside><footer>&copy; F</footer>"""
    got = texts(pages_of([(1, "http://a/b", page)]))[1]
    assert got == "Title & more\nOne two three.\nOpen bold\nnext line\na\nb\nlink<tag> café 中\nLast"


def test_difference_decides_pages_without_article(pages_of):
    def page(*lines):
        return "<body>" + "".join(f"<div>{x}</div>" for x in lines)

    rows = [(1, "http://h.org/a/1", page("Site", "one", "Menu")), (2, "http://h.org/a/2", page("Site", "two", "two more", "Menu")),
            (3, "http://other.org/a/3", page("Site", "alone", "Menu")), (4, "http://h.org/zz/4", page("Site", "four", "End"))]
    found = {r.page_id: (r.text, r.decided_by) for r in extract.extract(pages_of(rows)).collect()}
    assert found == {1: ("one", "difference"), 2: ("two\ntwo more", "difference"), 3: ("Site\nalone\nMenu", "alone"),
                     4: ("four\nEnd", "difference")}


def test_awkward_pages(pages_of):
    long = "<article>" + "<p>x y</p>" * 20_000
    rows = [(1, None, None), (2, "", ""), (3, "http://h/a", "<p"), (3, "http://h/a", "<p"), (4, "http://h/a", "plain text &am"), (5, "http://h/b", long),
            (None, "http://h/c", "<main>z</main>"), (6, "http://h/d", "<article><p>a<script>never closed"), (7, "http://h/d", "</div></p><article>q</article>")]
    found = {(r.page_id, r.url): r for r in extract.extract(pages_of(rows)).collect()}
    assert len(extract.extract(pages_of(rows)).collect()) == 9
    assert found[1, None].text == "" and found[2, ""].text == "" and found[3, "http://h/a"].text == ""
    assert found[4, "http://h/a"].text == "plain text &am" and found[6, "http://h/d"].text == "a" and found[7, "http://h/d"].text == "q"
    assert found[None, "http://h/c"].text == "z" and found[5, "http://h/b"].n_chars == 20_000 * 4 - 1
    assert extract.extract(pages_of([])).count() == 0


def test_nearest_page_is_of_the_same_host(spark):
    rows = [(h, f"/{a}/{b}", (h * 100 + a * 10 + b, 0)) for h in range(3) for a in range(4) for b in range(3)]
    df = spark.createDataFrame([(str(h), p, r) for h, p, r in rows], "host string, path string, row struct<id:long,stamp:long>").repartition(5)
    found = {r.row.id: r.partner.id for r in extract.nearest_pages(df).collect()}
    assert len(found) == len(rows) and all(i // 10 == j // 10 and i != j for i, j in found.items())


def test_nearest_page_shares_the_most_segments(spark):
    rng = random.Random(4)
    paths = {"/" + "/".join(rng.choice(["a", "a-b", "a.c", "b", "", "é"]) for _ in range(rng.randrange(5))) for _ in range(150)} | {"/a", "/a-b", "/a/b"}
    rows = [(h, p, (i, 0)) for i, (h, p) in enumerate((h, p) for h in ("x", "y") for p in sorted(paths))]
    df = spark.createDataFrame(rows, "host string, path string, row struct<id:long,stamp:long>").repartition(7)
    found = {r.row.id: r.partner.id for r in extract.nearest_pages(df).collect()}

    def start(p, q):
        n = 0
        for a, b in zip(p.split("/"), q.split("/")):
            if a != b:
                break
            n += 1
        return n

    assert len(found) == len(rows)
    for host, path, (i, _) in rows:
        best = max(start(path, q) for h, q, (j, _) in rows if h == host and j != i)
        assert rows[found[i]][0] == host and start(path, rows[found[i]][1]) == best


def test_hints_lose_no_article(pages_of):
    body = "<article><p>Whole text.</p></article>"
    pages = {1: f'<div class="content with-sidebar">{body}</div>', 2: f'<div class="no-header">{body}</div>', 3: f'<div class="header">{body}</div>',
             4: f'{body}<div class="comments"><article><p>Me too</p></article></div>', 5: '<div class="advertorial"><p>Whole text.</p></div>',
             6: '<article><p>Whole text.</p><div class="post-comments">Me too</div></article>', 7: f"<footer>{body}</footer><p>Whole text.</p>"}
    got = texts(pages_of([(i, f"http://h{i}/a", f"<body>{p}</body>") for i, p in pages.items()]))
    assert got == dict.fromkeys(pages, "Whole text.")


def test_copies_do_not_delete_each_other(pages_of):
    page = "<body><div>Site</div><div>one</div></body>"
    rows = [(1, "http://h/a", page), (2, "http://h/a?ref=x", page), (3, "http://h/a/copy", page)]
    assert texts(pages_of(rows)) == dict.fromkeys((1, 2, 3), "Site\none")
    assert texts(pages_of([*rows, (4, "http://h/b", page.replace("one", "two"))])) == {1: "one", 2: "one", 3: "one", 4: "two"}


def test_articles_of_the_test_pages(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.page_id: r for r in queries.QUERIES["op4_html_extraction"](spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", row.html, re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner[1] if inner else "")]
        assert found[row.page_id].text == "\n".join(x for x in blocks if x)
        assert found[row.page_id].n_chars == len(found[row.page_id].text)


def place(url):
    _, mark, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if mark else ""
    path = re.match(r"[^?#]*", rest[len(host):])[0] if mark else ""
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_for(host, path):
    fits = []
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits, default=None)


def test_urls_equal_brute_force(spark, pages_of):
    odd = [None, "", "x", "://", "http://", "HTTP://ORG", "http://Org/", "a://b.ORG/es", "a://example.org?x/es/", "a://example.org/es/1#f", "a://q.example.org/en/12",
           "a://notexample.org/es/", "a://xcom/de/", "a://x.com/de", "a://com/de/", "a://ü.com/fr/é?q", "a://b://c/d", "http://h.org/" + "a/" * 20_000]
    rows = [(i, u, None) for i, u in enumerate(odd)] + [(3, odd[3], None), (None, "a://x.net/", None)]
    df = pages_of(rows).unionByName(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id + 1000 AS page_id", "url", "html"),
                                    allowMissingColumns=True)
    urls = {r.page_id: r.url for r in df.collect()}
    found = urltrees.judge_urls(df, RULES).collect()
    assert len(found) == df.count()
    for r in found:
        host, path = place(urls[r.page_id])
        rule = rule_for(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1])
        assert r.verdict == (rule[2] if rule else "block" if r.score >= 0.5 else "allow")
    assert len({round(r.score, 6) for r in found}) > 3


def test_trees_learn_lexical_labels(spark, pages_of):
    rng = random.Random(4)

    def url(bad):
        name = "".join(rng.choice("abcdefgh0123456789" if bad else "abcdefgh") for _ in range(12))
        return f"http://{name}.{'xyz' if bad else 'net'}/{'/'.join(str(rng.randrange(10**6)) for _ in range(4 if bad else 1))}?{'&'.join('a=1' for _ in range(5 * bad))}"

    labelled = spark.createDataFrame([(url(i % 2), i % 2) for i in range(400)], "url string, blocked int")
    fresh = [(i, url(i % 2), None) for i in range(60)]
    found = urltrees.judge_urls(pages_of(fresh), [("allow", "nowhere/")], labelled=labelled).collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in found) >= 58


def test_urls_without_labels(pages_of):
    assert urltrees.judge_urls(pages_of([]), RULES).count() == 0
    only = urltrees.judge_urls(pages_of([(1, "http://a.net/", None)]), RULES).first()
    assert (only.rule, only.score, only.verdict) == (None, 0.0, "allow")
    one_kind = urltrees.judge_urls(pages_of([(1, "http://a.net/", None), (2, "http://a.com/de/", None)]), RULES)
    assert {r.verdict for r in one_kind.collect()} == {"block"}


def test_records_round_trip():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore \xff"
    record = warc.to_bytes([("WARC-Type", "response"), ("X", "ü: y")], block)
    headers, back = warc.from_bytes(record)
    assert back == block and warc.to_bytes(headers, back) == record
    assert warc.from_bytes(b"") == ([], b"") and warc.from_bytes(record[:40])[1] == b""
    assert warc.split_head(b"V\r\nA: 1\r\n  2\r\nbad\r\n\r\nrest") == ([("A", "1 2")], b"rest")


def test_derivatives_refer_to_their_response(spark, pages_of):
    rows = [(1, "http://a/b", "<p>one<br>two &amp; é</p><script>x</script>"), (2, None, None), (3, "http://a/\r\nX: y", ""), (1, "http://a/b", "<p>one</p>")]
    made = warc.responses(pages_of(rows), "2024-01-01T00:00:00Z")
    sources = {(r.page_id, bytes(r.record)) for r in made.collect()}
    out = warc.derive(made).collect()
    assert len(out) == 8 and all(r.source_digest_ok for r in out)
    heads = {warc.value(warc.from_bytes(s)[0], "WARC-Record-ID"): s for _, s in sources}
    ids = {r.record_id for r in out}
    for r in out:
        headers, block = warc.from_bytes(bytes(r.record))
        source = warc.from_bytes(heads[r.refers_to])
        assert warc.value(headers, "WARC-Refers-To") == r.refers_to and block == bytes(r.block) and r.block_digest == warc.digest(block)
        assert warc.value(headers, "WARC-Source-Payload-Digest") == warc.value(source[0], "WARC-Payload-Digest")
        assert warc.value(headers, "WARC-Concurrent-To") in ids and warc.value(headers, "WARC-Target-URI") == warc.value(source[0], "WARC-Target-URI")
        if r.type == "metadata":
            facts = json.loads(block)
            assert [tuple(x) for x in facts["source-headers"]] == source[0] and facts["http-status"] == "HTTP/1.1 200 OK"
    assert {bytes(r.block).decode() for r in out if r.type == "conversion"} == {"one\ntwo & é", "", "one"}


def test_other_records_have_no_derivatives(spark):
    good = warc.to_bytes([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:WRONG")], b"HTTP/1.1 404 No\r\nContent-Type: text/plain; charset=latin-1\r\n\r\n\xe9")
    rows = [(1, None), (2, b""), (3, b"junk"), (4, warc.to_bytes([("WARC-Type", "request")], b"GET /")), (5, good)]
    out = warc.derive(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    assert [(r.page_id, r.type, r.source_digest_ok) for r in out] == [(5, "metadata", False), (5, "conversion", False)]
    assert bytes(out[1].block).decode() == "é"
    assert warc.derive(spark.createDataFrame([], "page_id long, record binary")).count() == 0


@pytest.mark.parametrize("name", ["op6_warc_derivatives", "op10_url_filter"])
def test_queries_have_a_row_for_every_page(spark, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.select("page_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
