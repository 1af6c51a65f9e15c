"""Wrappers: the expressions against Python's own regular expressions, and the main text that they locate."""

import json
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from helixframe.llm import html_wrapper as hw

SF = "/root/testdata/sf0.01"


def pattern(items, names):
    """An expression as a pattern of Python's re, one character a label."""
    out = ""
    for mark, inner in items:
        one = names.setdefault(inner, chr(0x4E00 + len(names))) if isinstance(inner, str) else pattern(inner, names)
        out += f"(?:{one})" + ("" if mark == "1" else mark)
    return out


def accepts(items, labels):
    names = {}
    made = re.compile(pattern(items, names))
    return bool(made.fullmatch("".join(names.get(x, "!") for x in labels)))


def checked(node, element):
    """Every element of a packed page is described by its expression, by re and by the matcher; how many there are."""
    labels = ["#" if len(k) == 3 else k[0] for k in element[3]]
    cost, atoms = hw.Expression(node["s"]).match(labels)
    assert cost == 0 and accepts(node["s"], labels)
    return 1 + sum(checked(node["k"][a], k) for k, a in zip(element[3], atoms, strict=True) if len(k) == 4)


def test_expressions_describe_what_they_were_made_of():
    rng = random.Random(4)
    for _ in range(300):
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 4))]
        many = []
        for _ in range(rng.randint(1, 6)):
            s = [rng.choice("xyz")] * rng.randint(0, 2)
            for _ in range(rng.randint(0, 5)):
                s += [u for u in unit if rng.random() < 0.9]
            many.append(s + [rng.choice("abxyz") for _ in range(rng.randint(0, 3))])
        items = hw.expression(many)
        for s in many:
            assert accepts(items, s) and hw.Expression(items).match(s)[0] == 0, (items, s)
        for _ in range(20):  # matcher and re agree on other sequences too
            s = [rng.choice("abcdxyz") for _ in range(rng.randint(0, 6))]
            assert (hw.Expression(items).match(s)[0] == 0) == accepts(items, s), (items, s)


def test_mismatches_become_optional_and_repeated_groups():
    assert hw.expression([["h", "p", "p"], ["h", "p", "x"]]) == [["1", "h"], ["+", "p"], ["?", "x"]]
    assert hw.expression([["t", "d", "t", "d", "t", "d"]]) == [["+", [["1", "t"], ["1", "d"]]]]
    assert hw.expression([["a", "b"], ["b"]]) == [["?", "a"], ["1", "b"]]
    rng = random.Random(5)
    wide = hw.expression([[f"l{rng.randint(0, 40)}" for k in range(300)], ["l5", "l2", "new"]])
    assert wide[0][0] == "*" and accepts(wide, ["new", "l9", "l0", "l0"])
    assert hw.expression([[f"l{k}" for k in range(100)], ["l5"]]) == [["*", hw.ANYTHING]]


def test_every_host_s_expression_describes_its_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("parse_url(url, 'HOST') host", "html").collect()
    hosts = defaultdict(set)
    for r in rows:
        hosts[r.host].add(r.html)
    for pages in hosts.values():
        trees = [hw.packed(hw.tree(p)) for p in sorted(pages)]
        assert sum(checked(hw.inferred(trees), t) for t in trees) >= 5 * len(trees)


def blocks(page):
    """By hand for the given pages: what stands in the article, cut at the tags that break lines."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    import html

    parts = re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))
    texts = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts)
    return "\n".join(t for t in texts if t)


def test_given_pages_come_from_their_wrapper(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = hw.extracted(pages).collect()
    assert len(got) == pages.count() and all(r.main_text == blocks(r.html) for r in got)
    # another host's expression, of another place, does not describe them
    other = hw.inferred([hw.packed(hw.tree(f"<html><body><div class=top>Site</div><div id=c{k}><h2>{k} of {k}</h2><p>text {k}</p></div></body></html>")) for k in range(3)])
    hw.prepare(other)
    assert all(hw.main_text(hw.tree(r.html), other) != r.main_text for r in got)


def neutral(html):
    """Pages without kinds of elements, classes, ids and roles that tell what stands in them."""
    plain = F.regexp_replace(html, r"<(/?)(?:nav|aside|header|footer|form|article|main)\b", "<$1div")
    return F.regexp_replace(plain, r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "")


def test_without_names_the_alignment_of_a_host_finds_the_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    neutral_pages = pages.withColumns({"main_text": F.lit(""), "html": neutral(F.col("html"))})
    want = {r.page_id: r.main_text for r in hw.extracted(pages).collect()}
    got = {r.page_id: (r.main_text, r.html) for r in hw.extracted(neutral_pages).collect()}
    assert sum(want[k] == text for k, (text, _) in got.items()) >= 0.9 * len(want)
    some = sorted(got)[:200]
    assert not any(hw.page_text(got[k][1], None) == want[k] for k in some)  # one page by itself does not tell


def test_hosts_in_several_tasks_and_columns_of_any_name(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html", F.col("page_id").alias("host"), F.lit("w").alias("Wrapper"), F.lit(3).alias("salt_"))
    none = pages.limit(2).withColumns({"url": F.lit(None).cast("string"), "page_id": F.col("page_id") + 10**6})
    both = pages.unionByName(none)
    plain = {r.page_id: tuple(r) for r in hw.extracted(both).collect()}
    monkeypatch.setattr(hw, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(hw, "BUCKET", 3)
    out = hw.extracted(both)
    assert out.columns == ["page_id", "url", "html", "host", "Wrapper", "salt_", "main_text"]
    assert {r.page_id: tuple(r) for r in out.collect()} == plain and len(plain) == both.count() and all(r[3] == k or k >= 10**6 for k, r in plain.items())


PAGE = "<html><body><div id=top>Site</div><div class=bar>{extra}<a href=x>{0} link one</a> <a href=y>link two {0}</a></div><div id=c><h2>{0} title</h2><div>{0} one &amp; more</div>{body}</div><section class='comments'><p>hi {0} and a long remark of a reader on {0}</p></section><div>Copyright</div></body></html>"


def site(k, paragraphs, extra=""):
    return PAGE.format(f"w{k}", body="".join(f"<div>line {j} of w{k}</div>" for j in range(paragraphs)), extra=extra)


def wanted(k, paragraphs):
    return "\n".join([f"w{k} title", f"w{k} one & more", *(f"line {j} of w{k}" for j in range(paragraphs))])


def test_unmarked_hosts_with_optional_and_repeated_groups(spark):
    long = 9000
    pages = [("http://a.example/%d" % k, site(k, n, "<hr><i>x</i>" if k % 2 else "")) for k, n in enumerate([2, 5, 1, 7, 3, long])]
    copies = [pages[0]] * 50
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages + copies)], "page_id bigint, url string, html string").withColumn("wrapper", F.lit(1))
    got = {r.page_id: r.main_text for r in hw.extracted(df).collect()}
    assert len(pages[5][1]) > 65_536 and len(got) == 56
    for k, n in enumerate([2, 5, 1, 7, 3, long]):
        assert got[k] == wanted(k, n)
    assert all(got[k] == wanted(0, 2) for k in range(6, 56))


def test_the_wrapper_decides():
    pages = [f"<body><div>Welcome to the site of many long words</div><div><p>{k} first</p><p>second of {k * 60}</p></div><div>All rights reserved by the company</div></body>" for k in "abcde"]
    own = hw.inferred([hw.packed(hw.tree(p)) for p in pages])
    assert own["place"] and hw.page_text(pages[0], hw.ready_wrapper(json.dumps(own))) == "a first\nsecond of " + "a" * 60
    alone = hw.page_text(pages[0], None)
    assert "Welcome" in alone and "reserved" in alone  # one page cannot tell what is template


def test_constants_go_only_where_the_template_has_them():
    page = "<body><div><p>Share this page</p><p>story {0} with its words</p><p>Share this page</p><p>{0}</p></div></body>"
    pages = [page.format(k) for k in ("one", "two", "three")]
    pages.append("<body><div><p>other start</p><p>Share this page</p><p>Share this page</p><p>end</p></div></body>")
    own = hw.inferred([hw.packed(hw.tree(p)) for p in pages])
    hw.prepare(own)
    assert hw.page_text(pages[3], own) == "other start\nShare this page\nShare this page\nend"
    near = [f"<article><h1>Title</h1><p>The same long story told word for word</p><p>{k}</p></article>" for k in range(5)]
    own = hw.inferred([hw.packed(hw.tree(p)) for p in near])
    hw.prepare(own)
    assert hw.page_text(near[2], own) == "Title\nThe same long story told word for word\n2"


def test_marked_articles():
    page = "<body><header>H</header><nav>n</nav><article><header><h1>T</h1></header><p>one<script>x</script> two<p><b>three<br>four<form>f</form><aside>s</aside><div class='share-bar'>sh</div></article><div id='comments'><article>c</article></div><footer>f</footer>"
    assert hw.page_text(page, None) == "T\none two\nthree four"


def test_odd_pages(spark):
    page = "<html><body><nav>n</nav><article><h1>T&amp;é</h1><p>a  b\n c</p></article><footer>f</footer></body></html>"
    rows = [(1, "http://a.example/x", page), (2, None, None), (3, "no url", ""), (4, "http://A.example/y", page), (4, "http://A.example/y", page), (5, "", "<p>only"), (6, "http://a.example/z", None), (7, "http://a.example/q", "<table><tr><td>other</table>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1))
    got = hw.extracted(df).collect()
    assert Counter((r.page_id, r.main_text) for r in got) == Counter({(1, "T&é\na b c"): 1, (2, ""): 1, (3, ""): 1, (4, "T&é\na b c"): 2, (5, "only"): 1, (6, ""): 1, (7, "other"): 1})
    assert hw.extracted(df.limit(0)).count() == 0
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>" + "x" * 100_000
    assert hw.page_text(deep, None) == "deep\n" + "x" * 100_000
    wide = "".join(f"<{t}>{k}</{t}>" for k, t in enumerate(random.Random(1).choices(["div", "p", "section", "h2", "ul"], k=20_000)))
    assert hw.page_text(wide, None).count("\n") == 19_999
    names = "".join(f"<div class=a{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}>{k}</div>" for k in range(5000))
    assert hw.page_text(names, None).count("\n") == 4999
    assert hw.page_text("", None) == "" and hw.page_text("plain", None) == "plain"
    assert hw.page_text("<p>a<!-- <p>no --> b <textarea>q", None) == "a b"
    assert hw.page_text("<article><p>one</article><p>after", None) == "one\nafter"
