import html as references
import re

import numpy as np

from weft.llm import html_text
from weft.llm.html_text import RUN, chunk_runs, extract_main_text, main_text, run_hash, suffix_array


def test_structure():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body class="home menu">
    <header><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav><div class="ad-box ad">Buy</div><!-- <p>no</p> -->
    <article><h1>A &amp; B</h1><p>One  <b>two\nthree</b> &eacute;&#33;<p>Four<br>five<form><p>Sign up</form><aside>Side</aside>
    <blockquote>six <a href="x>y">seven</a></blockquote><div class="comments"><p>First!</div><p>ei<i>gh</i>t</article>
    <article class="comment">Me too</article><footer>&copy; us</footer>"""
    assert main_text(page) == "A & B\nOne two three é!\nFour\nfive\nsix seven\neight"
    assert main_text("") == "" and main_text("<nav>x</nav>") == "" and main_text("<p>open text") is None
    assert main_text("<article><p>in</article><p>out") == "in"
    assert main_text('<main role="main"><p>cut off in <b') == "cut off in"
    assert main_text("<article>1 < 2 &amp &nosuch; &#x41;</article>") == "1 < 2 & &nosuch; A"


def test_shared_pages(spark):
    """Exactly the article's blocks of every page."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r for r in extract_main_text(pages).collect()}
    for p in pages.collect():
        article = p.html[p.html.index("<article>") + 9 :].split("</article>")[0]
        parts = (" ".join(references.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:h1|p|br)>", article))
        want = "\n".join(x for x in parts if x)
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want) and rows[p.page_id].url == p.url


def test_suffix_array_and_runs():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 3, 300)
    order, rank = suffix_array(codes, 8)
    prefix = [tuple(codes[i : i + 8]) for i in range(300)]
    assert [prefix[i] for i in order] == sorted(prefix)
    assert all((rank[i] == rank[j]) == (prefix[i] == prefix[j]) for i in range(0, 300, 7) for j in range(300))
    streams = [(k, [str(x) for x in rng.integers(0, 2, 40)]) for k in range(6)]
    want = {}
    for k, t in streams:
        for i in range(len(t) - RUN + 1):
            want.setdefault(run_hash(t[i : i + RUN]), set()).add(k)
    assert {h: (a, b) for h, a, b in chunk_runs(streams)} == {h: (min(v), max(v)) for h, v in want.items()}
    assert chunk_runs([]) == [] and chunk_runs([(1, ["a"])]) == []


def test_undecided_pages(spark, monkeypatch):
    monkeypatch.setattr(html_text, "CHUNK_PAGES", 3)
    shared = "this line of ten words stands on every single page"
    data = [(k, f"http://H.x/{k}", f"<div>{shared}</div><p>{k}own text " + " ".join(f"w{k}x{i}" for i in range(20)) + f"</p><nav>menu {k}</nav>") for k in range(12)]
    data += [(50, "http://other/1", f"<p>{shared}</p>"), (51, "http://h.x/a", f"<article><p>{shared}</article>"), (52, None, None), (0, data[0][1], data[0][2]), (None, None, "<p>no id</p>")]
    pages = spark.createDataFrame([(*d, 1, "t") for d in data], "page_id long, url string, html string, __row int, text string")
    rows = extract_main_text(pages).collect()
    assert len(rows) == len(data)
    text = {r.page_id: r.text for r in rows}
    for k in range(12):
        assert text[k] == f"{k}own text " + " ".join(f"w{k}x{i}" for i in range(20))
    assert text[50] == text[51] == shared and text[52] == "" and text[None] == "no id"
    assert extract_main_text(pages.limit(0)).count() == 0


def test_mirrored_pages(spark):
    """Two copies of an unmarked page keep their text; a line that other pages have too goes."""
    shared = "this line of ten words stands on every single page"
    own = " ".join(f"w{i}" for i in range(30))
    data = [(k, f"http://h.x/?ref={k}", f"<div>{shared}</div><p>{own}</p>") for k in (1, 2)] + [(3, "http://h.x/3", f"<div>{shared}</div><p>other</p>")]
    rows = extract_main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in rows} == {1: own, 2: own, 3: "other"}
