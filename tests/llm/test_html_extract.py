import html
import random
import re

import pytest

from motifel.llm import html_extract as hx
from motifel.llm.dom import Page, decode, features
from motifel.llm.html_pages import pages

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def model():
    return hx.trained()


@pytest.mark.parametrize("silent,least", [(False, 0.98), (True, 0.92)])
def test_held_out_pages(model, silent, least):
    """Precision and recall of characters; silent: without any class, id and role."""
    right = wrong = missed = 0
    for h in pages(200, seed=1234):
        p = Page(re.sub(r' (?:class|id|role)="[^"]*"', "", h) if silent else h)
        y, kept = hx.labels(p), decode(p.parents, model.probabilities(features(p)))
        for t, a, b in zip(p.texts, y, kept, strict=True):
            right += len(t) * bool(a and b)
            wrong += len(t) * bool(b and not a)
            missed += len(t) * bool(a and not b)
    assert right / (right + wrong) > least and right / (right + missed) > least


def test_siblings_of_one_kind_are_counted_at_every_size():
    """One div among many paragraphs is alone of its kind, on long pages too."""
    from motifel.llm.dom import KINDS, WORDS

    for n in (10, 100):
        page = Page("<body>" + "<p>some words</p>" * n + "<div>an advert</div></body>")
        x = features(page)
        column = 2 * len(KINDS) + 3 * len(WORDS) + 19
        shares = sorted({round(float(v), 4) for v in x[:, column] if v < 1})
        assert shares == [round(1 / (n + 1), 4), round(n / (n + 1), 4)]


def test_decoding_is_the_best_consistent_choice():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        parents = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        p = rng.random(n)
        score = lambda k: sum(np.log(p[i] if k[i] else 1 - p[i]) for i in range(n))  # noqa: E731, B023
        allowed = [k for k in itertools.product([0, 1], repeat=n) if all(not k[i] or parents[i] < 0 or k[parents[i]] for i in range(n))]
        got = decode(parents, p)
        assert all(not k or parents[i] < 0 or got[parents[i]] for i, k in enumerate(got))
        assert abs(score(got.tolist()) - max(map(score, allowed))) < 1e-9


@pytest.mark.parametrize(
    "source,leaves",
    [
        ("<p>a &amp; b<br>c<p>d&nbsp;e", ["a & b c", "d e"]),
        ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]),
        ("<div>one<div>two</div>three</div>", ["one", "two", "three"]),
        ("<!-- <p>no --><script>var a='</p>';</script><style>p{}</style><p>yes", ["yes"]),
        ("a < b <i>and</i> c", ["a < b and c"]),
        ("<p title='a>b'>q</p", ["q</p"]),
        ("", []),
        ("<<<>>>&#x;&#xZ;&bogus;", None),
        ("<title>t</title><h1>  H \n 1 </h1>", ["H 1"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ],
)
def test_blocks(source, leaves):
    got = [t for t in Page(source).texts if t]
    assert leaves is None or got == leaves


def test_broken_markup_never_fails(model):
    rng = random.Random(5)
    bits = ["<p>", "</p>", "<div", ">", "<ul>", "<li>", "</ul>", "text ", "&amp;", "<!--", "-->", "<script>", "</script>", "'", '"', "<a href=x>", "</a>", "</body>", "<td>", "\x00", "é"]
    hx.main_texts(["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)], model)


def test_hard_cases(spark):
    deep = "<div>" * 3000 + "<p>deep</p>"
    long = "<article>" + "<p>many words of an article, again and again.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, "x", "y"), (2, None, "", None, None), (None, "v", "<p>", None, None), (3, "w", deep, None, None), (4, "w", long, None, None), (4, "w", long, None, None)]
    got = {(r.page_id, r.url): r for r in hx.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, "u"].text == "" and got[2, None].n_chars == 0 and (None, "v") in got
    assert got[4, "w"].text.count("\n") == 19_999 and got[4, "w"].n_chars == len(got[4, "w"].text)
    assert hx.extract_main_text(spark.createDataFrame(rows, SCHEMA)).count() == 6
    assert hx.extract_main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark, data_dir):
    web = spark.read.parquet(f"{data_dir}/pages.parquet")
    got = {r.page_id: r.text for r in hx.extract_main_text(web).collect()}
    for r in web.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)
