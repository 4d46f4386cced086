"""Operator 7: parsing, messages against enumeration, and names learnt from labelled pages."""

import itertools
import math

import numpy as np
import pytest

from simtrail.llm import page_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return page_text.train(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><head><title>t</title><body><article><p>One two three.</p></article>", "One two three."),
        ("<head><meta charset=x><link rel=y><article><p>Body unmarked.</p></article>", "Body unmarked."),
        ("<article><p>One <button>Press</button> two x y <script>var a = '</p>';</script>three</p></article>", "One two x y three"),
        ("<article><p>A<textarea>b</textarea>c<p>d<svg><text>e</text></svg></article>", "Ac\nd"),
        ("<div role=main><p>Told by its role.</p></div><nav><p>Home</p></nav>", "Told by its role."),
        ("", ""),
        ("<p", ""),
    ],
)
def test_pages(model, page, text):
    assert model.text(page) == text


def test_role_marks_a_page():
    page = page_text.parse("<div role='main'><p>a</p></div><p>b</p>")
    assert page_text.own_labels(page) == [0, 1, 1, 0]
    assert page_text.own_labels(page_text.parse("<div class=main><p>a</p></div>")) is None


def test_marginals_match_enumeration(model):
    rng = np.random.default_rng(3)
    tags = ["div", "p", "article", "nav", "section", "span2", "footer", "h1"]
    for _ in range(60):
        page, n = page_text.Page(), int(rng.integers(2, 8))
        for i in range(1, n):
            page.parent.append(int(rng.integers(0, i)))
            page.tag.append(str(rng.choice(tags)))
            page.words.append(frozenset(rng.choice(["comments", "content", "x"], rng.integers(0, 2))))
            page.marked.append(False)
            page.own.append(int(rng.integers(0, 300)))
            page.links.append(int(rng.integers(0, 2)) * page.own[-1])
        odds = [sum(model.node.get(x, 0.0) for x in names) for names in page_text.node_features(page)]
        total, content = 0.0, [0.0] * n
        for labels in itertools.product((0, 1), repeat=n):
            score = sum(o * y for o, y in zip(odds, labels))
            for i in range(1, n):
                table = model.edge.get(page.tag[i]) or model.edge["*"]
                score += table[labels[page.parent[i]]][labels[i]]
            weight = math.exp(score)
            total += weight
            content = [c + weight * y for c, y in zip(content, labels)]
        assert model.marginals(page) == pytest.approx([c / total for c in content], abs=1e-9)


def test_names_of_labelled_pages_read_pages_without_marks(spark):
    """A make whose labelled pages use names for the same parts: the names decide where no article is marked."""

    def body(inside, i):
        text = " ".join(f"word{i} and some more of it" for _ in range(6))
        rail = " ".join(f"rail{i} and some more of it" for _ in range(6))
        return f"<body>{inside[0]}<div class=zcopy><p>{text}.</p></div>{inside[1]}<div class=zrail><p>{rail}.</p></div>"

    pages = [(i, "u", body(("<article>", "</article>"), i)) for i in range(40)]
    trained = page_text.train(spark.createDataFrame(pages, "page_id long, url string, html string"))
    prior = page_text.PageModel({})
    page = body(("", ""), 99)
    assert trained.text(page).startswith("word99") and "rail99" not in trained.text(page)
    assert prior.text(page) != trained.text(page)
    few = page_text.train(spark.createDataFrame(pages, "page_id long, url string, html string"), most_names=0)
    assert not any(k.startswith("c:") for k in few.node)
