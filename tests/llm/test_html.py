"""Operator 7 against pages whose article is known, with what is no article around it and inside it."""

import html
import random

import pytest

from tidemark.llm import html_text

WORDS = "river stone amber quiet market window copper garden letter signal harbour meadow velvet winter lantern".split()
ASIDES = [
    '<div class="ad">{}</div>', '<aside>{}</aside>', '<section class="comments"><p>{}</p><p>{}</p></section>', '<div id="cookie-notice">{}</div>', '<nav><a href="/x">{}</a></nav>',
    '<form><label>{}</label></form>', '<div class="newsletter-signup">{}</div>', '<footer>{}</footer>', '<div class="related"><ul><li><a href="/y">{}</a></li></ul></div>', "<script>var t = '{}';</script>", "<style>p {{ color: red }} /* {} */</style>",
]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(rnd, holder, inner_asides=True):
    """A page and the text of its article."""
    aside = lambda: rnd.choice(ASIDES).format(*(prose(rnd, rnd.choice([3, 12, 40])).upper() for _ in range(2)))
    blocks, want = [f"<h1>{html.escape(t := prose(rnd, 5))}</h1>"], [t]
    for _ in range(rnd.randint(2, 7)):
        text = prose(rnd, rnd.randint(8, 60))
        at = rnd.randint(1, len(text) - 2)
        marked = f"{text[:at]}<b>{text[at]}</b>{text[at + 1:]}" if text[at] != " " and rnd.random() < 0.3 else text
        blocks.append(f"<p>{marked}</p>")
        want.append(text)
        if inner_asides and rnd.random() < 0.4:
            blocks.append(aside())
    around = lambda: "".join(aside() for _ in range(rnd.randint(0, 3)))
    menu = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rnd.sample(WORDS, 6)) + "</ul></nav>"
    name = holder.split()[0]
    made = f'<html><head><title>{prose(rnd, 4)}</title></head><body>{menu}{around()}<{holder}>{"".join(blocks)}</{name}>{around()}<footer>{prose(rnd, 9)}</footer></body></html>'
    return made, "\n\n".join(want)


@pytest.mark.parametrize("trained", [True, False])
def test_articles_of_generated_pages(spark, trained):
    """200 pages with adverts, notices, forms, menus and comments outside and inside the article give the article alone."""
    rnd = random.Random(11)
    pages = [page(rnd, "article") for _ in range(200)]
    df = spark.createDataFrame([(i, f"u{i}", p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df, weights=None if trained else {}).collect()}
    wrong = [(got[i], want) for i, (_, want) in enumerate(pages) if got[i] != want]
    assert not wrong, (len(wrong), wrong[0])


def test_articles_that_no_element_marks():
    rnd = random.Random(12)
    pages = [page(rnd, 'div class="content"', inner_asides=False) for _ in range(100)]
    assert [html_text.extract(p, {}) for p, _ in pages] == [want for _, want in pages]


def test_learned_weights_do_not_lift_what_is_aside():
    learned = {"word div.ad>": 2.0, "word section.comments>p": 2.0, "tag div.ad": 1.0}
    text = "<article><p>One two three four.</p><div class=ad>Buy this now</div><p>Five six seven.</p><section class=comments><p>first!</p></section></article>"
    assert html_text.extract(text, learned) == "One two three four.\n\nFive six seven."


def test_headers_inside_and_outside_the_article():
    text = "<header><p>Site name and motto</p></header><article><header><h1>Title here</h1></header><p>Body of it, some words.</p><footer>Filed under news</footer></article>"
    assert html_text.extract(text, {}) == "Title here\n\nBody of it, some words."


def test_equal_scores_give_the_first_region():
    far = "<nav>" + "menu " * 30 + "</nav>"
    assert html_text.extract(f"<p>alpha beta gamma</p>{far}<p>delta eta theta</p>", {}) == "alpha beta gamma"
