"""Main text where classes, roles and forms mislead, and where the cut overrules the element around a block."""

import pytest

from studyplane.llm import html_main

FIRST, SECOND = "This is the first paragraph of the article, with enough words to count, and more.", "And a second one follows it here, which is also long enough to be kept in full."
TEXT = f"<p>{FIRST}</p><p>{SECOND}</p>"


def page(body):
    return f"<html><body><nav><a href=x>Home</a> <a href=y>News</a></nav>{body}<footer>Copyright 2024 by us</footer></body></html>"


@pytest.mark.parametrize(
    "around",
    [
        '<div class="widget"><article>{}</article></div>',
        '<div class="story menu">{}</div>',
        "<form><fieldset>{}</fieldset></form>",
        '<div role="dialog"><article>{}</article></div>',
        '<article class="post"><div class="menu">{}</div></article>',
        '<div class="x1"><div class="q">{}</div></div>',
        "<table><tr><td>{}</td></tr></table>",
    ],
)
def test_elements_around_most_of_the_text_tell_nothing(around):
    assert html_main.main_text(page(around.format(TEXT))) == f"{FIRST}\n\n{SECOND}"


@pytest.mark.parametrize(
    "extra",
    [
        '<section class="reader-comments"><p>Great article, I liked it very much, thanks for it.</p></section>',
        '<div id="respond"><p>Leave a reply, your address will not be published.</p></div>',
        '<div class="gdpr-consent"><p>We and our partners store data on your device.</p></div>',
        '<ins class="adsbygoogle"><p>Buy the best shoes in town now, half price.</p></ins>',
        '<div class="widget"><p>Most read this week, by all of our readers.</p></div>',
        '<div role="dialog"><p>Do you want to stay signed in, on this device?</p></div>',
    ],
)
def test_comments_adverts_and_notices_in_an_article_go(extra):
    assert html_main.main_text(page(f"<article>{TEXT}{extra}</article>")) == f"{FIRST}\n\n{SECOND}"


def overruled(body):
    found = html_main.blocks(page(body))
    cut = html_main.labelled(found)
    return [b.text for b, c in zip(found, cut, strict=True) if c != (html_main._around(b.holder).tells > 0)], [b.text for b, c in zip(found, cut, strict=True) if c]


def test_the_cut_overrules_the_element_around_blocks_that_the_classifier_is_sure_of():
    """A long quote set aside between an article's paragraphs stays, a short note there goes; links go where a class alone speaks for content."""
    quote = " ".join([SECOND] * 6)
    assert overruled(f"<article><p>{FIRST}</p><aside><p>{quote}</p></aside><p>{SECOND}</p></article>") == ([quote], [FIRST, quote, SECOND])
    assert overruled(f"<article><p>{FIRST}</p><aside><p>Also by us</p></aside><p>{SECOND}</p></article>") == ([], [FIRST, SECOND])
    links = "".join(f"<li><a href=x{k}>Read this one too</a></li>" for k in range(6))
    gone, kept = overruled(f'<div class="post">{TEXT}<ul>{links}</ul></div>')
    assert len(gone) == 6 and kept == [FIRST, SECOND]


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + TEXT + "</div>" * 3000
    assert html_main.main_text(page(f"<article>{deep}</article>")) == f"{FIRST}\n\n{SECOND}"
    many = "".join(f"<p>{FIRST} Number {k}.</p>" for k in range(3000))
    assert html_main.main_text(page(f"<article>{many}</article>")).count("\n\n") == 2999
