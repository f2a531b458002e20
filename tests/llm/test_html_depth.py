"""Very deep pages take time in proportion to their length."""

import time

import pytest

from lintlake.llm import html_text

WORDS = "words of the article that go on for a while and on and on "


@pytest.mark.parametrize(
    "page",
    [
        "<body>" + "<div>" * 100_000 + "<p>" + WORDS * 40 + "</p>" + "</div>" * 100_000,
        "<body><article>" + "<b>" * 50_000 + "".join(f"<p>{WORDS}</p>" for _ in range(5_000)) + "</article>",
        "<article>" * 30_000 + "<p>" + WORDS * 40,
        "<p><div>" + "<i>" * 30_000 + "".join(f"<li>{WORDS}" for _ in range(5_000)),
        "<body>" + "<h2>t</h2><p>" * 20_000 + WORDS * 40,
    ],
)
def test_deep_pages(page):
    began = time.monotonic()
    assert "words of the article" in html_text.main_text(page)
    assert time.monotonic() - began < 20


def test_closing_tags_stay_in_their_cell():
    page = f"<article><table><tr><td><b>{WORDS}<td>{WORDS}</b><p>{WORDS}</table><p>{WORDS}</article>"
    assert html_text.main_text(page).count("words of the article") == 4
