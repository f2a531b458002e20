import pytest

from lintlake.llm import html_text


def words(k, n=1):
    return f"<p>{f'part {k} has many plain words, ' * 9}</p>" * n


def lines(k, n=1):
    return [(f"part {k} has many plain words, " * 9).strip()] * n


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<body><div id=page><h1>A title</h1><div class=part>{words(1, 3)}</div><div class=part>{words(2, 2)}</div></div>", ["A title", *lines(1, 3), *lines(2, 2)]),
        (f"<body><div class=wrap><h1>A title</h1><div class=content>{words(1, 3)}</div></div>", ["A title", *lines(1, 3)]),
        (f"<body><div><div class=top><h1>A title</h1></div><div><section>{words(1, 3)}</section></div><h2>More</h2><div><div>{words(2)}</div></div></div>", ["A title", *lines(1, 3), "More", *lines(2)]),
        (f"<body><div><h1>Site</h1><div><h1>A title</h1>{words(1, 3)}</div><div><h3>Box</h3>small</div></div>", ["A title", *lines(1, 3)]),
    ],
)
def test_parts_at_any_depth(html, want):
    assert html_text.main_text(html).split("\n") == want


ASP = f"<form id=aspnetForm><article><h1>A title</h1>{words(1, 2)}</article></form>"


@pytest.mark.parametrize(
    "html, want",
    [
        (ASP, ["A title", *lines(1, 2)]),
        (f"<form><div class=content><h1>A title</h1>{words(1, 3)}</div></form>", ["A title", *lines(1, 3)]),
        (f"<article><div class=post-header><h1>A title</h1></div>{words(1)}<section id=discussion><h2 id=Legal_status>Status</h2>{words(2)}</section><div id=social-history><h2 id=form-and-function>Form</h2>{words(3)}</div><div class=share>x</div></article>", ["A title", *lines(1), "Status", *lines(2), "Form", *lines(3)]),
        (f"<body><div class=wrap><div class=post-header><h1>A title</h1></div>{words(1, 2)}<section id=discussion><h2 id=Legal_status>Status</h2>{words(2)}</section><div id=social-history>{words(3)}</div></div>", ["A title", *lines(1, 2), "Status", *lines(2), *lines(3)]),
        (f"<body><div id=sidebar>{words(2)}</div><div class='site-footer'>{words(3)}</div><form>{words(4)}</form><article>{words(1)}<pre>x <span class=comment># note</span></pre></article><div class='post-comments'>{words(3, 5)}</div>", [*lines(1), "x # note"]),
        (f"<html><head><title>t</title><body><div>{words(1, 3)}</div>", lines(1, 3)),
    ],
)
def test_names_and_wrappers_cost_no_article_text(html, want):
    assert html_text.main_text(html).split("\n") == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><h1>T</h1><p class=a\">first text.</p><p>second 'text'.</p></article>", ["T", "first text.", "second 'text'."]),
        ("<article><p title='a > b' data-x=\"c>d\" e=f'g>text</p></article>", ["text"]),
        ("<article><p>formula <math><mi>x</mi>=2</math> end, <label>a label</label></p></article>", ["formula x=2 end, a label"]),
        (f"<article>{words(1, 2)}<div class=related><h2>Related work</h2>{words(2)}</div><div class=share>Share</div><div class=related><a href=x>one more story</a> <a href=y>another</a></div><div class=comments>{words(3)}</div><div class=ad>{words(4)}</div></article>", [*lines(1, 2), "Related work", *lines(2)]),
    ],
)
def test_nothing_of_the_article_goes(html, want):
    assert html_text.main_text(html).split("\n") == want
