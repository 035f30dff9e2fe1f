"""Which parts of a page the names, word counts and link densities leave as main text."""

import pytest
from callsight.llm import html_text

TREE = html_text.trained()
PROSE = "a long dry summer left the wells of the upper valley empty and the farmers had to fetch water from the lake by cart"
LINKS = "<ul>" + "".join(f"<li><a href=/{k}>other things that have happened in {k}</a></li>" for k in (1990, 1991, 1992)) + "</ul>"
ARTICLE = f"<article><h1>No rain</h1><p>{PROSE}</p></article>"
TEXT = f"No rain {PROSE}"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='content has-sidebar'>{ARTICLE}</div>", TEXT),
        (f"<div class='post tag-politics'>{ARTICLE}</div>", TEXT),
        (f"<div class=related>{ARTICLE}</div><footer>about us</footer>", TEXT),
        (f"<div class=search><main><h1>No rain</h1><p>{PROSE}</p></main><div class=ad>buy now</div></div>", TEXT),
        (f"<div class=notice><p>{PROSE}</p><p>{PROSE}</p></div><div><a href=x>home</a></div>", f"{PROSE} {PROSE}"),
        # names that do count
        (f"{ARTICLE}<div class=comments><article>{PROSE} {PROSE}</article></div>", TEXT),
        (f"{ARTICLE}<section class='related-posts'><article><p>{PROSE}</p></article></section>", TEXT),
        (f"{ARTICLE}<div id=site-footer><p>{PROSE} {PROSE}</p></div>", TEXT),
        # words and links decide
        (f"<article><h1>No rain</h1><p>{PROSE}</p>{LINKS}<p>{PROSE}</p></article>", f"{TEXT} {PROSE}"),
        (f"<article><p>{PROSE}</p><div>only now <a href=x>get two of them for the price of one</a></div><p>{PROSE}</p></article>", f"{PROSE} {PROSE}"),
        (f"{ARTICLE}<div><p>{PROSE} {PROSE}</p><p>{PROSE} {PROSE}</p></div>{LINKS}", f"{TEXT} {PROSE} {PROSE} {PROSE} {PROSE}"),
        (f"{ARTICLE}<p>{PROSE}</p>", TEXT),
    ],
)
def test_parts(page, text):
    assert html_text.main_text(page, TREE) == text


@pytest.mark.parametrize(
    "page",
    [
        f"<div title='The hidden valley'>{ARTICLE}</div>",
        f"<div class='flex hidden md:block'>{ARTICLE}</div>",
        f"<form action=x><div>{ARTICLE}</div><input name=q></form>",
        f"<a name=top>{ARTICLE}",
        f"<a href=x>one<a href=y>two</a>{ARTICLE}",
        f"<a href=x>one<div>{ARTICLE}</div>",
        *[f"<{tag}>go{ARTICLE}" for tag in ("button", "svg", "select", "object", "textarea", "iframe", "noscript", "nav", "aside")],
        f"<svg><title>icon</title><path d='x'/></svg><noscript><p>{PROSE}</p></noscript>{ARTICLE}",
        f"<div hidden><p>{PROSE}</p></div><p style='display: none'>{PROSE}</p><div aria-hidden=true>{PROSE}</div>{ARTICLE}",
        f"{ARTICLE}<script>var x",
        f"<h1>No rain</h1><p>{PROSE}</p>",
        f"<form><div><a href=x>home</a></div><div><h1>No rain</h1><p>{PROSE}</p></div></form>",
    ],
)
def test_no_article_is_lost(page):
    assert html_text.main_text(page, TREE) == TEXT


def test_parts_inside_an_article_still_go():
    page = f"<article><h1>No rain</h1><form><p>{PROSE}</p></form><button>share it</button><p>{PROSE}</p></article>"
    assert html_text.main_text(page, TREE) == TEXT


FLAGS = 5  # the features ahead of the word counts and link densities: own, before, after


def split_on(node):
    return set() if node.low is None else {node.feature} | split_on(node.low) | split_on(node.high)


def test_the_tree_reads_the_neighbours():
    used = split_on(TREE)
    assert used & {FLAGS + 2, FLAGS + 3} and used & {FLAGS + 4, FLAGS + 5}
    long, short = f"<div>{PROSE} {PROSE}</div>", "<div>the well in spring</div>"
    link = "<div><a href=x>all the news of this week</a></div>"
    found = lambda page: "the well in spring" in html_text.main_text(page, TREE)
    assert found(long + short + long) and not found(long + link + short + link) and not found(link + short + link + long)


def test_labelled_pages_are_varied():
    blocks = [b for page in html_text.LABELLED for b in html_text.blocks(page)]
    assert len(blocks) > 250 and len({b.words for b in blocks}) > 40
