"""What is kept of a page and what goes, and what the tree looks at."""

import pytest
from dashloom.llm.html import main_text, tree

PARAGRAPH = "A paragraph with some words in it that is part of the article."
STORY = f"<h1>A title</h1><p>{PARAGRAPH}</p><p>{'One long story about many things. ' * 8}</p>"


def extra(inside):
    """What the article's text has more when it holds `inside` too."""
    frame = "<nav><a href=/>Home</a></nav><article>{}{}</article><footer>All rights reserved.</footer>"
    without, with_it = (main_text(frame.format(STORY, x), tree()) for x in ("", inside))
    assert with_it.startswith(without)
    return with_it[len(without) :].strip()


@pytest.mark.parametrize("inside, text", [
    ("<h2 id='Legal_status'>Legal status</h2>", "Legal status"),
    ("<h2 id='search-algorithms'>Search</h2>", "Search"),
    ("<h2 class='header'>Parts</h2>", "Parts"),
    (f"<section id='related-work'><h2>Related work</h2><p>{PARAGRAPH}</p></section>", f"Related work\n\n{PARAGRAPH}"),
    (f"<section id='discussion'><p>{PARAGRAPH}</p></section>", PARAGRAPH),
    (f"<p class='side'>{PARAGRAPH}</p>", PARAGRAPH),
    ("<p>so <math><mi>x</mi><annotation>tex</annotation></math> is</p>", "so x is"),
    ("<xmp>a <b> &amp; c</xmp>", "a <b> &amp; c"),
    ("<noscript><p>Text for all.</p></noscript>", "Text for all."),
    ("<p>One <label>word</label> in a line</p>", "One word in a line"),
    ("<ul><li><a href=x>First source</a><li><a href=y>Second source</a></ul>", "First source\n\nSecond source"),
])
def test_kept(inside, text):
    assert extra(inside) == text


@pytest.mark.parametrize("inside", [
    f"<div class='discussion'><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>",
    "<div class='more-stories'><a href=x>One story here</a> <a href=y>Another</a></div>",
    "<div class='gdpr'>We use data about you.</div>",
    "<section id=comments><p>I disagree.</p></section>",
    "<p class=ad>Buy this now</p>",
    "<div id='cookie-notice'>We use cookies.</div>",
    "<div class='related-posts'><a href=x>Read this</a></div>",
    "<form><label>Name</label><input></form>",
    "<svg><title>x</title></svg>",
])
def test_goes(inside):
    assert extra(inside) == ""


def test_noscript_of_the_page():
    assert main_text(f"<noscript>Please turn scripts on.</noscript><article>{STORY}</article>", tree()).startswith("A title")


def test_pages_without_article():
    """Only word counts and link densities of a block and its neighbours tell here."""
    links = "".join(f"<div><a href=x>Link number {i}</a></div>" for i in range(4))
    long = "Words of a story that goes on for a while and has no links in it at all, as stories do. " * 3
    page = f"{links}<div>Page tools</div>{links}<h1>The story</h1><p>{long}</p><p>{long}</p><p>It ends well here today.</p>{links}<div>Print mail</div>{links}"
    got = main_text(page, tree())
    assert got == "\n\n".join(["The story", long.strip(), long.strip(), "It ends well here today."])


def test_tree_uses_neighbours():
    used = set()

    def walk(node):
        if node.column >= 0:
            used.add(node.column)
            walk(node.low)
            walk(node.high)

    walk(tree())
    assert used >= {3, 4, 5, 6, 7, 8}  # link density and words of the block, the one before and the one after
