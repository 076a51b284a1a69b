"""Malformed pages and attributes that only look like others."""

import re

import numpy as np
import pytest

from veta.llm import main_text

LONG = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize("name", sorted(main_text.SILENT - main_text.RAW))
def test_reading_goes_on_after_an_element_without_end_tag(name):
    tree = main_text.grow(*main_text.labelled())
    page = f"<article><p>{LONG}</p><div><{name}>gone<div>gone too</div> and this</div><p>More {LONG}</p><p><{name}>out</{name}></p><p>Last {LONG}</p></article>"
    assert main_text.main_text(page, tree) == f"{LONG}\n\nMore {LONG}\n\nLast {LONG}"
    assert LONG in main_text.main_text(f"<{name}><p>{LONG}", tree)


def test_raw_text_without_end_tag_takes_the_rest():
    tree = main_text.grow(*main_text.labelled())
    assert main_text.main_text(f"<article><p>{LONG}</p><script>var a = '</div>'<p>{LONG}</p></article>", tree) == LONG


@pytest.mark.parametrize(("attributes", "want"), [
    (' data-title="The hidden cost of tea"', 0), (' data-id="ad-1"', 0), (" title='x hidden y' data-class=nav", 0), (' alt="a class=ad b"', 0),
    (" hidden", 1), (' id=x HIDDEN=""', 1), (' aria-hidden="true"', 1), (' Style="display: none"', 1), (" class=ad", 2), (' id="main"', -1), (' role="navigation"', 1), ("/class='sidebar'", 2)])
def test_whole_attributes_are_read(attributes, want):
    assert main_text.standing("div", attributes) == want
    assert main_text.standing("article", attributes) == (want if want > 0 else -1)


@pytest.mark.parametrize("page", [
    f"<main class='has-header'><p>{LONG}", f"<div class='container no-sidebar'><p>{LONG}</p></div>", f"<div class='widget-content'><p>{LONG}</p></div>",
    f"<article><div class='legal-text'><p>{LONG}</p></div></article>", f"<main><section class='share-price-report'><p>{LONG}</p></section></main>",
    f"<div class='site-header'><main><p>{LONG}</p></main></div>", f"<body class='ad-free with-banner'><div id='page-header'><p>{LONG}</p></div></body>"])
def test_no_name_empties_a_page(page):
    assert main_text.main_text(page, main_text.grow(*main_text.labelled())) == LONG


@pytest.mark.parametrize(("name", "want"), [
    ("sidebar", 2), ("post-footer", 2), ("related-posts", 2), ("share-buttons", 2), ("reader comments", 2), ("widget-content", 3), ("share-price-report", 3),
    ("no-sidebar", 0), ("has-header", 0), ("withAds", 0), ("ad-free", 0), ("post has-comments", -1), ("entry share-price-report", -1), ("", 0)])
def test_names(name, want):
    assert main_text.named(name) == want


#: Layouts that the tree has not seen: (M) stands for the main blocks, [n] for n words around them.
LAYOUTS = (
    "<body><div class='wrapper has-sidebar'><div class=site-header><a>[2]</a><a>[1]</a></div><div id=primary>(M)</div><div class='right-sidebar'><p>[30]</p><ul><li><a>[3]</a></li></ul></div></div><div class=page-footer>[12]</div></body>",
    "<header class=masthead><p>[9]</p></header><main id=main class='no-ads'><article class='post with-comments'>(M)<div class=social-links><a>[1]</a></div></article><section class=comments-area><p>[45]</p><p>[7]</p></section></main>",
    "<nav><a>[1]</a></nav><div class='legal-text'>(M)</div><aside><p>[25]</p></aside><footer>[10]</footer>",
    "<div id=cookie-banner><p>[28]</p></div><div class=content><section class=promotion-of-trade>(M)</section></div><form><p>[12]</p></form>",
    "<article>(M)<div class=ad-slot><p>[15]</p></div></article><div class=comment-list><p>[80]</p><p>[90]</p><p>[70]</p></div>",
    "<div role=banner>[8]</div><div itemprop=articleBody>(M)</div><div class=newsletter-box><p>[20]</p></div>",
)


def test_generated_pages_of_unseen_layouts():
    tree, rng = main_text.grow(*main_text.labelled()), np.random.default_rng(3)
    wanted = found = right = 0
    for no in range(240):
        text = lambda kind, n: " ".join(f"{kind}{rng.integers(1 << 30)}" for _ in range(n))  # noqa: B023, E731
        main = [text("m", int(n)) for n in (rng.integers(2, 9), *rng.integers(12, 120, rng.integers(1, 8)))]
        page = LAYOUTS[no % len(LAYOUTS)].replace("(M)", f"<h1>{main[0]}</h1>" + "".join(f"<p>{b}</p>" for b in main[1:]))
        page = re.sub(r"\[(\d+)\]", lambda m: text("x", int(m[1])), page)  # noqa: B023
        got = [b for b in main_text.main_text(page, tree).split("\n\n") if b]
        wanted, found, right = wanted + len(main), found + len(got), right + len(set(got) & set(main))
    assert right / wanted >= 0.95 and right / found >= 0.95, (wanted, found, right)
