"""Pages whose content stands in elements with names of furniture, and furniture that stays furniture."""

import time

import pytest

from tablewright.llm import pages

PARA = "<p>" + "The quick brown fox jumps over the lazy dog near the river. " * 4 + "</p>"
TEXT = "\n".join([" ".join(PARA[3:-4].split())] * 4)
REST = '<div class="comments"><p>' + "A nice post, I say. " * 200 + '</p></div><div class="sidebar"><p>Other things here.</p></div><footer>Imprint</footer>'


def page(body):
    return f'<html><body><nav><a href="x">Home</a><a href="y">About</a></nav>{body}{REST}</body></html>'


@pytest.mark.parametrize("wrap", [
    '<article class="post has-sidebar">%s</article>', '<div class="content-with-sidebar">%s</div>', '<article class="post tag-newsletter category-promo">%s</article>',
    '<section class="search-results">%s</section>', '<div class="legal"><article>%s</article></div>', "<form><div>%s</div><label>Name</label><button>Send</button></form>",
    '<div role="search"><div class="notice"><article>%s</article></div></div>', '<article><div class="promo-body">%s</div></article>',
])
def test_wrappers_stay(wrap):
    assert pages.main_text(page(wrap % (PARA * 4))) == TEXT


def test_page_in_one_form():
    html = f'<html><body><form><nav>Menu</nav><article>{PARA * 4}</article><div class="sidebar">Side words.</div><select><option>One</option></select></form></body></html>'
    assert pages.main_text(html) == TEXT


@pytest.mark.parametrize("extra", [
    '<div class="related-posts"><p>Short words on other posts.</p></div>', '<div class="ad-slot"><p>Buy it now.</p></div>', '<form class="signup"><p>Get our mail.</p></form>',
    '<form><p>Tell us your name.</p><label>Name</label></form>', '<div class="has-image cookie-banner"><p>We use them.</p></div>', '<section id="commentForm"><p>Say it.</p></section>',
    '<div role="dialog"><p>Stay with us.</p></div>', '<div hidden>' + PARA * 30 + "</div>", '<div style="display: none">' + PARA * 30 + "</div>",
])
@pytest.mark.parametrize("place", ["in", "after"])
def test_furniture_goes(extra, place):
    body = f"<article>{PARA * 4}{extra}</article>" if place == "in" else f"<article>{PARA * 4}</article>{extra}"
    assert pages.main_text(page(body)) == TEXT


def test_comments_alone_give_nothing():
    assert pages.main_text('<html><body><div class="comments"><p>' + "Nice. " * 300 + "</p></div></body></html>") == ""


def test_deep_wrappers_take_linear_time():
    start = time.monotonic()
    assert pages.main_text('<div class="legal">' * 20_000 + "text here now " + "</div>" * 20_000) == "text here now"
    assert time.monotonic() - start < 20
