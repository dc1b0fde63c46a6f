"""Names and attributes that tell of boilerplate, and those that only look like it."""

import pytest
from rainshade.llm.html import parse

REAL = ['<p title="the hidden costs">x</p>', '<p><a href="/hidden">x</a></p>', '<p><a href="/p?id=comments">x</a></p>', '<p><a href=/p?id=comments>x</a></p>', '<p data-hidden="false">x</p>',
        '<p data-id="share">x</p>', '<h2 id="related-work">x</h2>', '<section id="search-methods"><p>x</p></section>', '<h2 id="social-policy">x</h2>', '<div class="the-social-policy"><p>x</p></div>',
        '<div class="related-work"><p>x</p></div>', '<p class="search">x</p>', '<h3 class="social">x</h3>', '<blockquote class="comment">x</blockquote>',
        f'<p data-long="{"a > b " * 1000}">x</p>', """<p title='say "id=comments"'>x</p>"""]
BOILERPLATE = ['<ul class="related-posts"><li>x</ul>', '<div class="ad">x</div>', '<section class="user-comments"><p>x</p></section>', '<div class="cookie-notice"><p>x</p></div>',
               '<div class="comment-list">x</div>', '<div id=share-bar>x</div>', '<div class="site-footer">x</div>', "<div hidden>x</div>", '<div data-x="y" class=\'a menu\'>x</div>',
               f'<div data-long="{"a > b " * 1000}" id="comments">x</div>']


@pytest.mark.parametrize("page", REAL)
def test_article_text_stays(page):
    _, blocks = parse(f"<article><p>before</p>{page}</article>")
    assert " ".join(t for node, t in blocks if not node.outside) == "before x"


@pytest.mark.parametrize("page", BOILERPLATE)
def test_boilerplate_is_outside(page):
    _, blocks = parse(f"<article><p>before</p>{page}</article>")
    assert " ".join(t for node, t in blocks if not node.outside) == "before"
