"""Marks cut no article, and comments and adverts don't stay, whatever wraps them."""

from __future__ import annotations

import random

import pytest

from querylume.llm import html_text

WORDS = "the light of a small house stood over many fields when rain came and people went home along roads that nobody had built".split()


def sentence(rng, n=None):
    return " ".join(rng.choice(WORDS) for _ in range(n or rng.randrange(18, 40))).capitalize() + "."


def paragraphs(rng, n):
    return [sentence(rng) for _ in range(n)]


def block(parts):
    return "".join(f"<p>{p}</p>" for p in parts)


RNG = random.Random(11)
TEXT = paragraphs(RNG, 6)
LONG = paragraphs(RNG, 24)
WHOLE = "\n".join(["The head", *TEXT])


@pytest.mark.parametrize("page", [
    "<body><form id=aspnetForm><div><h1>The head</h1>{0}</div></form></body>",
    "<body><form method=post action='.'><h1>The head</h1>{0}</form></body>",
    "<body><article><h1>The head</h1><form>{0}</form></article></body>",
    "<body><div role=complementary><main><h1>The head</h1>{0}</main></div></body>",
    "<body aria-hidden=true><article><h1>The head</h1>{0}</article></body>",
    "<body><div style='display:none'><h1>The head</h1>{0}</div></body>",
    "<body><noscript><div><h1>The head</h1>{0}</div></noscript></body>",
    "<body><div role=dialog><article><h1>The head</h1>{0}</article></div><nav><a href=x>Home</a><a href=y>News</a></nav></body>",
    "<body><aside><main><h1>The head</h1>{0}</main></aside></body>",
    "<body><form class=search><input name=q> Search here</form><div><h1>The head</h1>{0}</div></body>",
])
def test_articles_in_marked_wrappers(page):
    assert html_text.extract(page.format(block(TEXT))) == WHOLE


@pytest.mark.parametrize("page", [
    "<body><article><h1>The head</h1>{0}<section class='comments-area'>{1}</section></article></body>",
    "<body><article><h1>The head</h1>{0}</article><div id='user-comments'>{1}</div></body>",
    "<body><main><h1>The head</h1>{0}<div class='ad-slot-wrapper'><p>Buy the best thing of this year now and save half of it.</p></div></main></body>",
    "<body><article><h1>The head</h1>{0}<ol class='post-comments-list__inner'>{1}</ol></article></body>",
    "<body><form id=aspnetForm><div><h1>The head</h1>{0}</div><div class=comment-section>{1}</div></form></body>",
    "<body><article><h1>The head</h1>{0}<div class='article-sidebar-new'><p>Other people also read about roads.</p></div></article></body>",
    "<body><header><h1>The Site</h1><nav><a href=x>Home</a></nav></header><article><h1>The head</h1>{0}</article><footer>All of it is ours since then.</footer></body>",
    "<body><article><h1>The head</h1>{0}</article><div aria-hidden=true>Close this window and go on with what you did.</div></body>",
])
def test_what_is_not_the_article_goes(page):
    assert html_text.extract(page.format(block(TEXT), block(LONG))) == WHOLE


def test_pages_by_construction():
    """Articles of known paragraphs in random wrappers, with random blocks around them that must go."""
    rng = random.Random(5)
    wraps = ["<div>{}</div>", "<form id=f>{}</form>", "<div class=content-with-sidebar>{}</div>", "<section>{}</section>", "<main>{}</main>", "<article>{}</article>", "<div role=form>{}</div>", "<table><tr><td>{}</td></tr></table>"]
    noise = [
        lambda: "<nav>" + "".join(f"<a href=x>{sentence(rng, 2)}</a> " for _ in range(rng.randrange(3, 9))) + "</nav>", lambda: f"<footer><p>{sentence(rng, 12)}</p></footer>",
        lambda: f"<section class='{rng.choice(['comments', 'user-comments', 'comment-thread', 'blog-comments-v2'])}'>{block(paragraphs(rng, rng.randrange(1, 12)))}</section>",
        lambda: f"<div class={rng.choice(['ad-banner', 'promo-box', 'newsletter-signup', 'cookie-notice'])}><p>{sentence(rng, 9)}</p></div>", lambda: f"<script>var x = '{sentence(rng)}';</script>", lambda: f"<form><input name=q><label>{sentence(rng, 3)}</label></form>",
    ]
    for _ in range(150):
        parts = [sentence(rng, 4).rstrip("."), *paragraphs(rng, rng.randrange(5, 9))]
        body = f"<h1>{parts[0]}</h1>{block(parts[1:])}"
        for wrap in rng.sample(wraps, rng.randrange(1, 4)):
            body = wrap.format(body)
        around = [f() for f in rng.sample(noise, rng.randrange(0, 5))]
        at = rng.randrange(len(around) + 1)
        assert html_text.extract(f"<html><head><title>T</title></head><body>{''.join(around[:at])}{body}{''.join(around[at:])}</body></html>") == "\n".join(parts)


def test_very_deep_and_very_long_pages():
    deep = "<div>" * 20_000 + block(TEXT) + "</div>" * 20_000
    assert html_text.extract(f"<body>{deep}</body>") == "\n".join(TEXT)
    many = paragraphs(RNG, 20_000)
    assert html_text.extract(f"<body><article>{block(many)}</article></body>") == "\n".join(many)
