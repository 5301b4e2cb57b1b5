"""Readers' comments, forms and lists of links around and in an article."""

import random

import pytest

from tessera.llm import html as H

SHORT = "The council met, as planned, on Monday."
TALK = "I do not agree, not at all, and I have said so, many times, to anyone who would listen."
MANY = "".join(f"<p>{TALK} {i}</p>" for i in range(12))


def signed(i, tag="div", name="", how=0):
    mark = [f"<time>{i} May</time>", f'<span class="author">Ann{i}</span>', f"<b>Ann{i}</b> <span>{i + 2} hours ago</span>", f"<i>Bo</i> <small>12:0{i % 10}</small>", "<p>Ann</p><a href=r>Reply</a>"][how]
    return f"<{tag}{name}>{mark}<p>{TALK} {i}</p></{tag}>"


@pytest.mark.parametrize(
    "page",
    [
        f'<article><p>{SHORT}</p></article><div class="comments">{MANY}</div>',
        f'<article><p>{SHORT}</p></article><div class="x7">{MANY}</div>',
        f'<article><p>{SHORT}</p><section class="comments">{MANY}</section></article>',
        f'<div class="story"><p>{SHORT}</p></div><div id="disqus_thread">{MANY}</div>',
        f'<main><article><p>{SHORT}</p></article><div>{MANY}</div></main>',
        f'<div><p>{SHORT}</p></div><div id="leserKommentare">{MANY}</div>',
        f'<div><p>{SHORT}</p><h3>12 Comments</h3>{MANY}</div>',
        f'<div><p>{SHORT}</p></div><div><h2>Comentarios (12)</h2>{MANY}</div>',
        f'<article><p>{SHORT}</p>{"".join(f"<article><p>{TALK} {i}</p></article>" for i in range(4))}</article>',
        f'<div class="post comments-open"><p>{SHORT}</p></div><ol class="commentlist">{"".join(f"<li>{TALK}</li>" for _ in range(9))}</ol>',
    ],
)
def test_comments_never_win_nor_stay(page):
    assert H.main_text(page) == SHORT
    assert H.main_text(f"<form action=x><p>Menu</p>{page}<p>{'y' * 140}</p></form>".replace("<p>Menu</p>", "<nav>Menu</nav>")).startswith(SHORT)


@pytest.mark.parametrize("how", range(5))
@pytest.mark.parametrize("tag", ["div", "section"])
def test_runs_of_signed_blocks_go_whatever_their_names(how, tag):
    run = "".join(signed(i, tag, how=how) for i in range(6))
    assert H.main_text(f"<div><p>{SHORT}</p></div><div>{run}</div>") == SHORT
    assert H.main_text(f"<div><p>{SHORT}</p>{run}</div>") == SHORT


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<div class="comment"><p>{SHORT}</p></div>', SHORT),  # nothing else has text
        (f'<div class="comment"><h1>Opinion</h1><p>{SHORT}</p></div><div><p>b</p></div>', None),  # holds the title
        (f"<div><p>{SHORT}</p><ul><li>10:00 Doors</li><li>11:00 Talk</li><li>12:00 End</li></ul></div>", f"{SHORT} 10:00 Doors 11:00 Talk 12:00 End"),
        (f"<div><p>{SHORT}</p><h2>Discussion</h2><p>b, c</p></div>", f"{SHORT} Discussion b, c"),
        (f"<article><p>{SHORT}</p><h2>Sources</h2><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article>", f"{SHORT} Sources One Two"),
        (f"<div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><p>{SHORT}</p></div>", SHORT),
        (f"<body><form action=x><div><p>{SHORT * 5}</p><input name=q><button>Go</button></div></form></body>", SHORT * 5),
        (f"<div><p>{SHORT}</p></div><form><label>Name</label><p>Your mail, please</p></form>", SHORT),
        (f"<h1>Title</h1><article><p>{SHORT}</p></article><p>More stories, here</p>", f"Title {SHORT}"),
        (f"<article><p>{SHORT}</p><div><h3>Day 1</h3><time>1 May</time><p>a, b</p></div><div><h3>Day 2</h3><time>2 May</time><p>c, d</p></div><div><h3>Day 3</h3><time>3 May</time><p>e, f</p></div></article>", f"{SHORT} Day 1 1 May a, b Day 2 2 May c, d Day 3 3 May e, f"),
        ("<article></article><div><p>a, b</p></div>", "a, b"),
    ],
)
def test_what_stays(page, want):
    got = H.main_text(page)
    assert got == want if want is not None else SHORT in got


def generated(n=120, seed=4):
    """Pages of every mixture: with or without article, main or a form around them, with names that mislead or say nothing."""
    r = random.Random(seed)
    line = lambda k: " ".join(r.choice("alpha beta gamma delta epsilon".split()) + r.choice(["", ","]) for _ in range(k)) + "."
    for _ in range(n):
        body = [line(r.randint(20, 50)) for _ in range(r.randint(1, 4))]
        inner = "".join(f"<p>{p}</p>" for p in body)
        run = "".join(signed(i, how=2) for i in range(r.randint(3, 40)))
        talk = r.choice([f'<div class="comments">{run}</div>', f'<section id="comment-list">{run}</section>', f"<div>{run}</div>", f"<h3>Comments</h3><div>{run}</div>"])
        tag, name = r.choice([("article", ""), ("main", ""), ("div", ' class="promo"'), ("div", ' class="story"'), ("div", "")])
        article = f"<{tag}{name}>{inner}{talk}</{tag}>" if r.random() < 0.4 else f"<{tag}{name}>{inner}</{tag}>{talk}"
        page = f'<nav><a href="/">Home</a></nav><div class="cookie-notice"><p>We use cookies</p></div>{article}<footer>f</footer>'
        yield f"<html><body>{page}</body></html>", " ".join(body)


def plainly(page):
    """The article by another way: all text of paragraphs outside blocks that are named comments, cookies or follow a comments heading, or hold a signature."""
    import re

    page = re.sub(r"<nav>.*?</nav>|<footer>.*?</footer>|<div class=\"cookie-notice\">.*?</div>", "", page)
    page = re.sub(r"<div><b>Ann\d+</b> <span>\d+ hours ago</span><p>.*?</p></div>", "", page)
    return " ".join(re.findall(r"<p>(.*?)</p>", page))


def test_generated_pages_agree_with_a_plain_choice():
    for page, text in generated():
        assert plainly(page) == text and H.main_text(page) == text
