"""Main text of pages other than the given ones: inline furniture, names in ids and classes, every block element."""

import random
import re
from html.parser import HTMLParser

import pytest

from docfacts.llm.html_extract import blocks, cut_lines


def main(page):
    own = blocks(page)
    return cut_lines([t for t, _ in own], [z for _, z in own], [])[0]


def article(body):
    return main(f"<body><article>{body}</article></body>")


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('<p>x <span class="advert">Buy now</span> y</p>', ["x y"]),
        ('<p>x<span class="ad">!</span>y</p>', ["xy"]),
        ('<p>One <b>two <span class="advert">Buy</span> three</b> four</p><p>five</p>', ["One two three four", "five"]),
        ("<p>a</p><button>Share this</button><p>b</p>", ["a", "b"]),
        ("a <button>Share this</button> b", ["a b"]),
        ('<p>a <a class="sponsor" href="#">Our sponsor</a></p>', ["a"]),
        ('<p>a <a class="share-link" href="#">Share</a> b</p>', ["a b"]),
        ("<p>a <label>Your name</label> b</p>", ["a b"]),
        ("<p>a <select><option>One<option>Two</select> b</p>", ["a b"]),
        ('<p>a</p><div class="newsletter-signup"><h3>Join</h3><p>us</p></div><p>b</p>', ["a", "b"]),
        ('<div class="userComments"><p>First!</p></div><p>b</p>', ["b"]),
        ('<h2 id="related-work">Related work</h2><p>a</p>', ["Related work", "a"]),
        ('<h3 id="search-trees">Search trees</h3>', ["Search trees"]),
        ('<h2 id="comments-on-the-proof">Comments on the proof</h2>', ["Comments on the proof"]),
        ('<h2 class="alert">Alert</h2>', ["Alert"]),
        ('<p class="side-effects">Headache</p>', ["Headache"]),
        ('<section id="alert-rules"><p>Rules</p></section>', ["Rules"]),
        ('<div id="comments"><p>kept, an id is no name here</p></div>', ["kept, an id is no name here"]),
        ('<p class="share-price">Down</p><p class="header">Lead</p>', ["Down", "Lead"]),
        ('<div class="article-header"><h1>Title</h1><p>By X</p></div><header><p>Lead</p></header>', ["Title", "By X", "Lead"]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold</p>", ["Let x=1 hold"]),
        ("<p>a<br>b &amp; c&nbsp;d</p>", ["a b & c d"]),
        ("<p>a <svg><text>no</text></svg><script>no()</script>b</p>", ["a b"]),
        ('<p data-class="ad">a</p><p hidden>no</p><p style="display: none">no</p>', ["a"]),
        ('<p>a <span class="ad">no</p><p>b</p>', ["a", "b"]),
        ('<aside>no</aside><nav><ul><li>no</li></ul></nav><form><p>no</p></form><footer>no</footer>', []),
    ],
)
def test_articles(body, want):
    assert article(body) == want


def test_outside_articles_ids_name_furniture_as_a_whole():
    page = '<div id="sidebar">no</div><div id="side-effects">yes</div><h2 id="search">Search</h2><div id="page-footer">no</div><header>no</header><div>x <a class="share-link">no</a> y</div>'
    assert main(page) == ["yes", "Search", "x y"]


BLOCKS = "address article blockquote center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
GONE = "nav footer aside form button select label dialog script style".split()


class Plain(HTMLParser):
    """Text by block elements; whatever stands in an element that is furniture goes."""

    def __init__(self, text):
        super().__init__()
        self.open, self.found, self.now = [], [], ""
        self.feed(text)
        self.cut()

    def cut(self):
        if self.now.split():
            self.found.append(re.sub(r"\s+", " ", self.now).strip())
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now += "" if any(self.open) else " "
            return
        gone = tag in GONE or any(k == "class" and v in ("advert", "cookie-box") for k, v in attrs)
        if tag in BLOCKS or tag in ("nav", "footer", "aside", "form", "dialog"):
            self.cut()
        self.open.append(gone)

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in ("nav", "footer", "aside", "form", "dialog"):
            self.cut()
        self.open.pop()

    def handle_data(self, data):
        if not any(self.open):
            self.now += data


def made(rng, depth):
    out = ""
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        word = " ".join(rng.choice(["alpha", "beta &amp; co", "gamma", "d&#233;j&agrave;", "x<br>y"]) for _ in range(rng.randint(1, 4)))
        space = rng.choice(["", " ", "\n"])
        if kind < 0.3 or depth == 0:
            out += space + word
        elif kind < 0.6:
            tag = rng.choice(["b", "i", "span", "a", "em", "code"])
            name = rng.choice(["", "", ' class="advert"', ' class="cookie-box"', ' class="side-effects"', ' id="ads"'])
            out += f"{space}<{tag}{name}>{made(rng, 0)}</{tag}>"
        elif kind < 0.85:
            tag = rng.choice([b for b in BLOCKS if b not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "li", "dd", "dt") and not b.startswith("t")])
            out += f"{space}<{tag}>{made(rng, depth - 1)}</{tag}>"
        elif kind < 0.93:
            out += f"{space}<p>{made(rng, 0)}</p>"
        else:
            tag = rng.choice(GONE)
            out += f"{space}<{tag}>{'no' if tag in ('script', 'style') else made(rng, 0)}</{tag}>"
    return out


def test_generated_articles_against_the_standard_parser():
    rng = random.Random(4)
    for _ in range(400):
        body = made(rng, 3)
        assert article(body) == Plain(body).found, body
