"""Scores against a plain computation on random trees, and pages that are all tags."""

import random
import time
from html.parser import HTMLParser

import pytest

from docloom.llm import html_text

NAMES = ("div", "section", "article", "main", "blockquote", "td")


class Tree(HTMLParser):
    """Nested dicts of a page whose tags are all closed."""

    def __init__(self, source):
        super().__init__()
        self.root = self.here = {"tag": "#", "above": None, "kids": [], "at": 0}
        self.count = 0
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        self.count += 1
        node = {"tag": tag, "above": self.here, "kids": [], "at": self.count}
        self.here["kids"].append(node)
        self.here = node

    def handle_endtag(self, tag):
        self.here = self.here["above"]

    def handle_data(self, data):
        if data.strip():
            self.here["kids"].append(" ".join(data.split()))


def below(node):
    for kid in node["kids"]:
        yield kid
        if isinstance(kid, dict):
            yield from below(kid)


def paragraphs(root):
    """(node that gets all the points, text) of every paragraph of 25 characters or more."""
    for p in below(root):
        if isinstance(p, dict) and p["tag"] == "p":
            text = "".join(k if isinstance(k, str) else k["kids"][0] for k in p["kids"])
            if len(text) >= 25:
                yield p, text


def up(node):
    while node["above"]:
        yield node
        node = node["above"]


def length(node):
    """Characters of the paragraphs in a node, and those in links."""
    texts = [k for k in below(node) if isinstance(k, str)]
    linked = [k["kids"][0] for k in below(node) if isinstance(k, dict) and k["tag"] == "a"]
    return sum(map(len, texts)), sum(map(len, linked))


def brute(source):
    root = Tree(source).root
    nodes = [n for n in below(root) if isinstance(n, dict) and n["tag"] != "a"]
    found = list(paragraphs(root))
    worth = lambda t: 1 + t.count(",") + min(len(t) / 100, 3)

    def score(node):
        total = 0.0
        for p, text in found:
            way = list(up(p["above"]))
            place = next((k for k, n in enumerate(way) if n is node), None)
            if place is not None:
                if node["tag"] in ("article", "main"):
                    total += worth(text) * {"article": 1.5, "main": 1.2}[node["tag"]]
                elif place < 8:
                    total += worth(text) / (1, 2, 6, 9, 12, 15, 18, 21)[place]
        chars, linked = length(node)
        return total * (1 - linked / chars) if chars else 0.0

    scores = {n["at"]: score(n) for n in nodes}
    best = max(nodes, key=lambda n: (round(scores[n["at"]], 9), -n["at"]))
    least = max(10, scores[best["at"]] / 5)
    keep = [n for n in best["above"]["kids"] if n is best or isinstance(n, dict) and (scores[n["at"]] >= least or n["tag"] == "p" and length(n)[0] > 80 and length(n)[1] < 0.25 * length(n)[0])]

    def texts(node):
        if node["tag"] == "p":
            yield "".join(k if isinstance(k, str) else k["kids"][0] for k in node["kids"])
            return
        for kid in node["kids"]:
            chars, linked = length(kid)
            inside = any(n["tag"] in ("article", "main") for n in up(kid))
            if not (kid["tag"] in ("div", "section") and chars and linked > 0.7 * chars and not inside):
                yield from texts(kid)

    return "\n".join(t for n in keep for t in texts(n))


def page(pick, depth=0):
    out = []
    for _ in range(pick.randrange(1, 4)):
        if depth < 4 and pick.random() < 0.6:
            tag = pick.choice(NAMES[:4])
            out.append(f"<{tag}>{page(pick, depth + 1)}</{tag}>")
        else:
            words = "".join(pick.choice("abcdefgh,") for _ in range(pick.randrange(1, 300)))
            out.append(f"<p>{words}</p>" if pick.random() < 0.8 else f"<p><a>{words}</a></p>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(300))
def test_random_trees(seed):
    source = page(random.Random(seed))
    root = Tree(source).root
    if any(True for _ in paragraphs(root)) and any(isinstance(k, dict) and k["tag"] in NAMES and length(k)[1] < length(k)[0] for k in below(root)):
        if any(p["above"]["above"] for p, _ in paragraphs(root)):
            assert html_text.main_text(source) == brute(source)


@pytest.mark.parametrize(
    "part",
    ["<a '", "<![CDATA[", "<div>", "<p>", "<div><li>", "<!--", "<a \">\" ", "<b", "</x", "<p><button><div>", "<li><b>", "<dl><dd>", "<table><tr><td>", "<script>", "<?", "&amp", "<a class='", "<div class=' ", "<!-->", "<p class=a =b>", "<article><p>aa, bb"],
)
def test_linear(part):
    """A megabyte of one thing, with and without its end tags."""
    for source in (part * (1_000_000 // len(part)), part * (100_000 // len(part)) + "</x></div>" * 10_000, part * (100_000 // len(part)) + "'>\"></div>" * 10_000):
        began = time.process_time()
        html_text.main_text(source)
        assert time.process_time() - began < 8
