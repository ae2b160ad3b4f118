"""op8_html_extraction on generated pages against a recursive rendering of the trees they were written from, and on hostile pages."""

from __future__ import annotations

import random
import time

import pytest

from scriptorium.llm import html_text

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def _text(rng, n=4):
    return " ".join(rng.choices(WORDS, k=rng.randint(1, n)))


def _tree(rng, deep=0):
    """Children: texts, or (tag, attributes, children)."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.35 or deep > 4:
            out.append(_text(rng))
        elif kind < 0.45:
            out.append(("b", "", [_text(rng)]))
        elif kind < 0.5:
            out.append(("br", "", []))
        elif kind < 0.6:
            out.append(("p", "", [_text(rng), ("i", "", [_text(rng)])]))
        elif kind < 0.66:
            out.append((rng.choice(["p", "div", "span"]), rng.choice([" hidden", " style='display: none'", ' style="color:red;visibility:hidden"']), [_text(rng)]))
        elif kind < 0.78:
            out.append((rng.choice(["ul", "ol"]), "", [("li", "", _tree(rng, deep + 1)) for _ in range(rng.randint(1, 3))]))
        elif kind < 0.86:
            rows = [("tr", "", [(rng.choice(["td", "th"]), rng.choice(["", " align=right"]), _tree(rng, deep + 2)) for _ in range(rng.randint(1, 3))]) for _ in range(rng.randint(1, 3))]
            out.append(("table", "", rows))
        else:
            out.append((rng.choice(["div", "blockquote", "section", "h2"]), "", _tree(rng, deep + 1)))
    return out


BLOCKS = ("div", "blockquote", "section", "h2", "dd", "p", "ul", "ol", "table", "li", "tr", "td", "th")


def _html(nodes, rng):
    """Optional end tags are left out at random."""
    out = []
    for k, x in enumerate(nodes):
        if isinstance(x, str):
            out.append(x + rng.choice([" ", "\n ", " <!-- > -->"]))
            continue
        tag, attrs, children = x
        inner = _html(children, rng)
        follows = nodes[k + 1][0] if k + 1 < len(nodes) and not isinstance(nodes[k + 1], str) else None
        free = tag in ("li", "tr", "td", "th") or tag == "p" and (follows in BLOCKS and follows != "dd")
        name = tag.upper() if rng.random() < 0.2 else tag
        end = "" if tag == "br" or free and rng.random() < 0.5 else f"</{name}>"
        out.append(f"<{name}{attrs}>{inner}{end}" + ("" if tag in ("li", "tr", "td", "th") else " "))
    return "".join(out)


def _lines(nodes):
    """By recursion: each part's lines are made first, then set into those around."""
    lines, line, margin = [], [], [0]

    def finish(keep=False):
        if line or keep:
            if lines:
                lines.extend([""] * margin[0])
            margin[0] = 0
            lines.append(" ".join(line))
            line.clear()

    def space(n):
        finish()
        if any(lines):
            margin[0] = max(margin[0], n)

    def take(new):
        finish()
        if new:
            if any(lines):
                lines.extend([""] * margin[0])
            margin[0] = 0
            lines.extend(new)

    def walk(nodes):
        for x in nodes:
            if isinstance(x, str):
                line.append(x)
                continue
            tag, attrs, children = x
            if "hidden" in attrs or "none" in attrs:
                continue
            around = 1 if tag in ("p", "ul", "ol", "blockquote", "h2", "table") else 0
            if tag == "br":
                finish(True)
            elif tag in ("b", "i", "span"):
                walk(children)
            else:
                space(around)
                if tag in ("ul", "ol"):
                    for k, (_, _, inner) in enumerate(children, 1):
                        mark = f"{k}. " if tag == "ol" else "- "
                        take([((mark if j == 0 else " " * len(mark)) + y).rstrip() for j, y in enumerate(_lines(inner))])
                elif tag == "table":
                    grid = [[(_lines(c), "right" in a) for _, a, c in row] for _, _, row in children]
                    wide = [max((len(y) for row in grid if k < len(row) for y in row[k][0]), default=0) for k in range(max(map(len, grid)))]
                    for row in grid:
                        for i in range(max(len(c) for c, _ in row)):
                            cells = [(c[i] if i < len(c) else "").rjust(w) if right and i < len(c) else (c[i] if i < len(c) else "").ljust(w) for (c, right), w in zip(row, wide, strict=False)]
                            take(["  ".join(cells).rstrip()])
                elif tag in ("blockquote", "dd"):
                    take([("  " + y).rstrip() for y in _lines(children)])
                else:
                    walk(children)
                space(around)

    walk(nodes)
    finish()
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return lines


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages(seed):
    rng = random.Random(seed)
    tree = [y for _ in range(4) for y in _tree(rng)]
    page = f"<!DOCTYPE html><html><head><title>no</title><script>if (a < b) '</p>'</script></head><body>{_html(tree, rng)}</body></html>"
    assert html_text.render(page).split("\n") == (_lines(tree) or [""])


@pytest.mark.parametrize("depth", [10, 160, 10_000, 100_000])
def test_visibility_at_any_depth(depth):
    assert html_text.render("<div>" * depth + "<p hidden>SECRET</p><span style='display:none'>S2</span>shown" + "</div>" * depth + "after") == "shown\nafter"
    nested = "<ul><li>x" * min(depth, 10_000)
    assert html_text.render(nested).count("x") == min(depth, 10_000)


HOSTILE = {
    "tags begun": "<a ", "single quote": "<a b='", "double quote": '<a "', "quotes and ends": "<a b='x\" >", "comments": "<!--x--!>", "comments begun": "<!-", "slashes": "<a/", "angles": "<", "ends": "</x>", "paragraphs": "<p>",
    "cells": "<td>x", "tables": "<table>", "nested cells": "<table><tr><td>", "lists": "<ul><li>", "quotations": "<blockquote>", "forms": "<table><form>", "scripts": "<script>", "entities": "&amp", "attributes": "<p a=b c", "spaces": "<a   ",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages(name):
    """A megabyte of each, in time that grows with the length."""
    took = []
    for size in (250_000, 1_000_000):
        page = "text " + HOSTILE[name] * (size // len(HOSTILE[name])) + " </x> end > more"
        began = time.thread_time()
        assert html_text.render(page)
        took.append(time.thread_time() - began)
    assert took[1] < 9 * max(took[0], 0.25)


def test_unclosed():
    assert html_text.render("a < b <c tag=\"x> <b>bold</b> it's <i>old</i> <") == "a < b bold it's old <"
    assert html_text.render("<p>one<!-->two<!--->three<!-- x --!>four<?x y>five</br>six") == "onetwothreefourfive\nsix"
    assert html_text.render("x <a href='a>b' title=\"c>d\">link</a> <img alt='>'> y") == "x link y"


def test_table_sizes():
    wide = "w" * (html_text.WIDEST + 40)
    got = html_text.render(f"<table><tr><td>{wide}<td>b<tr><td>a<td>c</table>").split("\n")
    assert got == [f"{wide}  b", "a".ljust(html_text.WIDEST) + "  c"]
