"""Block and visibility rules: misplaced end tags, display, visible children, style sheets, markers."""

from __future__ import annotations

import time

import pytest

from scriptorium.llm.html_text import render


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<div>b</p>c</div>d", "a\n\nb\n\nc\nd"),
        ("<b><p>one</b>two</p>three", "onetwo\n\nthree"),
        ("<a><div>x</a>y</div>z", "xy\nz"),
        ('<span style="display:block">l1</span><span style="display:block">l2</span>', "l1\nl2"),
        ('<div style="display:inline">a</div><div style="display: inline-block">b</div>', "ab"),
        ("<svg><title>t</title><text>seen</text></svg><math><mi>x</mi><mo>=</mo></math>", "seenx="),
        ('<div style="visibility:hidden">no<b style="visibility:visible">yes</b>no</div>', "yes"),
        ('<ul><li style="visibility:hidden">no<b style="visibility:visible">yes</b></li><li>b</li></ul>', "yes\n- b"),
        ("<style>.h{display:none} #i, p.x {visibility : hidden !important} /* .v{display:none} */</style><b class='a h'>1</b><b id=i>2</b><p class=x>3</p><b class=x>4</b><b class=v>5</b>", "45"),
        ("<style>.h{display:none}</style><b class=h style='display:inline'>own</b>", "own"),
        ("<style>@media print{.h{display:none}} .g{display:none}</style><b class=h>1</b><b class=g>2</b>", "1"),
        ("<style>.h{display:none} .h{display:block}</style><b class=h>1</b>2", "1\n2"),
        ("<ol type=a start=26><li>x<li>y</ol>", "z. x\naa. y"),
        ("<ol reversed><li>x<li>y</ol>", "2. x\n1. y"),
        ("<ol type=I><li value=9>x<li>y</ol>", "IX. x\nX. y"),
        ("<p>a</p></p>b", "a\n\nb"),
        ("<style>.h{</style><b class=h>1</b>", "1"),
    ],
)
def test_rules(html, text):
    assert render(html) == text


@pytest.mark.parametrize("piece", ["</p>", "<b><p></b>", "<style>.a{display:none}</style>", "<b style='visibility:hidden'>", "<b style=display:block>", "<p class='a b c'>"])
def test_time_is_in_proportion(piece):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        render(piece * (n // len(piece) * 4))
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.05)
