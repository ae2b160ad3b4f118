"""op8_html_extraction: what stands in a table's sections but in no row is visible, and rows inside other elements are rows."""

from __future__ import annotations

import pytest

from scriptorium.llm.html_text import render

PAGES = {
    "<table><tr><td>a</td></tr>note<tr><td>b</td></tr></table>": "note\n\na\nb",
    "<table><tr><td>a</td></tr>one<tr><td>b</td></tr>two <b>three</b> <i>four</i></table>": "one\ntwo three four\n\na\nb",
    "<table><tr><td>a</td></tr><caption>Title</caption><tr><td>b</td></tr></table>": "Title\n\na\nb",
    "<table><thead>x<tr><td>h</td></tr><div>y</div></thead><tfoot>z<tr><td>f</td></tr></tfoot><tbody><tr><td>b</td></tr></tbody></table>": "x\ny\nz\n\nh\nb\nf",
    "<table><tr><td>a</td><td>1</td></tr><form>send <tr><td>bcd</td><td>2</td></tr></form></table>": "send\n\na    1\nbcd  2",
    "<table><form><tr><td>a</td></tr>tail</form><tr><td>b</td></tr></table>": "tail\n\na\nb",
    "<table><tbody hidden>no<tr><td>no</td></tr></tbody><tbody><tr><td>a</td></tr><p hidden>no</p><script>no</script></tbody></table>": "a",
    "<table><tr><td>a</td></tr><table><tr><td>in</td></tr></table></table>": None,
}


@pytest.mark.parametrize("page", PAGES)
def test_between_rows(page):
    got = render(page)
    if PAGES[page] is None:
        assert sorted(got.split()) == ["a", "in"]
    else:
        lines = lambda t: [x for x in t.split("\n") if x]
        assert lines(got) == lines(PAGES[page])
