"""Tables with spans against a plain grid, visibility, and comments that end at once."""

import random

import pytest

from tracewright.llm.html_text import extract, visible_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a<!-->b<!--->c<!-- x -->d<!-- y --!>e<!-- z", "abcde"),
        ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</p>", "yes"),
        ("<div style='display:none'>no <b style='visibility:visible'>no</b></div>ok", "ok"),
        ("<table><tr><td rowspan=2>R<td>x<tr><td>y</table>", "R  x\n   y"),
        ("<table><tr><td colspan=2>wide cell<td>z<tr><td>a<td>b<td>c</table>", "wide cell  z\na  b       c"),
        ("<table><tr><td>a<td>b<tr><td colspan=0>x<td rowspan=junk>y</table>", "a  b\nx  y"),
        ("<table><tr><td style='visibility:hidden'>a<td>b<tr><td>c<td>d</table>", "   b\nc  d"),
        ("<table><tr><td colspan=1000>t<tr><td>a<td>b</table>", "t\na  b"),
        ("<table><tr><td rowspan=0>R<td>1<tr><td>2<tr><td>3</table>", "R  1\n   2\n   3"),
    ],
)
def test_pages(page, text):
    assert visible_text(page) == text


def plain(rows):
    """Cells (text, columns, rows) put into a dictionary of places, one place at a time."""
    grid, placed = {}, []
    for r, cells in enumerate(rows):
        c = 0
        for text, columns, down in cells:
            while (r, c) in grid:
                c += 1
            for i in range(down):
                for j in range(columns):
                    grid.setdefault((r + i, c + j), text)
            placed.append((r, c, columns, text))
            c += columns
    n = max((c + k for _, c, k, _ in placed), default=0)
    width = [max((len(t) for _, c, k, t in placed if c == i and k == 1), default=0) for i in range(n)]
    lines = []
    for r in range(len(rows)):
        own = sorted((c, t) for rr, c, _, t in placed if rr == r)
        if any(t for _, t in own):
            lines.append("  ".join(next((t for c, t in own if c == i), "").ljust(width[i]) for i in range(n)).rstrip())
    return "\n".join(lines)


def test_row_spans_against_a_plain_grid():
    rng = random.Random(6)
    for _ in range(300):
        rows = [[(rng.choice(["a", "bb", "ccc", "dddd"]), 1, rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 5))]
        page = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={d}>{t}</td>" for t, _, d in cells) + "</tr>" for cells in rows) + "</table>"
        assert visible_text(page) == plain(rows), page


def test_odd_tables_of_pages(spark):
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None), (2, None, "<td>" * 3000 + "deep"), (3, "v", "<table>" + "<tr><td rowspan=9 colspan=9>c" * 400 + "</table>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as text")
    found = sorted(((r["page_id"], r["text"][-4:]) for r in extract(pages).collect()), key=str)
    assert found[:2] == [(1, "x"), (1, "x")] and (None, "") in found and (2, "deep") in found
    assert extract(pages.where("false")).count() == 0
