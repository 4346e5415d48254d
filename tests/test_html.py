"""Tables of web pages: nesting, spans, tags left open."""

import random

import pytest

from evigraph.sources import html as H

#: page: {table: rows}
PAGES = {
    "<table><tr><td>a<td>b<tr><td>c</table>": {0: [["a", "b"], ["c"]]},
    "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d</td></tr></table>": {0: [["a", "b"], ["a", "c"], ["d"]]},
    "<table><tr><td colspan=2>a<td>b<tr><td>c<td rowspan='2' colspan='2'>d<tr><td>e<tr><td>f</table>": {0: [["a", "a", "b"], ["c", "d", "d"], ["e", "d", "d"], ["f"]]},
    "<table><tr><td>out <table><tr><td>in 1</td></tr><tr><td>in 2</td></tr></table> side</td><td>next</td></tr></table>": {0: [["out in 1in 2 side", "next"]], 1: [["in 1"], ["in 2"]]},
    "<TABLE><TR><TD>x&amp;y &lt;b&gt;</TD><TD> two\n  lines<br>here </TD></TR></TABLE>": {0: [["x&y <b>", "two lines here"]]},
    "<table><tr><td>a<table><tr><td>b": {0: [["ab"]], 1: [["b"]]},
    "<table></table><table><tr></tr><tr><td></td></tr></table>": {1: [None, [""]]},
    "<table><tr><td rowspan=bad colspan=-3>a<td rowspan=9>b</table>no table <td>x</td>": {0: [["a", "b"]]},
    "<table><tr><td rowspan=2>a<td rowspan=2>b<tr><tr><td>c</table>": {0: [["a", "b"], ["a", "b"], ["c"]]},
    "<script>'<table><tr><td>no'</script><!-- <table> --><table><tr><td>yes<style>td {}</style></table>": {0: [["yes"]]},
    "": {},
    "plain": {},
}


def test_grids(spark):
    pages = spark.createDataFrame([(i, p) for i, p in enumerate(PAGES)] + [(99, None)], "id int, html string")
    got = {}
    for r in H.rows(H.cells(pages, "id"), "id").collect():
        got.setdefault(r["id"], {}).setdefault(r["table"], {})[r["row"]] = r["cells"]
    for i, want in enumerate(PAGES.values()):
        assert got.get(i, {}) == {t: {k: row for k, row in enumerate(rows) if row is not None} for t, rows in want.items()}, i
    assert 99 not in got


def test_heads_parents_and_the_largest(spark):
    page = "<table><thead><tr><td>h</td></tr></thead><tbody><tr><td>1</td></tr></tbody></table><table><tr><th>n<th>v<tr><th>a<td>1<tr><td>b<td>2<table><tr><td>x</table></table>"
    pages = spark.createDataFrame([(1, page), (2, "<table><tr><td>one</table><table><tr><td>two</table>")], "id int, html string")
    found = H.cells(pages, "id").cache()
    rows = {(r["id"], r["table"], r["row"]): (r["header"], list(r["cells"])) for r in H.rows(found, "id").collect()}
    assert rows[1, 0, 0] == (True, ["h"]) and rows[1, 0, 1] == (False, ["1"])
    assert rows[1, 1, 0] == (True, ["n", "v"]) and rows[1, 1, 1] == (False, ["a", "1"])
    assert {r["parent"] for r in found.where("id = 1 AND table = 2").collect()} == {1}
    assert {r["id"]: r["table"] for r in H.largest(found, "id").collect()} == {1: 1, 2: 0}
    named = H.named(found.where("id = 1"), "id", ["name", "value"])
    assert {(r["row"], r["name"], r["value"]) for r in named.collect()} == {(1, "a", "1"), (2, "b", "2x")}
    with pytest.raises(Exception, match="fewer than 3"):
        H.named(found.where("id = 1"), "id", ["name", "value", "more"]).collect()


def test_rows_of_a_page_are_made_where_it_is_read(spark, monkeypatch):
    monkeypatch.setattr(H, "BATCH", 3)
    odd = ["<TR><tD  ROWSPAN='2' >x<td colspan=\"2\">y<td rowspan = 2>z<td a=1 colspan=2>w</tD ></tr>", "<td colspan=2/>a<td rowspan=2b>c<td colspan=>d</ td><td rowspan='2'colspan=2>e<td \n rowspan=2>f<td colspan=&#50;>g<td rowspan>h"]
    odd = [f"<table>{x}<tr><td>1<td>2</table>" for x in odd] + ["<table><tr><td>a<title></td>b</title><textarea><td>c</textarea><script></td></script>d</b></i><br/>e", "<table><tr><td>a<table><tr><td>b<tr><td>c", "<table><td", "<table><tr><td>a</td", "<table><thead><tr><td>h</table><table><tr><td>x<tr></table>"]
    pages = spark.createDataFrame([(i, p) for i, p in enumerate([*PAGES, *odd])] + [(99, None)], "id int, html string")
    found = H.cells(pages, "id").cache()
    key = lambda rows: sorted((r["id"], r["table"], r["row"], r["header"], list(r["cells"])) for r in rows.collect())
    got = H.page_rows(pages, "id")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert key(got) == key(H.rows(found, "id"))
    assert key(H.page_rows(pages, "id", only_largest=True)) == key(H.rows(found, "id").join(H.largest(found, "id"), ["id", "table"]))


def test_plain_tags_are_read_as_the_parser_reads_them(monkeypatch):
    tags = ["<table>", "</TABLE>", "<tr>", "</tr>", "<td rowspan=2>", "<TD COLSPAN='2'>", '<th rowspan="x">', "<td>", "</td>", "<thead>", "</thead>", "<b>", "</b >", "<br>", "<td a>", "<script>", "</script>", "<!-- <td> -->", "<", "&lt;", "x", "<td\trowspan=2>", "<title>", "</title>", "<td/>"]
    rng = random.Random(4)
    pages = ["<table>" + "".join(rng.choice(tags) for _ in range(rng.randrange(25))) for _ in range(600)]
    read = lambda: [list(H._Cells().eval(p)) for p in pages]
    got = read()
    for name in ("parse_starttag", "parse_endtag", "updatepos"):
        monkeypatch.delattr(H._Tables, name)
    assert got == read()


def test_encodings():
    assert H.decoded("é".encode()) == "é" and H.decoded(b"\x93x\x94") == "“x”" and H.decoded(b"\x81") == "\x81"
