"""Tables of web pages, cell by cell.

A table function runs over each page with a stack of open tables, so tables may
stand in cells of others, tags may be left open, and cells may span rows and
columns.  What follows (the largest table of a page, rows as arrays, names for
columns) is grouping of its cells; ``page_rows`` makes rows of a page where it is
read, so that its cells aren't shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = "table int, parent int, row int, col int, header boolean, th boolean, own boolean, text string"
#: Fixed value of the HTML standard: wider spans are cut.
MOST_COLUMNS = 1000
ENCODINGS = ("utf-8", "windows-1252", "latin-1")
#: Tags that need no thought: one attribute at most, quoted as it should be.
OPENS = re.compile(r"""<(table|thead|tbody|tfoot|tr|td|th|b|i|br)(?:[ ]+([a-z]+)=(?:'([^'"<>&]*)'|"([^'"<>&]*)"|([a-z0-9]+)))?[ ]*>""", re.ASCII | re.IGNORECASE)
CLOSES = re.compile(r"</(table|thead|tbody|tfoot|tr|td|th|b|i)>", re.ASCII | re.IGNORECASE)
#: Rows of tables that go on together.
BATCH = 20_000


def decoded(data: bytes) -> str:
    """Text of a page's bytes, by the first encoding that fits; the last one always does."""
    for encoding in ENCODINGS[:-1]:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode(ENCODINGS[-1])


class _Table:
    def __init__(self, number: int, parent: int | None):
        self.number, self.parent = number, parent
        self.row = -1
        self.cells: list[tuple[bool, int, int, list[str]]] | None = None  # of the open row: header, rowspan, colspan, text
        self.cell: list[str] | None = None
        self.down: dict[int, tuple[int, bool, str]] = {}  # columns that a cell above still fills: rows left, header, text
        self.in_head, self.body_seen = False, False


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Table] = []
        self.found: list[tuple] = []
        self.count = 0
        self.silent = 0

    def parse_starttag(self, i: int) -> int:
        plain = OPENS.match(self.rawdata, i)
        if plain is None:
            return super().parse_starttag(i)
        name = plain[2]
        self.handle_starttag(plain[1].lower(), [(name.lower(), plain[plain.lastindex])] if name else [])
        return plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = None if self.cdata_elem else CLOSES.match(self.rawdata, i)
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.stack.append(_Table(self.count, self.stack[-1].number if self.stack else None))
            self.count += 1
        elif self.stack:
            now = self.stack[-1]
            if tag in ("thead", "tbody", "tfoot"):
                self.end_row(now)
                now.in_head = tag == "thead"
            elif tag == "tr":
                self.end_row(now)
                now.cells = []
            elif tag in ("td", "th"):
                if now.cells is None:
                    now.cells = []
                now.cell = []
                given = dict(attrs)
                down, across = (self.span(given.get("rowspan"), 65534), self.span(given.get("colspan"), MOST_COLUMNS)) if given else (1, 1)
                now.cells.append((tag == "th", down, across, now.cell))
            elif tag == "br":
                self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif self.stack:
            now = self.stack[-1]
            if tag == "table":
                self.end_row(now)
                self.stack.pop()
            elif tag in ("tr", "thead", "tbody", "tfoot"):
                self.end_row(now)
                now.in_head = now.in_head and tag == "tr"
            elif tag in ("td", "th"):
                now.cell = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for table in self.stack:  # the text of a table inside a cell is that cell's too
                if table.cell is not None:
                    table.cell.append(data)

    @staticmethod
    def span(value: str | None, most: int) -> int:
        digits = (value or "").strip()
        return max(1, min(int(digits), most)) if digits.isascii() and digits.isdigit() else 1

    def end_row(self, now: _Table) -> None:
        cells, now.cells, now.cell = now.cells, None, None
        if cells is None:
            return
        now.row += 1
        header = now.in_head or (not now.body_seen and bool(cells) and all(c[0] for c in cells))
        now.body_seen |= not header
        col, after = 0, {}
        put = lambda col, head, own, text: self.found.append((now.number, now.parent, now.row, col, header, head, own, text))
        waiting = list(cells)
        while waiting or any(c >= col for c in now.down):
            if col in now.down:
                left, head, text = now.down.pop(col)
                put(col, head, False, text)
                if left > 1:
                    after[col] = (left - 1, head, text)
                col += 1
            elif waiting:
                head, rows, columns, parts = waiting.pop(0)
                text = " ".join("".join(parts).split())
                for i in range(columns):
                    now.down.pop(col, None)  # where spans overlap the later cell stands
                    put(col, head, i == 0, text)
                    if rows > 1:
                        after[col] = (rows - 1, head, text)
                    col += 1
            else:
                col += 1
        now.down = after

    def finish(self) -> list[tuple]:
        self.close()
        while self.stack:  # tables left open
            self.end_row(self.stack.pop())
        return self.found


class _Cells:
    """Cells of one page; ``own`` is false where a span repeats a cell."""

    def eval(self, html: str) -> Iterator[tuple]:
        if html:
            parser = _Tables()
            parser.feed(html)
            yield from parser.finish()


def cells(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table, parent, row, col, header, th, own, text) of every cell of every page's tables.

    Tables are numbered in the order in which they begin; ``parent`` is the table
    around one, and the text of a table in a cell is that cell's too.  Rows and columns
    are those of the grid that spans make.  Rows of a head, and rows of ``th`` cells
    alone before any other, are headers.
    """
    spark = pages.sparkSession
    function = F.udtf(_Cells, returnType=CELLS)
    name = "evigraph_html_cells"
    spark.udtf.register(name, function)
    pages.select(F.col(key).alias("key"), F.col(html).alias("html")).createOrReplaceTempView(view := f"{name}_pages")
    return spark.sql(f"SELECT p.key, c.* FROM {view} p, LATERAL {name}(p.html) c").withColumnRenamed("key", key)


def _grid(html: str) -> list[tuple[int, int, bool, list]]:
    """(table, row, header, cells) of one page, as ``rows`` has them."""
    parser, out = _Tables(), []
    parser.feed(html)
    at = None
    for table, _, row, col, header, _, _, text in parser.finish():
        if at != (table, row):  # a row's cells come together, from left to right
            at = (table, row)
            out.append((table, row, header, []))
        held = out[-1][3]
        held.extend([None] * (col - len(held)))
        held.append(text)
    return out


def _largest(grid: list[tuple[int, int, bool, list]]) -> int | None:
    many: dict[int, int] = {}
    for table, _, header, _ in grid:
        many[table] = many.get(table, 0) + (not header)
    return min(many, key=lambda t: (-many[t], t), default=None)


def page_rows(pages: DataFrame, key: str, html: str = "html", only_largest: bool = False) -> DataFrame:
    """(key, table, row, header, cells): as ``rows`` of ``cells``, of every page or (``only_largest``) of each page's ``largest`` table, a page at a time and without a shuffle.

    A page has a row of ``pages``; its tables' rows are made where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, found = [], []

            def made() -> pa.RecordBatch:
                columns = list(zip(*found, strict=True)) if found else [[]] * 4
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string())), strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *arrays], names=[key, "table", "row", "header", "cells"])

            for i, page in enumerate(batch.column(1)):
                grid = _grid(page.as_py() or "")
                if only_largest:
                    best = _largest(grid)
                    grid = [r for r in grid if r[0] == best]
                place.extend([i] * len(grid))
                found.extend(grid)
                if len(found) >= BATCH:
                    yield made()
                    place, found = [], []
            if found:
                yield made()

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key), F.col(html).alias("html")).mapInArrow(run, f"{key} {kind}, table int, row int, header boolean, cells array<string>")


def rows(found: DataFrame, key: str) -> DataFrame:
    """(key, table, row, header, cells): the grid's rows, empty places filled with null."""
    grouped = found.groupBy(key, "table", "row").agg(F.bool_and("header").alias("header"), F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("at"), F.max("col").alias("last"))
    return grouped.select(key, "table", "row", "header", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.col("at")[i]).alias("cells"))


def largest(found: DataFrame, key: str) -> DataFrame:
    """(key, table): of each page the table with most rows that aren't headers, the first of equal ones."""
    sizes = found.groupBy(key, "table").agg(F.count_distinct(F.when(~F.col("header"), F.col("row"))).alias("n"))
    return sizes.groupBy(key).agg(F.min_by("table", F.struct(-F.col("n"), "table")).alias("table"))


def named(found: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, row, names...): the largest table of each page, its first columns under these names; a narrower table is an error."""
    best = found.join(largest(found, key), [key, "table"]).where("NOT header")
    at = lambda i: F.max(F.when(F.col("col") == i, F.col("text")))
    out = best.groupBy(key, "row").agg(F.max("col").alias("last"), *[at(i).alias(n) for i, n in enumerate(names)])
    narrow = F.raise_error(F.lit(f"a table has fewer than {len(names)} columns")).cast("string")
    whole: list[Column] = [F.when(F.col("last") < len(names) - 1, narrow).otherwise(F.col(names[0])).alias(names[0])]
    return out.select(key, "row", *whole, *names[1:])
