"""Tables of web pages that Spark makes from the driver's tables, read back cell by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.plans.catalog import Tables, query
from evigraph.sources import html as H


def sale_pages(t: Tables) -> DataFrame:
    """A page a sale: a table whose cell holds the table of the lines; the sale's cell spans all lines, and cells aren't closed."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = t.sale_lines.where("sale_id IS NOT NULL").select("sale_id", F.struct(text("line_no").alias("a"), text("item_id").alias("b"), text("flag").alias("c")).alias("line"))
    sales = lines.groupBy("sale_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    cell = lambda x: F.concat(F.lit("<td>"), x)
    first = F.concat(F.lit("<td rowspan="), F.size("lines").cast("string"), F.lit("> <b>"), F.col("sale_id").cast("string"), F.lit("</b>"))
    row = lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, first).otherwise(""), cell(x["a"]), cell(F.concat(F.lit("<!-- <td> -->\n"), x["b"])), F.lit("<td colspan='2'>"), x["c"])
    inner = F.concat(F.lit("<TABLE><tr><th>sale<th>line<th>item<th colspan=2>flag</th></tr>"), F.array_join(F.transform("lines", row), "\n"), F.lit("</TABLE>"))
    page = F.concat(F.lit("<html><script>'<table>'</script><table class=a><tr><th>sale</th><th>lines</th></tr><tr><td>x</td><td>"), inner, F.lit("</td></tr></table></html>"))
    return sales.select("sale_id", page.alias("html"))


LINES = """ln AS (SELECT sale_id, coalesce(line_no::VARCHAR, '') AS line, coalesce(item_id::VARCHAR, '') AS item, coalesce(flag, '') AS flag FROM sale_lines WHERE sale_id IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY line, item, flag) AS row, count(*) OVER (PARTITION BY sale_id) AS n FROM ln)"""


@query(
    "html_tables",
    f"WITH {LINES} SELECT sale_id, 1 AS \"table\", row::INT AS row, false AS header, concat_ws('|', sale_id, line, item, flag, flag) AS cells FROM rk UNION ALL SELECT DISTINCT sale_id, 1, 0, true, 'sale|line|item|flag|flag' FROM rk "
    "UNION ALL SELECT DISTINCT sale_id, 0, 0, true, 'sale|lines' FROM rk",
)
def tables_of_pages(t: Tables) -> DataFrame:
    """Nested tables, spans over rows and columns, cells left open, comments and scripts; the outer table's long cell is left out."""
    found = H.page_rows(sale_pages(t), "sale_id").where("table = 1 OR row = 0")
    return found.select("sale_id", "table", "row", "header", F.array_join("cells", "|").alias("cells"))


@query("html_largest_table", f"WITH {LINES} SELECT sale_id, row::INT AS row, sale_id::VARCHAR AS sale, line, item, flag FROM rk WHERE n > 1 UNION ALL SELECT sale_id, 1, 'x', trim('salelineitemflag ' || sale_id || line || ' ' || item || flag), NULL, NULL FROM rk WHERE n = 1")
def largest_table(t: Tables) -> DataFrame:
    """Of a sale with one line both tables have one row, and the outer one comes first; it has two columns."""
    best = H.page_rows(sale_pages(t), "sale_id", only_largest=True).where("NOT header")
    return best.select("sale_id", "row", *[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(("sale", "line", "item", "flag"))])


@query(
    "html_tables_of_pages",
    "SELECT page_id, i::INT AS row, (i - 1)::VARCHAR AS place, trim(l[i]) AS target FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href=\"/([a-z0-9/_-]+)\"', 1) AS l FROM pages) WHERE len(l) > 0)",
)
def tables_in_pages(t: Tables) -> DataFrame:
    """Every page's links, put into a table of their own with a head over both columns."""
    links = F.regexp_extract_all("html", F.lit('href="/([a-z0-9/_-]+)"'), F.lit(1))
    row = lambda x, i: F.concat(F.lit("<tr><td>"), i.cast("string"), F.lit("<td><i>"), x, F.lit("</i>"))
    made = F.concat(F.lit("<table><thead><tr><th colspan=2>links</th></tr></thead><tbody>"), F.array_join(F.transform(links, row), ""), F.lit("</table>"))
    pages = t.pages.select("page_id", made.alias("made"))
    return H.named(H.cells(pages, "page_id", "made"), "page_id", ["place", "target"])
