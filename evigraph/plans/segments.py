"""Queries of grouped quantiles and segment evidence: parts as symbols, lines as measurements of three assays and seven segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators import segments as E
from evigraph.operators.order import grouped_quantiles
from evigraph.plans.catalog import Tables, query, rounded

ROWS = """ms AS (SELECT l_returnflag AS assay, l_linenumber AS segment, l_orderkey * 8 + l_linenumber AS row, l_partkey AS part, CASE WHEN l_discount = 0.05 THEN NULL ELSE l_extendedprice * (l_discount - 0.02) END AS x FROM lineitem),
tq AS (SELECT assay, segment, quantile_cont(x, 0.75) FILTER (WHERE x > 0) AS tq, count(*) FILTER (WHERE x > 0) AS positive, count(*) AS source_rows, count(*) FILTER (WHERE x = 0) AS zero_rows FROM ms GROUP BY 1, 2),
un AS (SELECT p_partkey AS symbol FROM part WHERE p_size < 40),
be AS (SELECT b.part AS symbol, a.assay, a.segment, max(a.x) AS value FROM ms a JOIN (SELECT DISTINCT assay, row, part FROM ms) b USING (assay, row) GROUP BY 1, 2, 3),
fa AS (SELECT un.symbol, tq.assay, tq.segment, value, coalesce(value > 0, false) AS observed, tq, CASE WHEN value > 0 THEN greatest(0.5, 1 - exp(-0.5 * power(value / tq, 2))) ELSE 0.5 END / 0.5 AS bf FROM un CROSS JOIN tq LEFT JOIN be ON be.symbol = un.symbol AND be.assay = tq.assay AND be.segment = tq.segment)"""


def measured(t: Tables) -> DataFrame:
    x = F.when(F.col("l_discount") == 0.05, None).otherwise(F.col("l_extendedprice") * (F.col("l_discount") - 0.02))
    return t.lineitem.select(F.col("l_returnflag").alias("assay"), F.col("l_linenumber").alias("segment"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), F.col("l_partkey").alias("part"), x.alias("x"))


def factors(t: Tables) -> DataFrame:
    rows = measured(t)
    return E.segment_factors(rows, rows.select("assay", "row", F.col("part").alias("symbol")), t.part.where("p_size < 40").select(F.col("p_partkey").alias("symbol")))


@query("grouped_quantiles", "SELECT l_returnflag, l_linenumber, unnest([0, 25, 50, 75, 100]) AS percent, round(unnest(quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1])), 6) AS x, count(*) AS n FROM lineitem GROUP BY 1, 2")
def of_groups(t: Tables) -> DataFrame:
    """21 groups of very unequal sizes."""
    found = grouped_quantiles(t.lineitem, ["l_returnflag", "l_linenumber"], F.col("l_extendedprice"), [0.0, 0.25, 0.5, 0.75, 1.0])
    return rounded(found.select("l_returnflag", "l_linenumber", "n", F.posexplode("q").alias("i", "x")).select("l_returnflag", "l_linenumber", (25 * F.col("i")).cast("int").alias("percent"), "x", "n"))


@query("segment_factors", f"WITH {ROWS} SELECT symbol, assay, segment, round(value, 6) AS value, observed, round(bf / 2, 6) AS likelihood, round(bf, 6) AS bayes_factor, round(tq, 6) AS tq FROM fa")
def segment_factors(t: Tables) -> DataFrame:
    return rounded(factors(t))


@query(
    "segment_summary",
    f"WITH {ROWS} SELECT tq.assay, tq.segment, source_rows, positive, zero_rows, round(tq.tq, 6) AS tq, count(*) AS candidates, count(*) FILTER (WHERE observed) AS observed, count(*) FILTER (WHERE bf > 1 + 1e-12) AS supported FROM tq JOIN fa USING (assay, segment) GROUP BY ALL",
)
def segment_summary(t: Tables) -> DataFrame:
    return rounded(E.segment_summary(measured(t), factors(t)))


@query(
    "segment_selection",
    f"WITH {ROWS}, w AS (SELECT assay, segment, CASE WHEN assay = 'N' THEN 0.1 * segment ELSE 0.5 END AS weight FROM tq WHERE segment < 6), s AS (SELECT symbol, ln(0.4 / 0.6) + sum(weight * ln(bf)) AS lo, count(*) FILTER (WHERE bf > 1 + 1e-12) AS streams FROM fa JOIN w USING (assay, segment) GROUP BY 1) "
    "SELECT symbol, round(lo, 6) AS log_odds, round(1 / (1 + exp(-lo)), 6) AS probability, streams FROM s WHERE 1 / (1 + exp(-lo)) > 0.6",
)
def segment_selection(t: Tables) -> DataFrame:
    weights = measured(t).where("segment < 6").select("assay", "segment").distinct().withColumn("weight", F.when(F.col("assay") == "N", 0.1 * F.col("segment")).otherwise(0.5))
    return rounded(E.selected(factors(t), weights, 0.4, 0.6))


ORTHO = """pr AS (SELECT c_custkey AS row, 'p' || (c_custkey % 900) || CASE WHEN c_custkey % 5 = 0 THEN '-2' ELSE '' END AS accession, CASE WHEN c_custkey % 7 > 0 THEN 'G' || c_nationkey ELSE '' END AS symbol FROM customer),
li AS (SELECT DISTINCT upper(a) AS accession, gene FROM (SELECT unnest(['P' || (p_partkey % 700), CASE WHEN p_partkey % 3 = 0 THEN 'p' || (p_partkey % 640) || '-2' ELSE '' END]) AS a, 'E' || (p_partkey % 600) AS gene FROM part) WHERE a <> ''),
oo AS (SELECT DISTINCT 'E' || (o_custkey % 450) AS gene, 'g' || (o_custkey % 25) AS ortholog_of, 'M' || (o_orderkey % 90) AS other_gene, CASE WHEN o_orderkey % 11 = 0 OR o_custkey % 450 < 40 THEN '' ELSE 'm' || (o_orderkey % 90) END AS other_symbol, 'one' AS type, (o_orderkey % 90 % 2)::VARCHAR AS confidence FROM orders WHERE o_orderkey % 4 = 0),
un AS (SELECT DISTINCT 'M' || (p_size) AS canonical FROM part),
k AS (SELECT row, upper(pr.accession) AS accession, symbol, coalesce(x.accession, y.accession) AS key FROM pr LEFT JOIN (SELECT DISTINCT accession FROM li) x ON x.accession = upper(pr.accession) LEFT JOIN (SELECT DISTINCT accession FROM li) y ON y.accession = split_part(upper(pr.accession), '-', 1)),
f AS (SELECT k.*, 'rat_uniprot' AS mapping_source, oo.* FROM k JOIN li ON li.accession = key JOIN oo ON oo.gene = li.gene WHERE key IS NOT NULL UNION ALL SELECT k.*, 'rat_gene_symbol', oo.* FROM k JOIN oo ON ortholog_of = lower(symbol) WHERE key IS NULL AND symbol <> ''),
g AS (SELECT *, max(confidence = '1') OVER (PARTITION BY row) AS sure FROM f WHERE other_symbol <> ''),
mp AS (SELECT row, accession, symbol, mapping_source, CASE WHEN sure THEN 'high_confidence_preferred' ELSE 'low_confidence_fallback' END AS rule, gene, other_gene, other_symbol, coalesce(canonical, '') AS canonical, canonical IS NOT NULL AS in_universe, min(type) AS type, min(confidence) AS confidence
  FROM g LEFT JOIN un ON lower(canonical) = lower(other_symbol) WHERE NOT sure OR confidence = '1' GROUP BY ALL)"""


def orthologs(t: Tables) -> tuple[DataFrame, DataFrame]:
    key, order, part = F.col("c_custkey"), F.col("o_orderkey"), F.col("p_partkey")
    text = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    s = lambda c: c.cast("string")
    proteins = t.customer.select(key.alias("row"), text("p", s(key % 900), F.when(key % 5 == 0, "-2").otherwise("")).alias("accession"), F.when(key % 7 > 0, text("G", s(F.col("c_nationkey")))).otherwise("").alias("symbol"))
    mapping = t.part.select(text("E", s(part % 600)).alias("gene"), text("P", s(part % 700)).alias("one"), F.when(part % 3 == 0, text("p", s(part % 640), "-2")).otherwise("").alias("two"))
    cust = F.col("o_custkey") % 450
    orthology = t.orders.where("o_orderkey % 4 = 0").select(
        text("E", s(cust)).alias("gene"), text("g", s(F.col("o_custkey") % 25)).alias("symbol"), text("M", s(order % 90)).alias("other_gene"),
        F.when((order % 11 == 0) | (cust < 40), "").otherwise(text("m", s(order % 90))).alias("other_symbol"), F.lit("one").alias("type"), s(order % 90 % 2).alias("confidence"),
    )
    universe = t.part.select(text("M", s(F.col("p_size"))).alias("symbol"))
    return E.map_orthologs(proteins, E.accession_genes(mapping, "gene", ["one", "two"]), orthology, universe)


@query("ortholog_cascade", f"WITH {ORTHO} SELECT * FROM mp")
def ortholog_cascade(t: Tables) -> DataFrame:
    return orthologs(t)[0]


@query("ortholog_unmapped", f"WITH {ORTHO} SELECT row, accession, symbol, CASE WHEN key IS NULL THEN 'rat_gene_symbol' ELSE 'rat_uniprot' END AS attempt, 'no_named_mouse_ortholog' AS reason FROM k WHERE row NOT IN (SELECT row FROM mp)")
def ortholog_unmapped(t: Tables) -> DataFrame:
    return orthologs(t)[1]
