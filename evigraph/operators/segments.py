"""Evidence of several assays and segments at once: mapped to symbols, scored against each group's own background.

Measurements are long rows (assay, segment, row, x).  All groups' thresholds come
from one ordered pass, all factors from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import kernels as K
from evigraph.operators.order import grouped_quantiles

GROUP = ["assay", "segment"]


def accession_genes(mapping: DataFrame, gene: str, columns: list[str]) -> DataFrame:
    """(accession, gene): accession columns put under each other, upper-cased, empty ones left out, each link once."""
    long = mapping.select(F.col(gene).alias("gene"), F.explode(F.array(*[F.upper(F.trim(F.col(c))) for c in columns])).alias("accession"))
    return long.where("accession <> '' AND gene <> ''").select("accession", "gene").distinct()


def map_orthologs(proteins: DataFrame, links: DataFrame, orthology: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapped, unmapped) rows of (row, accession, symbol).

    An accession is looked up as it is, then without what follows its hyphen; its
    genes' orthologs count, even if there are none.  Only rows whose accession is not
    known go by symbol, without regard to case.  Of a row's named orthologs those of
    confidence ``1`` are taken if there are any, else all.  ``links``: (accession,
    gene); ``orthology``: (gene, symbol, other_gene, other_symbol, type, confidence);
    ``symbols`` (symbol): those of the universe, whose spelling is taken.
    """
    plain = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rows = proteins.select("row", F.upper(plain(F.col("accession"))).alias("accession"), plain(F.col("symbol")).alias("symbol"))
    rows = rows.withColumn("base", F.substring_index("accession", "-", 1))
    known = links.select("accession").distinct()
    for name in ("accession", "base"):
        rows = rows.join(known.select(F.col("accession").alias(name), F.lit(True).alias(f"{name}_known")), name, "left")
    key = F.when(F.col("accession_known"), F.col("accession")).when(F.col("base_known"), F.col("base"))
    rows = rows.select("row", "accession", "symbol", key.alias("key"), F.when(key.isNull(), "rat_gene_symbol").otherwise("rat_uniprot").alias("mapping_source"))
    o = orthology.select(*[plain(F.col(c)).alias(c) for c in orthology.columns]).withColumnRenamed("symbol", "ortholog_of")
    # named orthologs of each key or symbol, worked out once however many rows have it
    o = o.where("other_symbol <> ''")
    by_gene = links.join(o.where("gene <> ''"), "gene").select(F.lit("rat_uniprot").alias("mapping_source"), F.col("accession").alias("name"), *o.columns)
    by_symbol = o.select(F.lit("rat_gene_symbol").alias("mapping_source"), F.lower("ortholog_of").alias("name"), *o.columns)
    named = by_gene.unionByName(by_symbol.where("name <> ''"))
    by = ["mapping_source", "name"]
    entry = F.struct("type", "confidence", "ortholog_of")
    # those of confidence 1 alone, and all
    each = named.groupBy(*by, "gene", "other_gene", "other_symbol").agg(F.min(entry).alias("all"), F.min(F.when(F.col("confidence") == "1", entry)).alias("high"))
    canonical = symbols.select("symbol").where("symbol <> ''").groupBy(F.lower("symbol").alias("k")).agg(F.max("symbol").alias("canonical"))
    each = each.join(canonical, F.lower("other_symbol") == F.col("k"), "left").drop("k")
    flags = each.groupBy(*by).agg((F.count("high") > 0).alias("any_high"))
    rows = rows.distinct().withColumn("name", F.when(F.col("key").isNotNull(), F.col("key")).otherwise(F.lower("symbol")))
    met = rows.join(flags, by).withColumn("sure", F.bool_or("any_high").over(Window.partitionBy("row")))
    found = met.join(each, by).where("NOT sure OR high IS NOT NULL").withColumn("o", F.when(F.col("sure"), F.col("high")).otherwise(F.col("all")))
    rule = F.when(F.col("sure"), "high_confidence_preferred").otherwise("low_confidence_fallback")
    mapped = found.select("row", "accession", "symbol", "mapping_source", rule.alias("rule"), "gene", "other_gene", "other_symbol", F.coalesce("canonical", F.lit("")).alias("canonical"), F.col("canonical").isNotNull().alias("in_universe"), "o.type", "o.confidence")
    lost = rows.join(met.select("row").distinct(), "row", "left_anti")
    return mapped, lost.select("row", "accession", "symbol", F.col("mapping_source").alias("attempt"), F.lit("no_named_mouse_ortholog").alias("reason"))


def thresholds(measured: DataFrame, q: float = 0.75) -> DataFrame:
    """(assay, segment, tq, positive): the quantile of all positive finite values of each group, mapped or not."""
    x = K.finite(F.col("x"))
    found = grouped_quantiles(measured.select(*GROUP, F.when(x > 0, x).alias("x")), GROUP, F.col("x"), [q])
    return found.select(*GROUP, F.col("q")[0].alias("tq"), F.col("n").alias("positive"))


def segment_factors(measured: DataFrame, mapping: DataFrame, universe: DataFrame, q: float = 0.75) -> DataFrame:
    """(symbol, assay, segment, value, observed, likelihood, bayes_factor, tq) of every symbol of the universe in every group.

    A symbol's value is the greatest of the rows mapped to it (``mapping``: assay,
    row, symbol).  Zeros, negative and missing values are no detection: factor 1.
    """
    tq = thresholds(measured, q)
    best = measured.join(mapping.select("assay", "row", "symbol").distinct(), ["assay", "row"]).groupBy("symbol", *GROUP).agg(F.max(K.finite(F.col("x"))).alias("value"))
    every = universe.select("symbol").distinct().select("symbol", F.lit(1).alias("_one")).join(F.broadcast(tq.select(F.collect_list(F.struct(*GROUP, "tq")).alias("g"))))  # a few groups, in one row
    rows = every.select("symbol", F.inline("g")).join(best, ["symbol", *GROUP], "left")
    observed = F.coalesce(F.col("value") > 0, F.lit(False))
    likelihood = F.when(observed, F.greatest(F.lit(K.NEUTRAL), K.saturation(F.col("value"), F.col("tq")))).otherwise(F.lit(K.NEUTRAL))
    return rows.select("symbol", *GROUP, "value", observed.alias("observed"), likelihood.alias("likelihood"), (likelihood / K.NEUTRAL).alias("bayes_factor"), "tq")


def segment_summary(measured: DataFrame, factors: DataFrame, q: float = 0.75) -> DataFrame:
    """By group: rows, positive rows, zeros, threshold, symbols, those observed and those whose factor isn't neutral."""
    source = measured.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(K.finite(F.col("x")) == 0).alias("zero_rows"))
    scored = factors.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("candidates"), F.count_if("observed").alias("observed"), F.count_if(F.col("bayes_factor") > 1 + 1e-12).alias("supported"))
    return source.join(thresholds(measured, q), GROUP).join(scored, GROUP).select(*GROUP, "source_rows", "positive", "zero_rows", "tq", "candidates", "observed", "supported")


def selected(factors: DataFrame, weights: DataFrame, prior: float, cutoff: float) -> DataFrame:
    """(symbol, log_odds, probability, streams) above a probability: groups that are on (assay, segment, weight), weighted logs summed up."""
    on = factors.join(F.broadcast(weights.where("weight > 0")), GROUP)  # a row a group
    sums = on.groupBy("symbol").agg(F.sum(F.col("weight") * F.ln("bayes_factor")).alias("log_bf"), F.count_if(F.col("bayes_factor") > 1 + 1e-12).alias("streams"))
    odds = K.logit(F.lit(prior)) + F.col("log_bf")
    return sums.select("symbol", odds.alias("log_odds"), K.expit(odds).alias("probability"), "streams").where(F.col("probability") > cutoff)
