"""Records to entities: collapsing repeated rows, resolving names, status by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.keys import joined_set


def collapse_profiles(rows: DataFrame, symbol: str, entry: str, order: str, fractions: list[str]) -> DataFrame:
    """One profile a symbol (without case): of the different ones that with the largest total, then the least entry.

    Of equal profiles the first by ``order`` stands for all; missing fractions are 0.
    """
    numbers = [F.coalesce(F.expr(f"try_cast({f} AS double)"), F.lit(0.0)).alias(f) for f in fractions]
    r = rows.select(F.trim(symbol).alias("symbol"), F.col(entry).alias("entry"), F.col(order).alias("at"), *numbers).where("symbol != ''")
    r = r.withColumn("key", F.upper("symbol")).withColumn("total", sum((F.col(f) for f in fractions[1:]), F.col(fractions[0])))
    profiles = r.groupBy("key", "total", *fractions).agg(F.min_by(F.struct("symbol", "entry"), "at").alias("first"), F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("first.symbol", "first.entry", *fractions), F.struct(-F.col("total"), F.col("first.entry"))).alias("best")
    out = profiles.groupBy("key").agg(best, F.sum("n").alias("entries"), F.count(F.lit(1)).alias("profiles"))
    return out.select("key", "best.*", "entries", "profiles")


def collapse_chemicals(rows: DataFrame) -> DataFrame:
    """(messenger, protein) with ids, representations, rows and the largest score, from (messenger, protein, cid, chemical, score)."""
    representation = F.substring("chemical", 1, 4)
    return rows.groupBy("messenger", "protein").agg(
        joined_set(F.col("cid").cast("string")).alias("cids"), joined_set(F.col("chemical")).alias("chemicals"), joined_set(representation).alias("representations"),
        F.count(F.lit(1)).alias("rows"), F.max("score").alias("combined_score"),
    ).withColumn("score", F.col("combined_score") / 1000.0)


def collapse_locations(rows: DataFrame) -> DataFrame:
    """(gene, term) with the largest confidence, the name of the strongest row, and what supports it."""
    strongest = F.min_by("location", F.struct(-F.col("confidence"), "location", "source", "code")).alias("location")
    return rows.groupBy("gene", "term").agg(
        strongest, F.max("confidence").alias("confidence"), joined_set(F.col("source")).alias("sources"), joined_set(F.col("code")).alias("codes"),
        joined_set(F.col("protein").cast("string")).alias("proteins"), F.count(F.lit(1)).alias("rows"),
    )


def collapse_classes(annotations: DataFrame, experimental: list[str]) -> DataFrame:
    """One row an accession: the union of its classes, its terms and codes, and whether any is experimental."""
    flat = annotations.select("accession", "term", "code", F.explode_outer("classes").alias("class"))
    seen = F.bool_or(F.col("code").isin(experimental))
    return flat.groupBy("accession").agg(
        joined_set(F.col("class")).alias("classes"), F.count_distinct("class").alias("n_classes"), F.count_distinct("term").alias("n_terms"),
        joined_set(F.col("code")).alias("codes"), seen.alias("has_experimental"),
    )


def profile_status(protein: Column, ambiguous: Column, ortholog: Column, ambiguous_name: Column, known: Column, positive: Column) -> Column:
    """Why a node has a profile or none: the first rule that holds."""
    return (
        F.when(~protein, "excluded: no protein")
        .when(ambiguous, "ambiguous ortholog")
        .when(ortholog.isNull() | (ortholog == ""), "no one-to-one ortholog")
        .when(ambiguous_name, "ambiguous gene name")
        .when(~known, "ortholog without record")
        .when(positive, "mapped, with locations")
        .otherwise("mapped, without certain location")
    )


def unambiguous(relation: DataFrame, key: str) -> DataFrame:
    """Rows of keys with one different row only; the other side may repeat."""
    r = relation.distinct()
    return r.join(r.groupBy(key).count().where("count = 1").select(key), key, "left_semi").select(*relation.columns)


def lookups(entries: DataFrame) -> DataFrame:
    """(name, step, accession, method) of entries (accession, primary, synonyms): arrays of names, all without case."""
    upper = lambda c: F.upper(F.trim(c))
    one = entries.select(upper("accession").alias("name"), F.lit(0).alias("step"), "accession", F.lit("accession").alias("method"))
    two = entries.select(F.explode("primary").alias("n"), "accession").select(upper("n").alias("name"), F.lit(1).alias("step"), "accession", F.lit("primary name").alias("method"))
    three = entries.select(F.explode("synonyms").alias("n"), "accession").select(upper("n").alias("name"), F.lit(2).alias("step"), "accession", F.lit("synonym").alias("method"))
    return one.unionByName(two).unionByName(three)


def resolve_targets(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """(wanted, accession, symbol, method): by accession, else primary name, else synonym.

    Among several entries of a step: primary name equal, reviewed, more sites,
    longer sequence, then the least accession.  What isn't found has nulls.
    """
    names = wanted.select("wanted", F.upper(F.trim("wanted")).alias("name")).distinct()
    facts = entries.select("accession", "primary", "reviewed", "sites", "length")
    met = names.join(lookups(entries), "name").join(facts, "accession")
    own = F.exists("primary", lambda p: F.upper(p) == F.col("name")).cast("int")
    rank = F.struct("step", -own, -F.col("reviewed").cast("int"), -F.col("sites"), -F.col("length"), "accession")
    best = met.groupBy("wanted").agg(F.min_by(F.struct("accession", F.get("primary", F.lit(0)).alias("symbol"), "method"), rank).alias("b"))
    return wanted.select("wanted").distinct().join(best, "wanted", "left").select("wanted", "b.accession", "b.symbol", "b.method")


def resolve_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(wanted, node, status): the exact name, else the only one without regard to case; several are ambiguous."""
    exact = nodes.select(F.col("node").alias("wanted"), F.lit(True).alias("exact")).distinct()
    folded = nodes.select(F.lower("node").alias("low"), "node").distinct().groupBy("low").agg(F.min("node").alias("one"), F.count(F.lit(1)).alias("n"))
    rows = wanted.select("wanted").distinct().join(exact, "wanted", "left").withColumn("low", F.lower(F.trim("wanted"))).join(folded, "low", "left")
    node = F.when(F.col("exact"), F.col("wanted")).when(F.col("n") == 1, F.col("one"))
    status = F.when(F.col("exact"), "exact").when(F.col("n") == 1, "without case").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return rows.select("wanted", node.alias("node"), status.alias("status"))


def endpoint_map(records: DataFrame, symbols: DataFrame, accessions: DataFrame, case: bool = True) -> DataFrame:
    """Adds ``node`` and ``by`` to (symbol, accession): the exact symbol, else the accession, else nothing; ``case`` False folds both."""
    fold = (lambda c: F.col(c)) if case else (lambda c: F.lower(F.trim(c)))
    s = symbols.select(fold("node").alias("_s"), F.col("node").alias("_by_symbol")).groupBy("_s").agg(F.min("_by_symbol").alias("_by_symbol"))
    a = accessions.select(fold("accession").alias("_a"), F.col("node").alias("_by_accession")).groupBy("_a").agg(F.min("_by_accession").alias("_by_accession"))
    rows = records.withColumn("_s", fold("symbol")).withColumn("_a", fold("accession")).join(s, "_s", "left").join(a, "_a", "left")
    by = F.when(F.col("_by_symbol").isNotNull(), "symbol").when(F.col("_by_accession").isNotNull(), "accession").otherwise("unmapped")
    return rows.select(*records.columns, F.coalesce("_by_symbol", "_by_accession").alias("node"), by.alias("by"))


def alias_hits(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Alias rows (id, alias, source) of the names asked for, without case; names go out, aliases stay where they are."""
    names = wanted.select(F.lower(F.trim("wanted")).alias("low"), "wanted").distinct()
    return aliases.withColumn("low", F.lower(F.trim("alias"))).join(names, "low").select("wanted", "id", "alias", "source")


def choose_ids(hits: DataFrame, preferred: list[str]) -> DataFrame:
    """(wanted, id, status) by the best source in order; several ids of that source are ambiguous."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("source")), F.lit(0))
    rank = F.when(rank > 0, rank).otherwise(len(preferred) + 1)
    groups = hits.withColumn("rank", rank).groupBy("wanted", "rank").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    best = groups.groupBy("wanted").agg(F.min_by(F.struct("n", "id"), "rank").alias("b"))
    one = F.col("b.n") == 1
    return best.select("wanted", F.when(one, F.col("b.id")).alias("id"), F.when(one, "mapped").otherwise("ambiguous").alias("status"))
