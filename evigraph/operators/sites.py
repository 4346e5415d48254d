"""A database of observed sites: positions named in feature text, and measured ones, put together by position.

Feature text is parsed by patterns in the JVM.  A protein's sites and a data
set's rows meet by one aggregation over (symbol, residue, position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLANK = 6
WINDOW = 2 * FLANK + 1
SCORABLE = ("S", "T", "Y")
#: How features and sites are written.
FEATURE = r'MOD_RES\s+(\d+)(?:\.\.(\d+))?;\s*/note="([^"]+)"(?:;\s*/evidence="([^"]*)")?'
SITE = r"^\s*([A-Za-z])\s*(\d+)\s*$"
MODIFICATION = {"S": "Phosphoserine", "T": "Phosphothreonine", "Y": "Phosphotyrosine"}


def letters(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))


def features(entries: DataFrame, text: str = "features") -> DataFrame:
    """Adds first, last, note and evidence: a row for each modified residue that the text names."""
    group = lambda i: F.regexp_extract_all(text, F.lit(FEATURE), F.lit(i))
    parts = F.arrays_zip(group(1).alias("first"), group(2).alias("last"), group(3).alias("note"), group(4).alias("evidence"))
    rows = entries.withColumn("_f", F.explode(parts))
    first = F.col("_f.first").cast("long")
    last = F.when(F.col("_f.last") != "", F.col("_f.last").cast("long")).otherwise(first)
    return rows.select(*entries.columns, first.alias("first"), last.alias("last"), F.col("_f.note").alias("note"), F.col("_f.evidence").alias("evidence"))


def window_of(sequence: Column, position: Column) -> Column:
    """The letters around a position, or null where the sequence ends before."""
    inside = (position > FLANK) & (position + FLANK <= F.length(sequence))
    return F.when(inside, F.substring(sequence, (position - FLANK).cast("int"), F.lit(WINDOW)))


def mapped_proteins(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """(symbol, selected, accession, method, reviewed, features, sequence) of every node (symbol, accessions: array).

    An accession that isn't known is looked up without what follows its hyphen, so
    isoforms get their canonical entry.  Among a node's entries, and among those of
    its gene name if it has none, then of its synonyms: one whose primary name the
    symbol is, a reviewed one, the one with most phosphorylated residues, the longest,
    the first accession.  ``entries``: (accession, reviewed, primary, synonyms, features, sequence).
    """
    e = entries.withColumn("sequence", letters(F.col("sequence"))).withColumn("key", F.upper(F.trim("accession"))).where("key <> ''")
    e = e.withColumn("phospho", F.regexp_count(F.lower(F.coalesce("features", F.lit(""))), F.lit("phospho")))
    words = lambda c: F.filter(F.split(F.upper(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")
    e = e.withColumns({"primary_names": words(F.col("primary")), "synonym_names": words(F.col("synonyms"))})
    kept = F.array_sort(F.array_distinct(F.filter(F.transform("accessions", lambda x: F.trim(x)), lambda x: x != "")))
    n = nodes.select("symbol", F.coalesce(kept, F.array().cast("array<string>")).alias("selected_all"), F.upper("symbol").alias("name"))
    asked = n.select("symbol", "name", F.explode("selected_all").alias("selected"))
    known = e.select("key").distinct()
    exact = asked.join(known.select(F.col("key").alias("as_is"), F.lit(True).alias("found")), F.upper("selected") == F.col("as_is"), "left")
    key = F.when(F.col("found"), F.upper("selected")).when(F.contains("selected", F.lit("-")), F.upper(F.substring_index("selected", "-", 1)))
    hits = exact.select("symbol", "name", "selected", key.alias("key")).join(e, "key").withColumn("step", F.lit(0))
    by = lambda names, step: n.select("symbol", "name").join(e.withColumn("name_", F.explode(names)), F.col("name") == F.col("name_")).drop("name_").withColumns({"selected": F.lit(None).cast("string"), "step": F.lit(step)})
    rows = hits.unionByName(by("primary_names", 1)).unionByName(by("synonym_names", 2))
    exact_name = F.array_contains("primary_names", F.col("name"))
    order = ["step", exact_name.desc(), F.col("reviewed").desc(), F.desc("phospho"), F.desc(F.length("sequence")), F.col("selected").asc_nulls_last(), "accession"]
    best = rows.withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy(*order))).where("nth = 1")
    canonical = F.upper("selected") == F.upper(F.trim("accession"))
    method = F.when(F.col("step") == 1, "gene_primary_fallback").when(F.col("step") == 2, "gene_synonym_fallback").when(canonical, "selected_accession_exact").otherwise("selected_accession_canonicalized")
    found = best.select("symbol", F.col("selected").alias("chosen"), "accession", method.alias("method"), "reviewed", "features", "sequence")
    out = n.join(found, "symbol", "left")
    missing = F.when(F.size("selected_all") > 0, "selected_accession_missing").otherwise("no_accession_or_gene_match")
    first = F.when(F.size("selected_all") > 0, F.col("selected_all")[0]).otherwise("")
    return out.select("symbol", F.coalesce("chosen", first).alias("selected"), F.coalesce("accession", F.lit("")).alias("accession"), F.coalesce("method", missing).alias("method"), "reviewed", "features", F.coalesce("sequence", F.lit("")).alias("sequence"))


def annotated(proteins: DataFrame) -> DataFrame:
    """Observations of (symbol, accession, features, sequence): phosphorylated residues at one position; ranges are left out."""
    rows = features(proteins.select("symbol", "accession", "features", "sequence")).where(F.contains(F.lower("note"), F.lit("phospho")) & (F.col("first") == F.col("last")))
    position, size = F.col("first"), F.length("sequence")
    inside = (position >= 1) & (position <= size)
    residue = F.when(inside, F.substring("sequence", position.cast("int"), F.lit(1))).otherwise("?")
    return rows.select(
        "symbol", F.col("accession").alias("node_accession"), position.alias("position"), residue.alias("residue"), F.lit("uniprot_annotated").alias("source"), F.col("accession").alias("source_accession"),
        F.col("note").alias("modification"), "evidence", F.when(inside, window_of(F.col("sequence"), position)).alias("canonical_window"), F.lit(None).cast("string").alias("dataset_window"),
        F.array(F.when(inside, "canonical_residue_from_uniprot").otherwise("uniprot_position_out_of_range")).alias("validation"),
    )


def measured(rows: DataFrame, proteins: DataFrame, evidence: str) -> DataFrame:
    """Observations of a data set (symbol, site, accession, window), checked against the proteins' sequences; sites that aren't a letter and a number are left out."""
    p = proteins.select(F.upper("symbol").alias("name"), "symbol", "accession", "sequence")
    d = rows.select(F.upper(F.coalesce("symbol", F.lit(""))).alias("name"), "site", F.coalesce("accession", F.lit("")).alias("source_accession"), letters(F.col("window")).alias("window")).join(p, "name")
    d = d.where(F.rlike(F.coalesce("site", F.lit("")), F.lit(SITE)))
    residue, position = F.upper(F.regexp_extract("site", SITE, 1)), F.regexp_extract("site", SITE, 2).cast("long")
    d = d.withColumns({"residue": residue, "position": position, "size": F.length("sequence")})
    inside = (F.col("position") >= 1) & (F.col("position") <= F.col("size"))
    there = F.substring("sequence", F.col("position").cast("int"), F.lit(1))
    canonical = (
        F.when(F.col("size") == 0, "canonical_sequence_unmapped").when(~inside, "canonical_position_out_of_range").when(there == F.col("residue"), "canonical_sequence_match")
        .otherwise(F.concat(F.lit("canonical_residue_mismatch:"), there))
    )
    given = F.length("window") == WINDOW
    middle = F.substring("window", FLANK + 1, 1)
    center = F.when(given, F.when(middle == F.col("residue"), "dataset_window_center_match").otherwise(F.concat(F.lit("dataset_window_center_mismatch:"), middle)))
    known = F.element_at(F.create_map(*[F.lit(x) for pair in MODIFICATION.items() for x in pair]), F.col("residue"))
    return d.select(
        "symbol", F.col("accession").alias("node_accession"), "position", "residue", F.lit("dataset_observed").alias("source"), "source_accession", F.coalesce(known, F.lit("Phosphorylated residue")).alias("modification"),
        F.lit(evidence).alias("evidence"), F.when(inside & (there == F.col("residue")), window_of(F.col("sequence"), F.col("position"))).alias("canonical_window"), F.when(given, F.col("window")).alias("dataset_window"),
        F.array_compact(F.array(canonical, center)).alias("validation"),
    )


def database(*observations: DataFrame) -> DataFrame:
    """One row a symbol, residue and position: sources and notes put together, one window, and whether it can be scored."""
    rows = observations[0]
    for more in observations[1:]:
        rows = rows.unionByName(more)
    joined = lambda c: F.array_join(F.array_sort(F.filter(F.collect_set(c), lambda x: x != "")), ";")
    sets = rows.groupBy("symbol", "residue", "position").agg(
        F.min("node_accession").alias("node_accession"), joined("source_accession").alias("source_accession"), joined("modification").alias("modification"), joined("source").alias("sources"), joined("evidence").alias("evidence"),
        F.min("canonical_window").alias("canonical"), F.min("dataset_window").alias("supplied"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("validation")))), ";").alias("validation"),
    )
    window = F.coalesce("canonical", "supplied")
    named = F.array_join(F.array_compact(F.array(F.when(F.col("canonical").isNotNull(), "canonical_uniprot"), F.when(F.col("supplied").isNotNull(), "dataset_supplied"))), ";")
    return sets.select(
        "symbol", "node_accession", "source_accession", F.concat("residue", F.col("position").cast("string")).alias("site"), "position", "residue", "modification", "sources", "evidence", F.coalesce(window, F.lit("")).alias("window"),
        F.coalesce(F.concat(F.substring(window, 1, FLANK + 1), F.lit("*"), F.substring(window, FLANK + 2, FLANK)), F.lit("")).alias("notation"), (window.isNotNull() & F.col("residue").isin(*SCORABLE)).alias("scorable"), named.alias("window_source"), "validation",
    )


def candidates(proteins: DataFrame, observed: DataFrame) -> DataFrame:
    """(symbol, site, position, residue, window, scorable, sources): every serine, threonine and tyrosine, and what it was observed by."""
    places = F.transform(F.sequence(F.lit(1), F.length("sequence")), lambda i: F.struct(i.cast("long").alias("position"), F.substring("sequence", i, F.lit(1)).alias("residue")))
    rows = proteins.where(F.length("sequence") > 0).select("symbol", "sequence", F.inline(F.filter(places, lambda x: x["residue"].isin(*SCORABLE))))
    rows = rows.withColumn("window", window_of(F.col("sequence"), F.col("position")))
    seen = observed.select("symbol", "residue", "position", "sources")
    return rows.join(seen, ["symbol", "residue", "position"], "left").select(
        "symbol", F.concat("residue", F.col("position").cast("string")).alias("site"), "position", "residue", F.coalesce("window", F.lit("")).alias("window"), F.col("window").isNotNull().alias("scorable"), F.coalesce("sources", F.lit("")).alias("sources")
    )
