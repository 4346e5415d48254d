"""Readers of the evidence sources' own files, and the sinks of a round."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.sources.readers import write_delimited


def _checked(value, ok, message: str):
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def read_links(spark: SparkSession, path: str, ids: DataFrame, sep: str = " ") -> DataFrame:
    """(node_a, node_b, score): links between known ids (id, node), combined score over 1000, the largest of a pair."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    known = lambda end, name: ids.select(F.col("id").alias(end), F.col("node").alias(name))
    met = rows.select("protein1", "protein2", F.col("combined_score").cast("double").alias("s")).join(known("protein1", "a"), "protein1").join(known("protein2", "b"), "protein2")
    return met.where("a != b").groupBy(F.least("a", "b").alias("node_a"), F.greatest("a", "b").alias("node_b")).agg((F.max("s") / 1000).alias("score"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(id, alias, source), commented header or none."""
    rows = spark.read.option("sep", "\t").option("comment", "#").csv(path)
    return rows.select(F.col("_c0").alias("id"), F.col("_c1").alias("alias"), F.col("_c2").alias("source"))


def read_chemical_links(spark: SparkSession, path: str, messengers: DataFrame) -> DataFrame:
    """(messenger, protein, cid, chemical, score) of known chemicals (cid, messenger); scores outside 150 to 999 are an error."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path).toDF("chemical", "protein", "score")
    cid = F.expr("try_cast(substring(chemical, 5) AS bigint)")
    known = rows.withColumn("cid", cid).join(F.broadcast(messengers.select("cid", "messenger")) if messengers.count() < 100_000 else messengers, "cid")
    score = F.col("score").cast("int")
    return known.select("messenger", "protein", "cid", "chemical", _checked(score, score.between(150, 999), "score outside 150 to 999").alias("score"))


def read_uniprot(spark: SparkSession, path: str) -> DataFrame:
    """(accession, primary, synonyms, reviewed, sites, length, sequence): names as arrays, the number of phospho features."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    names = lambda c: F.filter(F.split(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"[;\s]+"), lambda x: x != "")
    return rows.select(
        F.col("Entry").alias("accession"), names("Gene Names (primary)").alias("primary"), names("Gene Names (synonym)").alias("synonyms"),
        (F.lower(F.trim("Reviewed")) == "reviewed").alias("reviewed"),
        F.regexp_count(F.lower(F.coalesce(F.col("Modified residue"), F.lit(""))), F.lit("phospho")).alias("sites"),
        F.length("Sequence").alias("length"), F.col("Sequence").alias("sequence"),
    )


def read_matrices(spark: SparkSession, folder: str, rows: int = 22, columns: int = 13) -> DataFrame:
    """(matrix, row, col, value) of a folder of CSV matrices, one a file; another shape is an error."""
    text = spark.read.text(f"{folder}/*.csv", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1).alias("matrix"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    cells = F.transform(lines, lambda x: F.split(x, ","))
    right = (F.size(cells) == rows + 1) & F.forall(cells, lambda c: F.size(c) == columns + 1)
    table = text.select("matrix", _checked(cells, right, "a matrix of another shape").alias("cells"))
    header = F.transform(F.slice(F.col("cells")[0], 2, columns), lambda x: F.trim(x))
    row = table.select("matrix", header.alias("header"), F.explode(F.slice("cells", 2, rows)).alias("line"))
    cell = row.select("matrix", F.trim(F.col("line")[0]).alias("row"), F.explode(F.arrays_zip(F.col("header").alias("col"), F.slice("line", 2, columns).alias("value"))).alias("c"))
    return cell.select("matrix", "row", "c.col", F.col("c.value").cast("double").alias("value"))


def read_scope_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the first Ensembl id of each line, without its version."""
    ident = F.regexp_extract("value", r"(ENS[A-Z]*\d+)", 1)
    return spark.read.text(path).select(ident.alias("id")).where("id != ''").distinct()


def read_compartments(spark: SparkSession, path: str) -> DataFrame:
    """(protein, gene, term, location, source, code, confidence) without a header; missing text or a confidence outside 1 to 5 is an error."""
    names = ["protein", "gene", "term", "location", "source", "code", "confidence"]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).option("sep", "\t").csv(path)
    score = F.expr("try_cast(confidence AS int)")
    whole = F.forall(F.array(*names[:-1]), lambda x: x.isNotNull())
    return rows.select(*names[:-1], _checked(score, whole & F.coalesce(score.between(1, 5), F.lit(False)), "a bad row").alias("confidence"))


def structural_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(node_a, node_b, score, models): the largest ipTM of each finished pair ``A_and_B/ranking_debug.json``."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "ranking_debug.json").text(folder, wholetext=True)
    pair = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"/([^/]+)/ranking_debug\.json$", 1)
    rows = text.select(F.split(pair, "_and_").alias("p"), F.from_json(F.get_json_object("value", "$.iptm"), "map<string,double>").alias("iptm"))
    rows = rows.where("size(p) = 2 AND size(iptm) > 0")
    return rows.groupBy(F.least(F.col("p")[0], F.col("p")[1]).alias("node_a"), F.greatest(F.col("p")[0], F.col("p")[1]).alias("node_b")).agg(
        F.max(F.array_max(F.map_values("iptm"))).alias("score"), F.sum(F.size("iptm")).alias("models")
    )


def collected(scores: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of the pairs asked for, and the pairs that are missing."""
    pairs = wanted.select("node_a", "node_b").distinct()
    return pairs.join(scores, ["node_a", "node_b"]), pairs.join(scores, ["node_a", "node_b"], "left_anti")


def read_score_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(node_a, node_b, ranking, score) of old score tables: csv files whose headers may differ in case and name."""
    text = spark.read.text(f"{folder}/*.csv", wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    table = text.select(F.transform(F.split(lines[0], ","), lambda x: F.lower(F.trim(x))).alias("header"), F.explode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
    cells = F.split("line", ",")

    def pick(*names: str):
        at = F.greatest(*[F.coalesce(F.array_position("header", n), F.lit(0)) for n in names], F.lit(0))
        return F.when(at > 0, F.trim(F.get(cells, (at - 1).cast("int"))))

    job = F.split(pick("jobs", "job", "pair"), "_and_")
    return table.select(F.get(job, F.lit(0)).alias("node_a"), F.get(job, F.lit(1)).alias("node_b"), pick("ranking_confidence", "ranking").cast("double").alias("ranking"), pick("iptm", "score", "iptm_score").cast("double").alias("score"))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced as a whole: written beside and renamed over."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(target), overwrite)


def write_json(spark: SparkSession, path: str, summary: dict) -> None:
    put_text(spark, path, json.dumps(summary, indent=1, sort_keys=True))


def append_audit(rows: DataFrame, path: str) -> None:
    """Adds rows to an audit table; what is there stays."""
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_round_package(pairs: DataFrame, sequences: DataFrame, config: dict, path: str) -> None:
    """pairs, sequences (name, sequence) of their ends only, and the configuration of one round."""
    ends = pairs.select(F.explode(F.array("node_a", "node_b")).alias("name")).distinct()
    write_delimited(pairs.select("node_a", "node_b").distinct().coalesce(1), f"{path}/pairs.tsv")
    fasta = sequences.join(ends, "name", "left_semi").select(F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value"))
    fasta.coalesce(1).write.mode("overwrite").text(f"{path}/sequences.fasta")
    write_json(pairs.sparkSession, f"{path}/round_config.json", config)


def html_trace(title: str, sections: list[tuple[str, DataFrame]], rows: int = 200) -> str:
    """A page with the first rows of each table of a round, for reading."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in sections:
        head = "".join(f"<th>{html.escape(c)}" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}" for v in r) for r in df.limit(rows).collect())
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}{body}</table>")
    return "\n".join(out)
