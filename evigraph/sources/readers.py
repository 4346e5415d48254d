"""Readers for the formats that evidence comes in, and the sinks that go with them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """csv or tsv by name, plain or gzip; everything is text and missing is empty unless a schema is given."""
    sep = "," if path.removesuffix(".gz").endswith(".csv") else "\t"
    reader = spark.read.option("header", True).option("sep", sep)
    if schema:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", False).option("nullValue", "\u0000").csv(path).na.fill("")


def read_matrix(spark: SparkSession, path: str, symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Labelled square table -> (row, col, value) for known symbols; zeros are left out."""
    wide = read_delimited(spark, path)
    first, *rest = wide.columns
    long = wide.unpivot([first], rest, "col", "value").select(F.col(first).alias("row"), "col", F.expr("try_cast(value AS double)").alias("value"))
    known = symbols.select(symbol)
    return long.where("value != 0").join(known.withColumnRenamed(symbol, "row"), "row", "left_semi").join(known.withColumnRenamed(symbol, "col"), "col", "left_semi")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, accession, sequence)."""
    blocks = spark.read.text(path, lineSep=">").where("trim(value) != ''")
    header = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    sequence = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    parts = F.split(F.element_at(F.split(header, r"\s+"), 1), r"\|")
    return blocks.select(header.alias("header"), F.when(F.size(parts) >= 2, parts[1]).otherwise(parts[0]).alias("accession"), sequence.alias("sequence"))


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms (id, name, namespace, obsolete) and edges (child, parent, relation: is_a, part_of)."""
    stanza = spark.read.text(path, lineSep="\n[").where(F.col("value").rlike(r"^\[?Term\]"))
    one = lambda tag: F.regexp_extract("value", rf"(?m)^{tag}: ([^\r\n]*)", 1)
    terms = stanza.select(one("id").alias("id"), one("name").alias("name"), one("namespace").alias("namespace"), (one("is_obsolete") == "true").alias("obsolete"), "value")
    is_a = terms.select(F.col("id").alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1))).alias("parent"), F.lit("is_a").alias("relation"))
    part = terms.select(F.col("id").alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^relationship: part_of (\S+)"), F.lit(1))).alias("parent"), F.lit("part_of").alias("relation"))
    return terms.drop("value"), is_a.unionByName(part)


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Annotations (symbol, qualifier, term, evidence); NOT and ND rows are dropped."""
    rows = spark.read.option("sep", "\t").option("comment", "!").csv(path)
    named = rows.select(F.col("_c2").alias("symbol"), F.col("_c3").alias("qualifier"), F.col("_c4").alias("term"), F.col("_c6").alias("evidence"))
    return named.where(~F.coalesce("qualifier", F.lit("")).contains("NOT") & (F.col("evidence") != "ND"))


def read_pairs_headerless(spark: SparkSession, path: str) -> DataFrame:
    """Two tab-separated Ensembl ids a line, version dropped, header or not; different unordered pairs."""
    rows = spark.read.option("sep", "\t").csv(path)
    ident = lambda c: F.regexp_extract(F.trim(c), r"^(ENS[A-Z]*\d+)", 1)
    got = rows.select(ident("_c0").alias("a"), ident("_c1").alias("b")).where("a != '' AND b != '' AND a != b")
    return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def read_json_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_zip_member(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(file, line_no, line) of the members with this suffix, streamed line by line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if member.endswith(suffix):
                            rows, first = [], 0
                            for line in io.TextIOWrapper(z.open(member), "utf-8", "replace"):
                                rows.append(line.rstrip("\r\n"))
                                if len(rows) == 10_000:
                                    yield pd.DataFrame({"file": member, "line_no": range(first, first + len(rows)), "line": rows})
                                    first, rows = first + len(rows), []
                            if rows:
                                yield pd.DataFrame({"file": member, "line_no": range(first, first + len(rows)), "line": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, line_no long, line string")


def read_workbook(path: str, sheet: str | int = 0) -> pd.DataFrame:
    """A spreadsheet on the driver, where openpyxl is installed."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading spreadsheets needs openpyxl") from e
    return pd.read_excel(path, sheet_name=sheet)


def write_delimited(df: DataFrame, path: str, digits: int = 9, gzip: bool = False) -> None:
    """Tab-separated, numbers with so many significant digits."""
    shown = [F.format_string(f"%.{digits}g", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    writer = df.select(*shown).write.mode("overwrite").option("sep", "\t").option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_fasta(df: DataFrame, path: str, name: str = "name", sequence: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


def signature(df: DataFrame) -> DataFrame:
    """SHA-256 over path, size and modification time of the files a DataFrame reads."""
    meta = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    one = F.concat_ws("|", "file_path", F.col("file_size").cast("string"), F.col("file_modification_time").cast("string"))
    return meta.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256).alias("signature"))
