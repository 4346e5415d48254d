"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's documents.  All stages work on
everything the one before kept, and all but the last return the columns of
documents; extra columns are carried along.  Empty tables go through.

1. language: goes if no language is found (no letters, or noise almost
   surely); the network learns from this stage's own labelled rows.
2. near_duplicates: of each group of linked documents the row with the least id
   stays (null ids last; of equal ids the one whose text has the least digest);
   rows with the same id and text count once.  Documents without words stay.
3. decontamination: documents that hold a benchmark item go.
4. mix: rows come as often as the mix begins them; sources over their target lose
   rows, sources under it repeat theirs.
5. shard: adds row_number, shard and slot.

Null text: is in no language and goes with the first stage; the others, on their
own, keep it (mix as a document of no size, which comes at most once an epoch).
Null ids, sources and languages are values like others; null sources mix as one
source.  Very long texts are read, compared, aligned and kept whole.  Ties: rows
equal in id and text are one document to near_duplicates, with the least source;
the mix and the shards order equal rows by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.llm import decontaminate, jaccard, langid, mixing, sharding
from evigraph.llm.common import carried, materialize, own_names, word_count

SHARDS = 40
#: From here on a text is in no language, however many there are; short clean texts stay well below.
MOST_NOISE = 0.95


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(langid.to_learn(F.col("doc_id"))).select("doc_id", "text", "lang"))
    # whole rows in one column: none of theirs is replaced
    rows = docs.select(F.struct(*carried(docs)).alias("row"))
    guessed = langid.predict(rows, model, text="row.text")
    return guessed.where((F.col("lang_pred") != "und") & (F.col("noise") < MOST_NOISE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    digest = F.md5("text")
    linked = jaccard.link(docs.select("doc_id", "text", digest.alias("digest")), carry=("digest",))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    first = linked.where("n_shingles > 0").groupBy("root").agg(F.min(rank).alias("first")).select("first.doc_id", "first.digest")
    stay = first.unionByName(linked.where("n_shingles = 0").select("doc_id", "digest").distinct())
    # one row of each id and text: of equal ones that with the least source and language
    own, key, text, copy = own_names(docs, "row_digest", "key", "text_digest", "copy")
    stay = stay.select(F.col("doc_id").alias(key), F.col("digest").alias(text))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col(own).eqNullSafe(F.col(text))
    kept = docs.withColumn(own, digest).join(stay, same, "left_semi")
    once = Window.partitionBy("doc_id", own).orderBy("source", "lang", "n_chars")
    return kept.withColumn(copy, F.row_number().over(once)).where(F.col(copy) == 1).select(*carried(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("text", F.struct(*carried(docs)).alias("row"))
    return decontaminate.clean(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # whole rows in one column: none of theirs can clash with the mix's
    rows = docs.select(F.struct(*carried(docs)).alias("row"))
    mixed = mixing.mix(rows, size=word_count(F.col("row.text")), key="row.doc_id", source="row.source", text="row.text")
    return mixing.repeat_rows(mixed, ["row"]).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("shard", shard),
]
#: The network and the alignment can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
