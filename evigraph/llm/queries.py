"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import chat, codes, decontaminate, funnel, jaccard, langid, lines, mixing, pivots, secrets, sharding, token_store, urls
from evigraph.llm.oracle import ORACLE

TOKENIZER_FILE = "byte_bpe_50k.json"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", sharding.text_size(F.col("text")).alias("size"), F.crc32("text").alias("text_crc32"))
    return sharding.shard(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(langid.to_learn(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_docs(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_docs(spark, sf_dir).select("doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.pairs(_docs(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path(TOKENIZER_FILE)
    stored = token_store.write(_docs(spark, sf_dir), tokenizer)
    return token_store.read(spark, stored, tokenizer)


#: A conversation whose texts hold control strings of the common templates (fixed values).
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("conv_id", "turn", "role", "text")
    probe = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in PROBE])
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*names).unionByName(spark.range(1).select(F.inline(probe)))
    formatted = chat.format_conversations(turns)
    back = chat.read(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: Steps and excluded kinds (fixed values).
FUNNELS = [
    funnel.Funnel("A", ("view", "click", "view", "purchase"), "error"),
    funnel.Funnel("B", ("signup", "view", "click", "purchase"), "error"),
    funnel.Funnel("C", ("click", "click", "purchase", "view"), "signup"),
]


def op12_funnel_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.count(spark.read.parquet(f"{sf_dir}/clicks.parquet").select("client_id", "kind", "ts"), FUNNELS)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_secrets": op5_secrets,
    "op6_url_filters": op6_url_filters,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_token_store": op8_token_store,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_funnel_counting": op12_funnel_counting,
    "op13_vector_codes": op13_vector_codes,
}

__all__ = ["ORACLE", "QUERIES"]
