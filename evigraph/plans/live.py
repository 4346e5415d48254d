"""Search rounds that wait for scores, as streams over files that Spark makes from the shop's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.plans.catalog import Tables, query, rounded
from evigraph.sources.state import state_dir
from evigraph.streaming import probe

WIDTH = 5
ROUNDS = f"""it AS (SELECT item_id, brand, kind, size, price FROM items WHERE brand IS NOT NULL AND kind IS NOT NULL AND price IS NOT NULL AND size IS NOT NULL),
rq AS (SELECT substr(brand, 2)::BIGINT AS round, size::BIGINT AS path_id, item_id::VARCHAR AS candidate, least(brand, kind) AS node_a, greatest(brand, kind) AS node_b, brand, kind, price / (price + 100) AS cheap, price > 400 AS receptor FROM it),
sc AS (SELECT brand, kind, count(*) FILTER (WHERE flag = 'kept')::DOUBLE / count(*) AS score FROM sale_lines JOIN it USING (item_id) WHERE kind <> 'office' GROUP BY 1, 2),
j AS (SELECT rq.*, score, least(greatest(score, 1e-6), 1 - 1e-6) AS s FROM rq LEFT JOIN sc USING (brand, kind)),
p AS (SELECT *, CASE WHEN score IS NULL THEN cheap ELSE 1 / (1 + exp(-(ln(cheap / (1 - cheap)) + ln(least(greatest(s / (1 - s) / 1.5, 0.1), 10.0))))) END AS posterior FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY receptor, posterior DESC, path_id, candidate) AS place FROM p)"""


@query(
    "live_rounds",
    f"WITH {ROUNDS} SELECT round, path_id, candidate, node_a, node_b, round(posterior, 6) AS posterior, round(score, 6) AS score, place::INT AS place, CASE WHEN receptor THEN 'receptor reached' WHEN place <= {WIDTH} THEN 'in the beam' ELSE 'below the beam' END AS decision FROM r",
)
def live_rounds(t: Tables) -> DataFrame:
    """Requests first, scores in a second run that goes on from the checkpoint, and time enough for those that get none."""
    spark, root = t.spark, f"{state_dir(t.spark)}/live-{uuid.uuid4().hex}"
    items = t.items.where("brand IS NOT NULL AND kind IS NOT NULL AND price IS NOT NULL AND size IS NOT NULL").select("item_id", "brand", "kind", "size", "price")
    sizes = items.groupBy("brand").agg(F.count(F.lit(1)).alias("expected"))
    zero = F.timestamp_seconds(F.lit(1_700_000_000))
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    requests = items.join(sizes, "brand").select(
        F.substring("brand", 2, 9).cast("long").alias("round"), "expected", F.col("size").cast("long").alias("path_id"), F.col("item_id").cast("string").alias("candidate"),
        F.col("brand").alias("node_a"), F.col("kind").alias("node_b"), (F.col("price") / (F.col("price") + 100)).alias("cheap"), (F.col("price") > 400).alias("receptor"),
        F.lit("request").alias("kind"), nothing("double", "score"), zero.alias("at"),
    )
    scored = t.sale_lines.join(items.where("kind <> 'office'"), "item_id").groupBy("brand", "kind").agg((F.count_if(F.col("flag") == "kept") / F.count(F.lit(1))).alias("score"))
    scores = scored.select(
        nothing("long", "round"), nothing("long", "expected"), nothing("long", "path_id"), nothing("string", "candidate"), F.col("kind").alias("node_a"), F.col("brand").alias("node_b"),
        nothing("double", "cheap"), nothing("boolean", "receptor"), F.lit("score").alias("kind"), "score", (zero + F.expr("INTERVAL 1 HOUR")).alias("at"),
    )
    later = lambda days: scores.limit(1).withColumn("at", zero + F.expr(f"INTERVAL {days} DAYS"))  # noqa: E731  a repeated score moves the time on
    for rows in (requests, scores, later(5), later(6)):
        rows.write.mode("append").parquet(f"{root}/events")
        probe.resolve(probe.events(spark, f"{root}/events"), f"{root}/resolved", f"{root}/c1").awaitTermination()
    probe.decide(spark, f"{root}/resolved", f"{root}/decided", f"{root}/c2", width=WIDTH).awaitTermination()
    return rounded(spark.read.schema(probe.DECIDED).parquet(f"{root}/decided"))
