"""Batched progressive retraining: each batch of labelled plans updates the model that is then judged on the next batch.

The first batch may be a few queries only. Batches come one after the other by number; each is a DataFrame of its own, so
what has been labelled so far may live in files that arrive over time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.ranker import evaluate, train
from quarry.sources.files import append_latency


def progressive(batches: Iterable[DataFrame], epochs: int = 20, kind: str = "pairwise", retrain: bool = True) -> list[tuple[int, float]]:
    """(batch, total latency of the plans chosen on it) for every batch after the first. retrain: start anew on all so far, else go on from the last model."""
    seen, model, out = None, None, []
    for k, plans in enumerate(batches):
        if model is not None:
            out.append((k, float(evaluate(plans, model)["total"].first()["total"])))
        seen = plans if seen is None else seen.unionByName(plans)
        model = train(seen, kind, epochs) if retrain or model is None else train(plans, kind, epochs, start=model)
        model = plans.sparkSession.createDataFrame(model.collect(), model.schema)  # one row
    return out


def follow(
    spark: SparkSession, source: str, checkpoint: str, sink: str, schema: str = "query_id long, cand_id int, plan_json string", models: str | None = None, epochs: int = 20, kind: str = "pairwise"
) -> None:
    """Structured-streaming form: plan files that arrive in `source` are one batch after the other, each kept in `sink` exactly once.

    With `models`, each batch's plans are chosen by the last model, their total latency joins the series in `models`/latency, and
    a model is trained on all plans so far. A batch that is done again after a failure replaces what it left."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if models is None:
            return
        plans = spark.read.schema(batch.schema).parquet(f"{sink}/batch={number}")
        if number:
            append_latency(spark, f"{models}/latency", number, float(evaluate(plans, spark.read.parquet(f"{models}/model-{number - 1}"))["total"].first()["total"]))
        train(spark.read.parquet(sink).where(f"batch <= {number}").drop("batch"), kind, epochs).write.mode("overwrite").parquet(f"{models}/model-{number}")

    stream = spark.readStream.schema(schema).json(source)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
