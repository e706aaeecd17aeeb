"""Review state as a stream: rounds come in, each batch leaves its run totals, reads add them up.

The fold is associative, so a batch needs no state of earlier ones, and a round may come in however late. Totals of
earlier batches are merged level by level, so a read touches a number of parts that grows with the logarithm of the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopy.functions.times import utc_day
from canopy.operators.review import fold_runs, run_totals
from canopy.streaming.parts import Kind, Parts

RUN_SCHEMA = (
    "plan_slug string, run string, rounds bigint, worst int, last struct<ts:timestamp,seq:bigint,model:string>"
)


def _added_up(totals: DataFrame) -> DataFrame:
    return totals.groupBy("plan_slug", "run").agg(
        F.sum("rounds").alias("rounds"), F.max("worst").alias("worst"), F.max("last").alias("last")
    )


def run_parts(spark: SparkSession, root: str) -> Parts:
    """The partial run totals under ``root``."""
    return Parts(spark, root, {"totals": Kind(RUN_SCHEMA, lambda rows, _: _added_up(rows))})


def start_fold(rounds: DataFrame, root: str) -> StreamingQuery:
    """Take a stream of rounds (plan_slug, model, verdict, ts, seq) into partial run totals under ``root``.

    ``ts`` is an instant and a run is one UTC day. A batch counts once, however often it is replayed.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        days = batch.withColumn("run", utc_day(F.col("ts")))
        run_parts(batch.sparkSession, root).publish(batch_id, {"totals": run_totals(days)})

    return (
        rounds.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )


def current_states(spark: SparkSession, root: str) -> DataFrame:
    """Review state per plan from the partial totals of all batches; empty before the first one."""
    return fold_runs(_added_up(run_parts(spark, root).read("totals")))
