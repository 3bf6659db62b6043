"""Streams of arriving rollouts: running rates per window, and live episode state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.episodes import MAX_TURNS
from ..session import folder_exists, new_folder

OPEN_SECONDS = 3600


def windowed_counts(rollouts: DataFrame, late: str = "1 hour", width: str = "1 day", rollout_id: str | None = None) -> DataFrame:
    """Counts behind pass rate and success lift, per arm and window of ``ts``.

    Counts add up, so every batch only updates a few numbers per open window; a window is
    forgotten once the watermark has passed it. With ``rollout_id`` a rollout that is delivered
    more than once counts once; its id is remembered as long as it could come again, which is
    while the watermark has not passed it.
    """
    won, lost = F.col("reward") == 1.0, F.col("reward") == 0.0
    marked = rollouts.withWatermark("ts", late)
    if rollout_id is not None:
        marked = marked.dropDuplicatesWithinWatermark([rollout_id])
    return (
        marked
        .groupBy(F.window("ts", width), "arm")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(won).alias("n_won"), F.count_if(lost).alias("n_lost"),
            F.count_if(won & F.col("hit")).alias("hits_won"), F.count_if(lost & F.col("hit")).alias("hits_lost"),
        )
        .select(F.col("window.start").alias("start"), "arm", "n", "n_won", "n_lost", "hits_won", "hits_lost")
    )


def lift_of(counts: DataFrame) -> DataFrame:
    """Pass rate and success lift from counts."""
    rate = F.try_divide("hits_won", "n_won") - F.try_divide("hits_lost", "n_lost")
    return counts.select("start", "arm", "n", F.try_divide("n_won", "n").alias("pass_rate"), rate.alias("lift"))


def run_updates(counts: DataFrame, keys: tuple[str, ...] = ("start", "arm")) -> DataFrame:
    """Run an update-mode stream over what has arrived and return the latest row per key.

    Batches are written with their number to the shared folder; a batch that is repeated
    after a failure replaces its own folder, so nothing counts twice.
    """
    spark = counts.sparkSession
    out, checkpoint = new_folder(spark, "updates"), new_folder(spark, "updates-log")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = (
        counts.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    schema = StructType([*counts.schema.fields, StructField("batch", LongType())])
    ran = folder_exists(spark, out)  # no batch runs where nothing has arrived
    rows = spark.read.schema(schema).option("basePath", out).parquet(out) if ran else spark.createDataFrame([], schema)
    values = [c for c in counts.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return latest.select(*keys, "_v.*")


def live_episodes(
    judged: DataFrame, late: str = "1 hour", max_turns: int = MAX_TURNS, open_seconds: int = OPEN_SECONDS
) -> DataFrame:
    """Closed episodes of a stream of judged turns (``episodes.judged_turns``) with ``ts``.

    An episode is a session of its turns: it closes once the watermark is ``open_seconds`` of
    event time past its last turn. Its state is a few built-in aggregates, whatever its length: the
    first ending turn with its reason and reward, the turns seen up to ``max_turns`` as bits, and
    the first marked turn. Turns may come in any order and more than once. Where a turn before the
    ending one has not come by then ``whole`` is false; where none ends, the episode has timed out. A
    turn that comes more than a batch after its episode has closed is dropped as late; Spark holds
    late rows against the watermark of the batch before.
    """
    turn = F.col("turn")
    end = F.when(F.col("ends"), turn)
    bit = F.when(turn.between(1, max_turns), F.expr("shiftleft(1L, turn)")).otherwise(F.lit(0).cast("long"))
    result = F.when(F.col("ends"), F.struct("reason", "reward"))
    sessions = judged.withWatermark("ts", late).groupBy(
        F.session_window("ts", f"{open_seconds} seconds"), "episode_id", "arm"
    ).agg(
        F.min(end).alias("turn"), F.min_by(result, end).alias("_end"), F.bit_or(bit).alias("_seen"),
        F.min(F.when(F.col("hit"), turn)).alias("_first_hit"),
    )
    before = F.expr("shiftleft(1L, turn + 1) - 2")
    whole = F.coalesce((turn <= max_turns) & (F.col("_seen").bitwiseAND(before) == before), F.lit(False))
    hit = F.col("_first_hit").isNotNull() & (turn.isNull() | (F.col("_first_hit") <= turn))
    reason = F.when(whole, F.col("_end.reason")).otherwise(F.coalesce("_end.reason", F.lit("timeout")))
    return sessions.select(
        "episode_id", "arm", "turn", reason.alias("reason"), F.coalesce("_end.reward", F.lit(0.0)).alias("reward"),
        hit.alias("hit"), whole.alias("whole"),
    )


def with_end_of_input(arrived: DataFrame, path: str, after: str = "1000 days") -> None:
    """Add a row to a folder of turns whose event time lies far behind the last, so that a run over what has arrived closes all sessions.

    The row has no episode; its own session stays open.
    """
    last = arrived.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in arrived.schema.fields if f.name != "ts"]
    row = last.select(*blank, (F.col("ts") + F.expr(f"INTERVAL {after}")).alias("ts"))
    row.select(arrived.columns).write.mode("append").parquet(path)


def run_appends(stream: DataFrame) -> DataFrame:
    """Run an append-mode stream over what has arrived; its rows come back as a table."""
    spark = stream.sparkSession
    out, checkpoint = new_folder(spark, "appends"), new_folder(spark, "appends-log")
    run = (
        stream.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    if not folder_exists(spark, out):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder, one file or a folder of parts, as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # Written as a pattern: a plain path would have to be a folder.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.{{parquet}}")
