"""Readers and writers. Schemas are declared, so no file is read just to infer one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.messages import RAW_MESSAGES
from ..operators.records import require_columns

# Fields of a raw trace, a probe battery, a log-prob battery, a training log.
TRACE = (
    "task_id string, task_key string, env_key string, data_key string, modality string,"
    " session_id string, verifier_execution_id string, env_variables string, model string,"
    " reward struct<success: boolean, score: variant, result: struct<result: variant>>,"
    f" messages {RAW_MESSAGES}"
)
CHAT = "task_key string, score double, source string, messages array<struct<role: string, content: string>>"
BATTERY = (
    "models map<string, struct<per_prompt: array<struct<prompt: string, func: string,"
    " samples: array<struct<text: string, pass_rate: double, errors: array<string>>>>>>>"
)
LOGPROBS = (
    "models map<string, struct<continuation: string, per_prefix: array<struct<prefix: string,"
    " logp_bug: double, n_tokens: int, avg_logp_per_token: double>>>>"
)
TRAINING_LOG = (
    "log_history array<struct<epoch: double, step: bigint, loss: double, grad_norm: double,"
    " learning_rate: double, eval_loss: double, eval_runtime: double>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str = CHAT) -> DataFrame:
    """One record per line; blank lines are skipped, a line that is no JSON is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_traces(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Items of the ``traces`` array. A file that is one document cannot be split, so large
    inputs are read once and rewritten with ``rewrite_traces``."""
    documents = spark.read.schema(f"traces array<struct<{_as_struct(TRACE)}>>").json(
        path, multiLine=one_document, mode="FAILFAST"
    )
    return documents.select(F.inline("traces"))


def rewrite_traces(spark: SparkSession, path: str, out: str, one_document: bool = True) -> DataFrame:
    """Write the traces once as Parquet, which can be split, and read them from there.

    Each document is parsed in one task of its own, as its form demands; its traces are then
    spread by a hash of their content before they are written, in parts of the size that
    adaptive execution aims at.
    """
    traces = read_traces(spark, path, one_document)
    spread = [F.xxhash64("task_id", "session_id", F.to_json(F.struct("messages")))]
    write_parquet(traces.repartition(*spread), out)
    return spark.read.schema(traces.schema).parquet(out)


def _as_struct(schema: str) -> str:
    """Column list to struct fields: a colon after each top-level name."""
    out, depth, start = [], 0, True
    for part in schema.split(", "):
        if depth == 0:
            name, kind = part.strip().split(" ", 1)
            part = f"{name}: {kind}"
        depth += part.count("<") - part.count(">")
        out.append(part)
    return ", ".join(out)


def read_parquet(spark: SparkSession, path: str, required: Sequence[str] = ("prompt",)) -> DataFrame:
    """Parquet table that has to have the required columns."""
    return require_columns(spark.read.parquet(path), required)


def write_jsonl(df: DataFrame, path: str, parts: Sequence[str] = ("arm", "split")) -> None:
    """JSON lines in one folder per arm and split; text is written as it is, in UTF-8."""
    df.write.mode("errorifexists").partitionBy(*parts).json(path)


def write_parquet(df: DataFrame, path: str, parts: Sequence[str] = ()) -> None:
    df.write.mode("errorifexists").partitionBy(*parts).parquet(path)


def write_manifest(row: DataFrame, path: str) -> None:
    """The single manifest row as one JSON file."""
    row.coalesce(1).write.mode("errorifexists").json(path)


def battery_samples(batteries: DataFrame) -> DataFrame:
    """One row per sample of nested results: arm, prompt, func, i, text, pass_rate, errors."""
    models = batteries.select(F.explode("models").alias("arm", "m"))
    prompts = models.select("arm", F.explode("m.per_prompt").alias("p"))
    return prompts.select("arm", "p.prompt", "p.func", F.posexplode("p.samples").alias("i", "s")).select(
        "arm", "prompt", "func", "i", "s.*"
    )


def logprob_rows(batteries: DataFrame) -> DataFrame:
    """One row per model and prefix: arm, prefix, logp, n_tokens."""
    models = batteries.select(F.explode("models").alias("arm", "m"))
    return models.select("arm", F.explode("m.per_prefix").alias("p")).select(
        "arm", "p.prefix", F.col("p.logp_bug").alias("logp"), "p.n_tokens"
    )


def log_rows(logs: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """Loss rows and evaluation rows of training logs; both kinds may share a step."""
    rows = logs.select(run, F.explode("log_history").alias("r")).select(run, "r.*")
    loss = rows.where(F.col("loss").isNotNull()).select(run, "epoch", "step", "loss", "grad_norm", "learning_rate")
    evals = rows.where(F.col("eval_loss").isNotNull()).select(run, "epoch", "step", "eval_loss", "eval_runtime")
    return loss, evals


def step_of_file(prefix: str = "step_") -> Column:
    """The step in the path of the file that a row comes from. A filter on it is decided before any file is opened."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"{prefix}([0-9]+)[^0-9]", 1).try_cast("bigint")


def read_steps(spark: SparkSession, path: str, schema: str, prefix: str = "step_") -> DataFrame:
    """Trajectory files with the step taken from the file or folder name; a broken line is an error.

    Rows filtered on ``step`` come from the files of these steps; no other file is read.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("step", step_of_file(prefix))


def step_listing(spark: SparkSession, path: str, prefix: str = "step_", run: str = "/([^/]+)/") -> DataFrame:
    """(run, step, path, length) of the files below a path, from their names; their contents are not read.

    ``run`` is the pattern of what stands before the step's part of the path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.select(
        F.regexp_extract("path", rf"{run}{prefix}[0-9]", 1).alias("run"),
        F.regexp_extract("path", rf"{prefix}([0-9]+)[^0-9]", 1).try_cast("bigint").alias("step"), "path", "length",
    ).where(F.col("step").isNotNull())
