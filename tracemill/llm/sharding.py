"""Shuffled shards by a two-pass external shuffle, in DataFrame functions.

Pass 1 scatters records uniformly into buckets by a seeded hash; there are as many buckets as it
takes for one to fit in memory. Pass 2 puts each bucket in order, shuffles it with Spark's
``shuffle`` (a seeded Fisher-Yates shuffle of an array) and writes it. The place of a record is the
number of records in earlier buckets plus its place in its own, and the shards are equal runs of
places, so their counts differ by one at most.

Equal records that would fill a good part of a bucket are counted and numbered in chunks, and their
numbers are hashed too, so they spread over the buckets. Every other record goes over the network once. The seed, the records and the partitions of the session
define the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.session import new_folder, written

#: Equal records of more than this part of a bucket's bytes are spread.
HOT_PART = 8
#: Bytes of a bucket, and bytes that a record counts besides its text.
BUCKET_BYTES, RECORD_BYTES = 8_000_000, 8


def write_shards(
    docs: DataFrame, shards: int = 24, seed: int = 42, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text",
    folder: str | None = None,
) -> str:
    """Write (doc_id, text, size, slot) in folders shard=0 ... and return the folder that holds them.

    Defined cases: a null text counts no bytes and stays null; null ids are allowed; repeated rows
    are records of their own and, if they are many, spread over the buckets; with fewer records than shards some shards are
    empty; an empty table gives an empty folder. Columns besides id and text are left out.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + RECORD_BYTES
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    bucket = lambda *x: F.pmod(F.xxhash64(F.lit(seed), *x), F.lit(buckets)).cast("int").alias("bucket")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), size.alias("size"))
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    # At most HOT_PART times as many keys as buckets are hot.
    hot = keyed.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > bucket_bytes // HOT_PART) & (F.col("n") > 1))
    hot = written(hot.select("key"), "hot")
    rows = keyed.join(F.broadcast(hot), "key", "left_anti").select(bucket("doc_id", "text"), "doc_id", "text", "size")
    if hot.count():
        equal = keyed.join(F.broadcast(hot), "key", "left_semi").groupBy("doc_id", "text", "size").agg(F.count("*").alias("n"))
        chunk = F.greatest(F.lit(1), F.floor(F.lit(bucket_bytes) / F.col("size"))).cast("long")  # records that one task makes of one row
        chunks = equal.withColumn("chunk", chunk).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("chunk"))))
        chunks = chunks.repartition("doc_id", "text", "first")
        numbers = F.sequence("first", F.least(F.col("first") + F.col("chunk"), F.col("n")) - 1)
        spread = chunks.withColumn("number", F.explode(numbers)).select(bucket("doc_id", "text", "number"), "doc_id", "text", "size")
        rows = rows.unionByName(spread)

    # One row per bucket: how many records lie in earlier ones. Buckets are summed up in runs, so no task sees all of them.
    counts = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("bucket") / 1024)), "buckets")
    earlier = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(earlier(Window.orderBy("run"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("run").orderBy("bucket"))), F.lit(0))
    begins = counts.withColumn("inside", inside).join(runs, "run").select("bucket", (F.col("base") + F.col("inside")).alias("begin"))
    records = counts.agg(F.sum("n")).first()[0] or 0

    held = rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text", "size"))).alias("records"))
    mixed = held.join(begins, "bucket").sortWithinPartitions("bucket").select("begin", F.shuffle("records", seed).alias("records"))
    placed = mixed.select("begin", F.posexplode("records").alias("at", "x"))
    place = F.col("begin") + F.col("at")
    shard = F.floor(place * shards / F.lit(max(records, 1))).cast("int")
    # The first place of shard s is the least p with floor(p * shards / records) = s.
    first = F.ceil(F.col("shard").cast("long") * F.lit(records) / F.lit(shards)).cast("long")
    placed = placed.select("x.doc_id", "x.text", "x.size", place.alias("place"), shard.alias("shard"))
    placed.select("doc_id", "text", "size", (F.col("place") - first).alias("slot"), "shard").write.partitionBy("shard").parquet(folder)
    return folder


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, size, slot, shard) of all shards."""
    return spark.read.schema("doc_id long, text string, size long, slot long, shard int").parquet(folder)


def digests(records: DataFrame) -> DataFrame:
    """Where each record lies, with the checksum of its text (0 for none)."""
    return records.select(
        "doc_id", "size", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
