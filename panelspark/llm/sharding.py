"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the records uniformly into buckets by a seeded hash; the number of buckets follows from the summed
record sizes, so a bucket fits in a task's memory.  Pass 2 puts each bucket in one order and shuffles it
(``shuffle`` is a Fisher-Yates shuffle with a seeded generator).  The buckets one after another are a random
permutation of all records, which is cut into shards of equal counts: the law is ``rows``.

The order is the same whenever a task is run again: a bucket's records are sorted before the seeded shuffle, and the
generator's start is fixed by the partition, whose buckets are sorted.  Equal records (all columns equal) may be a
third of the input: they are counted in partial aggregates and each copy gets a number, which takes part in the hash, so
the copies spread over all buckets.

The records that are scattered, shuffled and written are whole; the digest rows are read from the written shards.

Defined cases: a null text has size 1 and the CRC of the empty text; null ids and repeated rows are records like
others; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import checkpoint_dir

#: Bytes that one bucket may hold in a task, and the share of a task's memory that a record costs besides its columns.
BUCKET_BYTES = 64 << 20
ROW_BYTES = 96
SEED = 20240511


def two_pass_shuffle(records: DataFrame, shards: int, size: str, seed: int = SEED,
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All records with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard), in random order.

    ``size`` names a column with the bytes that a record holds.  Columns of the records that are called shard or slot
    are kept in the record and replaced in the result.
    """
    columns = [c for c in records.columns if c not in ("shard", "slot")]
    record = F.struct(*[F.col(f"`{c}`") for c in columns])
    counted = records.groupBy(record.alias("record")).agg(F.count(F.lit(1)).alias("copies"))
    total = records.agg(F.count(F.lit(1)).alias("n"),
                        F.sum(F.coalesce(F.col(size), F.lit(0)) + ROW_BYTES).alias("bytes")).first()
    buckets = max(1, -(-int(total["bytes"] or 0) // bucket_bytes))
    copies = counted.select("record", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    place = F.pmod(F.xxhash64(F.lit(seed), "record", "copy"), F.lit(buckets))
    scattered = copies.select(place.alias("bucket"), F.struct("copy", "record").alias("item"))
    held = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    mixed = held.sortWithinPartitions("bucket").select(
        "bucket", F.expr(f"shuffle(items, {int(seed)}L)").alias("items"))
    # one small row for each bucket; where its records begin in the permutation
    begins = (scattered.groupBy("bucket").count()
              .select(F.col("bucket").alias("at"),
                      (F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
                       - F.col("count")).alias("begin")))
    n, k = int(total["n"]), int(shards)
    rank = F.col("begin") + F.col("pos")
    shard = F.floor(rank * k / F.lit(max(n, 1))) if n * k < 1 << 52 else F.expr(f"(begin + pos) * {k} div {max(n, 1)}")
    flat = (mixed.join(begins, F.col("bucket") == F.col("at"))
            .select("begin", F.posexplode("items").alias("pos", "item"))
            .select(rank.alias("rank"), shard.cast("int").alias("shard"), F.col("item.record").alias("record")))
    first = F.expr(f"(cast(shard AS BIGINT) * {n} + {k - 1}) div {k}")
    return flat.select("record.*", "shard", (F.col("rank") - first).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = SEED,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The digest rows of all documents in their shards, from the shards that are written to the shared folder."""
    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/shards-{uuid.uuid4().hex}"
    out = write_shards(docs, folder, shards, seed, bucket_bytes)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
                      F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = SEED,
                 bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The whole records, in shard folders below ``path`` and in slot order inside each file; read from there."""
    sized = docs.withColumn("__held", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long"))
    out = two_pass_shuffle(sized, shards, "__held", seed, bucket_bytes).drop("__held")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path, compression="zstd")
    return docs.sparkSession.read.schema(out.schema).parquet(path)
