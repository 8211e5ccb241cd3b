"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are put in doc_id order by a range exchange of (id, size, checksum) only; the text never moves. Each range
partition is summed once, the totals become offsets, and a row's global byte offset is its partition's offset plus a
running sum inside the partition. A row goes to the shard in which its middle byte lies, so every cut is at most half a
row away from the equal target.

Defined cases: null text has size 1 and the checksum of the empty string; null ids sort first; repeated rows are kept,
each with a slot of its own; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import shuffle_partitions, stored, table


def with_prefix_sums(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add global `bytes_before` and `rows_before` of each row in the given order. rows: only narrow columns."""
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = stored(
        rows.repartitionByRange(shuffle_partitions(spark), *keys).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    # one row for each range partition: their number is the number of shuffle partitions, not that of the rows
    totals = dealt.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
    )
    inside = Window.partitionBy("_part").orderBy(*keys)
    return (
        dealt.withColumn("_run", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn("bytes_before", F.col("_bytes0") + F.col("_run") - F.col(size))
        .withColumn("rows_before", F.col("_rows0") + F.col("_row") - 1)
        .drop("_part", "_run", "_row", "_bytes0", "_rows0")
    )


def byte_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): contiguous shards in id order, slots gapless from 0."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = with_prefix_sums(rows, ["doc_id", "text_crc32", "size"], "size")
    total = placed.agg(F.sum("size").alias("_total"))
    cut = placed.join(F.broadcast(total)).withColumn(
        "shard",
        F.least(F.lit(n_shards - 1), F.expr(f"({n_shards} * (2 * bytes_before + size)) div (2 * _total)")).cast("int"),
    )
    first = cut.groupBy("shard").agg(F.min("rows_before").alias("_first"))
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rows_before") - F.col("_first")).alias("slot")
    )


def op2_query(spark, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
