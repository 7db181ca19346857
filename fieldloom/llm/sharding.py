"""Contiguous shards of equal size from global prefix sums.

1. Rows (without their texts) are range-partitioned by key; each partition sums its own sizes as it
   streams through its sorted rows and numbers them. The result is written to the shared folder.
2. The totals of the partitions (one row each) are summed up in order: the offset of every partition.
3. offset + local sum is the global prefix; the middle of a row, times the number of shards over the
   total, is its shard. Cuts thus lie within half a row of equal targets and shards are contiguous.

No task holds more than its range, and only the partitions' totals are gathered. Range bounds that
differ between runs change neither prefix nor shard: both depend on the order of keys alone.

Defined cases: a null text has no bytes (size 1); null keys come first; equal keys are ordered by size
and checksum, so rows that tie are alike; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import materialise


def prefix_sums(sized: DataFrame, order: list[str], size: str, name: str = "prefix") -> tuple[DataFrame, int, int]:
    """sized with global `row_index` and `row_start` (exclusive prefix of size) in the given order.

    Returns the table, the number of rows and the total size. Nulls come first.
    """
    schema = sized.select(*order, *[c for c in sized.columns if c not in order])
    fields = [(f.name, f.dataType.simpleString()) for f in schema.schema.fields]
    ddl = ", ".join(f"`{n}` {t}" for n, t in fields) + ", part bigint, local_index bigint, local_start bigint"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            sizes = b.column(size).cast(pa.int64())
            sums = pc.cumulative_sum(sizes)
            starts = pc.add(pc.subtract(sums, sizes), pa.scalar(total, pa.int64()))
            index = pa.array(range(rows, rows + b.num_rows), pa.int64())
            own = pa.array([part] * b.num_rows, pa.int64())
            rows, total = rows + b.num_rows, total + sums[-1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, own, index, starts], [*b.schema.names, "part", "local_index", "local_start"])

    keys = [F.col(c).asc_nulls_first() for c in order]
    summed = materialise(schema.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(local, ddl), name)
    totals = summed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("s")).collect()  # one row for each partition
    at_row = at_size = 0
    offsets = []
    for t in sorted(totals, key=lambda r: r.part):
        offsets.append((t.part, at_row, at_size))
        at_row, at_size = at_row + t.n, at_size + t.s
    offs = sized.sparkSession.createDataFrame(offsets, "part bigint, part_row bigint, part_start bigint")
    out = summed.join(F.broadcast(offs), "part").select(
        *[c for c, _ in fields], (F.col("part_row") + F.col("local_index")).alias("row_index"), (F.col("part_start") + F.col("local_start")).alias("row_start")
    )
    return out, at_row, at_size


def shard_by_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    bytes_ = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    sized = docs.select(F.col(key), (bytes_ + 1).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    rows, _, total = prefix_sums(sized, [key, "size", "text_crc32"], "size", "shards")
    middle = (F.col("row_start") * 2 + F.col("size")).cast("decimal(38,0)")
    placed = rows.withColumn("shard", F.least(F.floor(middle * shards / F.lit(max(2 * total, 1))).cast("int"), F.lit(shards - 1)))
    first = placed.groupBy("shard").agg(F.min("row_index").alias("shard_row"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row_index") - F.col("shard_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
