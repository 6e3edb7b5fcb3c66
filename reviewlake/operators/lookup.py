"""Tables that are looked up by key: sorted by it, with Parquet Bloom filters, so that a few keys cost a few row groups.

A keyed table is range-partitioned and sorted by its key, so that the statistics of files, row groups and pages are narrow, and every row group
holds a Bloom filter of the key, which tells apart keys that only lie between others. A look-up of up to ``FEW`` keys is a filter of equalities that the
scan applies before it reads a row group; of more keys, a join, with the keys broadcast where they are few enough to be.

Defined results: a null key is looked up by nothing; keys that stand twice in the table give all their rows, keys that are asked for twice give them
once; a key of another type is cast to the table's; an empty table and no keys give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 100
BROADCAST_KEYS = 100_000
ROW_GROUP = 8 << 20


def write_keyed(df: DataFrame, path: str, key: str, row_group: int = ROW_GROUP) -> None:
    """Write ``df`` as a keyed table. Rows with a null key are kept, first."""
    ordered = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    options = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.block.size": str(row_group)}
    ordered.write.mode("overwrite").options(**options).parquet(path)


def look_up(spark: SparkSession, path: str, key: str, keys: DataFrame) -> DataFrame:
    """The rows of the keyed table at ``path`` whose key is in the column ``key`` of ``keys``."""
    table = spark.read.parquet(path)
    kind = table.schema[key].dataType
    wanted = keys.select(F.col(key).try_cast(kind).alias(key)).where(F.col(key).isNotNull()).distinct()
    first = [r[0] for r in wanted.limit(FEW + 1).collect()]
    if not first:
        return table.limit(0)
    if len(first) <= FEW:
        return table.where(reduce(lambda a, b: a | b, [F.col(key) == F.lit(value).cast(kind) for value in sorted(first)]))
    many = wanted.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS
    return table.join(wanted if many else F.broadcast(wanted), key, "left_semi")
