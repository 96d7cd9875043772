"""Pages deep inside an order, without sorting what stands before them.

The rows are laid out once in ranges of the order, a folder for each, and the rows of each range are counted. The counts tell which ranges
hold an offset, so a page reads those and nothing else, however deep it lies; only their rows are sorted.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tables import shared_folder


@dataclass(frozen=True)
class Ranges:
    """A table in ranges of a total order; range i holds the rows from ``starts[i]`` to ``starts[i + 1]``, the last number counts all."""

    rows: DataFrame
    order: tuple[Column | str, ...]
    starts: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def page(self, limit: int = 50, offset: int = 0, most: int = 500) -> DataFrame:
        """Rows offset+1 to offset+limit, in order; none past the end."""
        if not 1 <= limit <= most or offset < 0:
            raise ValueError(f"limit must be 1 to {most} and offset 0 or more")
        first = bisect_right(self.starts, offset) - 1
        last = bisect_right(self.starts, min(offset + limit, self.total) - 1) - 1
        held = self.rows.filter(F.col("_range").between(first, last) if offset < self.total else F.lit(False))
        begins = F.create_map(*[F.lit(x) for r in range(first, last + 1) for x in (r, self.starts[r])]) if last >= first else F.create_map(F.lit(0), F.lit(0))
        place = F.row_number().over(Window.partitionBy("_range").orderBy(*self.order)) - 1 + begins[F.col("_range")]
        return held.withColumn("_place", place).filter((F.col("_place") >= offset) & (F.col("_place") < offset + limit)).orderBy("_place").drop("_range", "_place")


def in_ranges(df: DataFrame, order: Sequence[Column | str], ranges: int | None = None) -> Ranges:
    """``df`` in ``ranges`` ranges of ``order``, written once; the driver keeps one number for each.

    ``order`` must be total: rows equal in all of it are in no stated order. Nulls come first ascending and last descending. As it is
    total, a value that many rows share in its first column is cut into ranges like any other.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(df.sparkSession)}/ranges/{uuid.uuid4().hex}"
    laid = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    laid.write.option("compression", "zstd").partitionBy("_range").parquet(path)
    rows = df.sparkSession.read.schema(laid.schema).parquet(path)
    counts = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}  # a row per range
    return Ranges(rows, tuple(order), tuple(accumulate((counts.get(r, 0) for r in range(n)), initial=0)))
