"""Shared helpers: input columns, intermediate tables, ASCII case folding."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Java and Python regex class of the characters between words in several contracts.
BLANKS = r"\x20\x09-\x0D"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()``, in a compressed columnar form: later
    readers prune columns and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


#: Rows of an Arrow batch: whole texts are long, and a worker holds a batch several times over.
BATCH_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, whatever folder the driver was started in, and batches of bounded size."""
    sc = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not getattr(sc, "_tessera_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        base = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "tessera"))
        sc._tessera_shipped = True


class Marks:
    """A bitmap of fixed size in which the bit of every id's hash is set.

    Splits a table without a shuffle into rows that may have one of the ids and
    rows that cannot; only the former need an exact join.
    """

    BITS = 1 << 24  # 2 MB

    def __init__(self, ids: DataFrame):
        name = ids.columns[0]
        one = F.expr(f"shiftleft(1L, cast(xxhash64(`{name}`) & 63 as int))")
        words = ids.select(F.shiftright(self.spot(F.col(name)), 6).alias("w"), one.alias("v"))
        bits = np.zeros(self.BITS // 64, dtype=np.int64)
        for w, v in words.groupBy("w").agg(F.bit_or("v")).toLocalIterator():  # at most BITS / 64 rows
            bits[w] = v
        self._shared = ids.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    @classmethod
    def spot(cls, id_: Column) -> Column:
        return F.xxhash64(id_).bitwiseAND(F.lit(cls.BITS - 1))

    def hit(self, spots) -> np.ndarray:
        """In a task: which of the spots (an Arrow column) are marked."""
        at = spots.to_numpy(zero_copy_only=False)
        return ((self._shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)) == 1

    def split(self, df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
        """Rows whose id is marked, and the others, each with all columns."""
        spotted = df.select("*", self.spot(F.col(id_col).cast("long")).alias("_mark_spot"))  # a further column, whatever names there are

        def rows(wanted: bool):
            def run(batches):
                for batch in batches:
                    kept = self.hit(batch.column(batch.num_columns - 1)) == wanted
                    yield batch.select(range(batch.num_columns - 1)).filter(pa.array(kept))

            return run

        return tuple(spotted.mapInArrow(rows(w), df.schema) for w in (True, False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cores(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``idx``, the place of a row (from 0) in its group, and ``m``, the group's rows. Group and order: no nulls in the former.

    The whole order is dealt out by ranges, so that a large group is spread over tasks; a row's place is its place
    in the task and the group's rows in earlier tasks. Ties in ``order`` get places in any order.
    """
    dealt = rows.repartitionByRange(cores(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    dealt = written(dealt.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    runs = dealt.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_task")
    runs = runs.select(
        group, "_task", "_first", F.sum("_n").over(Window.partitionBy(group)).alias("m"),
        (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
    )
    placed = dealt.join(runs, [group, "_task"]).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.drop("_task", "_at", "_first", "_before")
