"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.sources.store import staged, staging_folder  # noqa: F401  re-exported


# Joins that move texts carry a "merge" hint: they shuffle at every size, so small inputs show
# what large ones will do.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: Rows that are Python objects at the same time; Arrow batches may be larger.
ROWS_AT_ONCE = 1000
#: Bytes of an Arrow batch (about), where the session has no limit of its own: Spark's default lets a batch
#: hold the texts of a whole task, in the JVM and again in Python.
BATCH_BYTES = 4 << 20


def by_batch(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Apply a function of column lists to parts of each Arrow batch of ``df``.

    ``make`` runs once per task and returns that function, so that models and caches are
    loaded once; it gets {column: list} and returns {column: list} in the order of ``schema``.
    Batches are bounded by the session's setting, which is set here if nobody has set it.
    """
    names = df.columns
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(limit, None) is None:
        df.sparkSession.conf.set(limit, f"{BATCH_BYTES}b")
    spark_type = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(low, ROWS_AT_ONCE)
                out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, spark_type)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves remainder 1 by 3: never used for learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def row_key(*columns: str) -> Column:
    """A key that tells repeated ids with different contents apart."""
    return F.xxhash64(*[F.col(c) for c in columns])
