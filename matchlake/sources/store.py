"""Keyed tables on top of plain files: keep-last, upsert, versions, staging."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key. Copies are dropped before the shuffle (group limit)."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def upsert(
    base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Rows of ``delta`` replace rows of ``base`` with the same key; of several the last in ``order``.

    Base rows are only matched against the delta's keys, so a small delta is broadcast by
    the optimiser and the base is not shuffled.
    """
    delta = keep_last(delta, keys, order)
    kept = base.join(delta.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(delta, allowMissingColumns=True)


def staging_folder(spark: SparkSession) -> str:
    """The shared folder of the session, ``spark.checkpoint.dir``.

    Without that setting only a local master may go on, with a folder of its own that is
    remembered in the session: driver and tasks are one process there. On a cluster a
    machine-local folder would lose rows, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="matchlake-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def staged(df: DataFrame, **options) -> DataFrame:
    """Write a frame that several later steps read, and go on from the written table.

    This cuts the lineage: the input is scanned once, a lost executor costs only the
    reading of the table, and later steps read just the columns they need. ``options``
    are those of the writer.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write a frame in hash buckets of a key, and go on from the written table.

    As ``staged``, and joins and groups by the key need no further shuffle, in as many tasks as
    there are buckets whatever their bytes. Give it a frame that lies in ``buckets`` partitions of
    the key (``repartition(buckets, key)``): every task writes one file then.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    path = f"{staging_folder(spark).rstrip('/')}/{name}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def read_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table at a path, or None where nothing has been written yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class VersionedTable:
    """A table that is always rewritten whole: a write goes to a new folder and becomes visible
    when its number is in the list of versions, which is written last. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """Number of the newest complete version, 0 where there is none."""
        listed = read_or_none(self.spark, f"{self.root}/versions", "done boolean, v long")
        return 0 if listed is None else listed.agg(F.max("v")).first()[0] or 0

    def exists(self) -> bool:
        return self.version() > 0

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/v={self.version()}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        version = self.version() + 1
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/data/v={version}")
        done = self.spark.createDataFrame([(True,)], "done boolean").coalesce(1)
        done.write.mode("overwrite").parquet(f"{self.root}/versions/v={version}")
        return self.read()


class KeyedTable:
    """Rows by key in hash buckets; a batch writes new copies of the buckets that it touches.

    ``data/bucket=b/v=n`` is bucket b after batch n. ``manifest/v=n`` lists the buckets of batch n
    and is written after them, so readers see a batch whole or not at all. A batch starts from
    the copies before it: run again after a lost driver, it writes the same folders once more.
    Batch numbers grow and there is one writer at a time. The manifest is read on the driver, one
    number per bucket. ``buckets`` is fixed for the life of a table; choose it so that a bucket fits
    in a task. Superseded copies stay until the table is written anew elsewhere.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.schema, self.buckets = schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def newest(self, before: int | None = None) -> dict[int, int]:
        """bucket -> the batch that wrote its newest copy, of all batches or of those before one."""
        listed = read_or_none(self.spark, f"{self.root}/manifest", "bucket int, v long")
        if listed is None:
            return {}
        if before is not None:
            listed = listed.filter(F.col("v") < before)
        return dict(listed.groupBy("bucket").agg(F.max("v")).collect())

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """Current rows, or those before a batch; only the folders of the copies named are scanned."""
        copies = [f"{b}/{v}" for b, v in self.newest(before).items() if only is None or b in only]
        kinds = f"{self.schema}, bucket int, v long"
        stored = read_or_none(self.spark, f"{self.root}/data", kinds) if copies else None
        if stored is None:
            return self.spark.createDataFrame([], self.schema)
        return stored.filter(F.concat_ws("/", "bucket", "v").isin(copies)).drop("bucket", "v")

    def apply(
        self, delta: DataFrame, batch: int, combine: Callable[[DataFrame, DataFrame], DataFrame]
    ) -> list[int]:
        """Write ``combine(rows of the touched buckets, delta)`` and return the touched buckets.

        ``delta`` is read more than once: give it a table.
        """
        touched = sorted(r[0] for r in delta.select(self.bucket()).distinct().collect())
        if not touched:
            return touched
        rows = combine(self.read(batch, touched), delta)
        names = self.spark.createDataFrame([], self.schema).columns
        (
            rows.select(*names, self.bucket().alias("bucket"), F.lit(batch).cast("long").alias("v"))
            .repartition("bucket")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "v").parquet(f"{self.root}/data")
        )
        listed = self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.root}/manifest/v={batch}")
        return touched

    def upsert(self, delta: DataFrame, order: list[str], batch: int) -> list[int]:
        """Rows of ``delta`` replace stored rows of the same key; of several the last in ``order``."""
        return self.apply(delta, batch, lambda old, new: upsert(old, new, self.keys, order))


# ---- prediction log ---------------------------------------------------------


def save_predictions(log: DataFrame, scored: DataFrame) -> DataFrame:
    """New predictions replace logged ones of the same day and pair, results included."""
    from matchlake.schemas import PREDICTION_KEY

    return upsert(log, scored, PREDICTION_KEY, ["prediction_timestamp"])


def record_results(log: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log with results filled in, results that match no prediction).

    ``results``: match_date, team_a, team_b, winner, score, result_timestamp;
    of several results of one key the newest counts.
    """
    from matchlake.schemas import PREDICTION_KEY

    given = keep_last(results, PREDICTION_KEY, ["result_timestamp", "winner", "score"]).select(
        *PREDICTION_KEY,
        F.col("winner").alias("_w"),
        F.col("score").alias("_s"),
        F.col("result_timestamp").alias("_t"),
    )
    done = log.join(given, PREDICTION_KEY, "left").withColumns(
        {
            "actual_winner": F.coalesce("_w", "actual_winner"),
            "actual_score": F.coalesce("_s", "actual_score"),
            "result_timestamp": F.coalesce("_t", "result_timestamp"),
        }
    )
    unmatched = results.join(log.select(*PREDICTION_KEY), PREDICTION_KEY, "left_anti")
    return done.select(*log.columns), unmatched
