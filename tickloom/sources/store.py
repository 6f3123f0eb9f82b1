"""A store of partial distributions by day: days come in any order and may come again, and every earlier state stays readable.

Below ``path``, ``parts/day=/batch=/`` holds each batch's rows of each day, ``commits/version=`` which batch gave which day. A
version is made by writing its commit folder, which must not exist yet: of two writers one fails and may try again. Rows
of a batch that was never committed are never read, and a repeated batch overwrites its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ngrams

_COMMIT = "version long, day date, batch string"


class DistributionStore:
    """Distributions (keys, length, seq and counts) of single days, kept apart and folded when read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, what: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def commits(self) -> DataFrame:
        """version, day, batch of everything that was ever committed."""
        if not self._exists("commits"):
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits").select("version", "day", "batch")

    def version(self) -> int:
        """The last version; 0 for an empty store."""
        return self.commits().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def add(self, df: DataFrame, batch: str, day: str = "trade_date", replace: bool = False) -> int:
        """Adds the days of ``df`` that the store lacks (``replace``: all, in place of what it has) and gives the version.

        A batch without a new day changes nothing, so it may be sent again after a failure. Days stay in Spark; the driver
        gets the version's number.
        """
        if not batch or "/" in batch:
            raise ValueError("a batch needs a name without '/'")
        rows = df.drop("batch").withColumnRenamed(day, "day").where("day is not null")
        rows = rows.withColumn("day", F.col("day").cast("date"))
        have = self._latest(None)
        have = have.where(F.col("batch") == batch) if replace else have
        new = rows.join(F.broadcast(have.select("day")), "day", "left_anti").withColumn("batch", F.lit(batch))  # a row for each day
        if new.isEmpty():
            return self.version()
        parts = new.repartition("day").write.partitionBy("day", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic")
        parts.parquet(f"{self.path}/parts")
        number = self.version() + 1
        days = new.select("day", "batch").distinct()
        days.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/commits/version={number}")
        return number

    def _latest(self, version: int | None) -> DataFrame:
        commits = self.commits()
        if version is not None:
            commits = commits.where(F.col("version") <= version)
        return commits.groupBy("day").agg(F.max_by("batch", "version").alias("batch"))

    def read(self, version: int | str | None = None) -> DataFrame:
        """The rows of every day as of ``version``: a number, "first", "last" or None for the last. Only those days' folders are read."""
        if isinstance(version, str):
            if version not in ("first", "last"):
                raise ValueError("a version is a number, 'first' or 'last'")
            version = 1 if version == "first" else None
        if not self._exists("commits"):
            raise ValueError("the store is empty")
        parts = self.spark.read.parquet(f"{self.path}/parts").withColumn("batch", F.col("batch").cast("string"))
        return parts.join(F.broadcast(self._latest(version)), ["day", "batch"]).drop("batch")

    def day(self, which: str = "first") -> DataFrame:
        """The rows of the store's first or last day."""
        if which not in ("first", "last"):
            raise ValueError("which must be 'first' or 'last'")
        rows = self.read()
        edge = self._latest(None).agg((F.min if which == "first" else F.max)("day").alias("day"))
        return rows.join(F.broadcast(edge), "day", "left_semi")

    def folded(self, keys: list[str] | tuple[str, ...] = (), longest: int | None = None, version: int | str | None = None) -> DataFrame:
        """All days as of ``version`` summed, sequence or class distributions alike."""
        rows = self.read(version)
        return ngrams.fold_classes(rows, keys, longest) if "class_counts" in rows.columns else ngrams.fold(rows, keys, longest)

    def changes(self, keys: list[str] | tuple[str, ...] = (), longest: int | None = None) -> DataFrame:
        """How the folded shares of a store of sequences moved: keys, length, seq, prob and that of the version before (0 where new)."""
        last = self.version()
        now = self.folded(keys, longest, last)
        if last < 2:
            return now.select(*keys, "length", "seq", "prob", F.lit(0.0).alias("before"))
        then = self.folded(keys, longest, last - 1).select(*keys, "length", "seq", F.col("prob").alias("before"))
        return now.select(*keys, "length", "seq", "prob").join(then, [*keys, "length", "seq"], "left").fillna(0.0, subset=["before"])
