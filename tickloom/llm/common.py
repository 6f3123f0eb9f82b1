"""Small helpers that the ten training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Spark/Java form of the ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent and Spark runs on one machine (as in tests) a temporary folder is made and set; on a
    cluster that is an error, since executors wouldn't see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tickloom/{what}-{uuid.uuid4().hex}"


_HELD: dict = {}


def held(key, make):
    """An object that this Python worker keeps between tasks, such as an encoder with its bounded memory.

    Only the last two keys are kept. Results never depend on what is held, only their speed.
    """
    if key not in _HELD:
        while len(_HELD) >= 2:
            _HELD.pop(next(iter(_HELD)))
        _HELD[key] = make()
    return _HELD[key]


def written(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: its lineage ends here."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, what)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Rows with whole texts are long, so at most ``rows`` of them go to Python at once: that bounds Arrow's buffers in the JVM."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def hot_joined(rows: DataFrame, side: DataFrame, key: str | list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has each ``key`` (a column or several) once and in ``size`` the number of its rows.

    Keys with over a thousandth of all rows, hence fewer than a thousand, are broadcast, so no task gets all rows of a
    hot one; the others are sort-merge joined (``how``: inner or left).
    """
    total = side.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.broadcast(side.where(F.col(size) * 1000 > total))
    rest = side.where(F.col(size) * 1000 <= total)
    cold = rows.join(F.broadcast(side.where(F.col(size) * 1000 > total).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(rest.hint("merge"), key, how))


def row_key(doc_id: Column, what: Column) -> Column:
    """A digest of a row's id and ``what`` it holds, the same for rows alike in both."""
    return F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(what.cast("string"), F.lit(""))).cast("binary"), 256))


def rows_of(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Of ``docs`` one row of each ``key`` that ``keys`` has in its column ``row_key``, with all columns: one shuffle."""
    name = fresh(docs, "_row_key")
    rows = docs.withColumn(name, key)
    return rows.join(keys.select(F.col("row_key").alias(name)).hint("merge"), name, "left_semi").dropDuplicates([name]).drop(name)


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where the id's remainder is 2; a null id is never held out."""
    return F.coalesce(crc_bucket(doc_id, modulus) == 2, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, modulus: int = 4
) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` labelled rows of each class, for fitting a classifier.

    Rows whose remainder is 2, null labels, and null or empty texts are left out. Texts are taken whole, long ones too,
    but for those by which a class would exceed ``max_chars`` characters in all: that bounds what the driver gets. The
    ids are chosen by hash, hence alike at every size of the input, and only the chosen texts leave the scan (the id list
    is broadcast: its size is bounded by ``per_class``). Of several texts of one id the smallest is taken.
    """
    sizes = docs.where((F.length("text") > 0) & ~held_out(F.col("doc_id"), modulus)).groupBy("doc_id").agg(F.max(F.length("text")).alias("chars"))
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).alias("y"))
        .join(sizes, "doc_id")
    )
    ids = []
    for y in (0, 1):
        left = max_chars
        for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            if r.chars <= left:
                left -= r.chars
                ids.append((r.doc_id, y))
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, y int")
    rows = (
        docs.where(F.length("text") > 0)
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: r.doc_id)]
