"""Order-book events: schema, readers, and a deterministic view over the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

PREFIXES = ("bid_px_", "ask_px_", "bid_sz_", "ask_sz_", "bid_ct_", "ask_ct_")
LEVELS = 10


def schema(levels: int = LEVELS) -> T.StructType:
    """Decoded events: prices in currency, sizes as doubles, ``ts_ns`` beside the microsecond timestamp."""
    s = T.StructType()
    for name, kind in (
        ("publisher_id", "integer"), ("instrument_id", "long"), ("ts_event", "timestamp"), ("ts_ns", "long"), ("sequence", "long"),
        ("action", "string"), ("side", "string"), ("price", "double"), ("size", "double"), ("flags", "short"), ("depth", "short"),
    ):
        s = s.add(name, kind)
    for k in range(levels):
        for p in PREFIXES:
            s = s.add(f"{p}{k:02d}", "long" if "_ct_" in p else "double")
    return s


def view_sql(events: str) -> str:
    """The view as SQL that Spark and DuckDB both run; ``events`` names the table."""
    levels = ",\n".join(
        f"q.b0 - {k}e0 * 0.01e0 AS bid_px_{k:02d}, q.a0 + {k}e0 * 0.01e0 AS ask_px_{k:02d}, "
        f"CAST((q.sequence * {7 + 2 * k}) % 100 + 1 AS DOUBLE) AS bid_sz_{k:02d}, CAST((q.sequence * {13 + 2 * k}) % 100 + 1 AS DOUBLE) AS ask_sz_{k:02d}"
        for k in range(LEVELS)
    )
    price = "100e0 + CAST(CAST(floor(event_id / 3e0) AS BIGINT) * 5 % 17 AS DOUBLE) * 0.01e0"
    return f"""
SELECT q.trade_date, q.instrument_id, q.ts_event, q.sequence, q.action, q.side, q.size,
  CASE WHEN q.side = 'B' THEN q.a0 WHEN q.side = 'A' THEN q.b0
       WHEN q.sequence % 2 = 0 THEN (q.b0 + q.a0) / 2e0 ELSE q.a0 END AS price,
{levels}
FROM (SELECT CAST(ts AS DATE) AS trade_date, CAST(user_id % 2 AS INT) AS instrument_id, ts AS ts_event, event_id AS sequence,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'T' ELSE 'A' END AS action,
    CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'N' END AS side,
    CAST((event_id * 11) % 500 + 1 AS DOUBLE) AS size,
    {price} AS b0, {price} + 0.02e0 + CAST(event_id % 2 AS DOUBLE) * 0.02e0 AS a0
  FROM {events}) q"""


def book_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-book view over the given ``events``."""
    return spark.sql(view_sql("{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def read_book(spark: SparkSession, path: str, levels: int = LEVELS) -> DataFrame:
    """Events kept as Parquet below ``trade_date=.../`` folders; a filter on trade_date prunes folders."""
    return spark.read.schema(schema(levels).add("trade_date", "date")).parquet(path)


def write_book(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by day, instruments together and in time order within a file, so row groups can be skipped."""
    df.repartition("trade_date", "instrument_id").sortWithinPartitions("instrument_id", "ts_event", "sequence").write.mode(mode).partitionBy(
        "trade_date"
    ).parquet(path)


def read_zstd_csv(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """CSV files in zstd, decompressed as streams in the tasks; files come through Spark's reader.

    Values are converted by Arrow to ``columns``; day files named ``...-20250102...`` give ``trade_date``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(columns)

    def run(batches):
        import io

        import pyarrow as pa
        import pyarrow.csv as csv
        import zstandard

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content.as_buffer()))
                options = csv.ConvertOptions(column_types=arrow, include_columns=arrow.names)
                for part in csv.open_csv(stream, convert_options=options):
                    yield pa.RecordBatch.from_arrays([pa.array([file] * part.num_rows), *part.columns], names=["file", *arrow.names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = T.StructType([T.StructField("file", T.StringType()), *columns.fields])
    return files.mapInArrow(run, out).withColumn("trade_date", F.to_date(F.regexp_extract("file", r"-(\d{8})\.", 1), "yyyyMMdd"))


def write_distribution(df: DataFrame, path: str, mode: str = "append") -> None:
    """Sequence or class distributions by symbol, predicted, predictor and period."""
    df.write.mode(mode).partitionBy("symbol", "predicted", "predictor", "period").parquet(path)


def read_distribution(spark: SparkSession, path: str, **where: str) -> DataFrame:
    df = spark.read.parquet(path)
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df


def parse_name(name) -> list:
    """predicted, predictor and period of a saved distribution's file name, as columns."""
    pattern = "^(?:[^_]*_){4}([^-]*)-(.*)_([^_]*)$"
    return [F.regexp_extract(name, pattern, i).alias(c) for i, c in enumerate(("predicted", "predictor", "period"), 1)]
