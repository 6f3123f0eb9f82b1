"""The store of distributions and the source of day files."""

import datetime
import random

import pytest
from pyspark.sql import functions as F, types as T

from tickloom.operators import ngrams
from tickloom.sources import days
from tickloom.sources.store import DistributionStore

KEYS = ["instrument_id"]


def _partials(spark):
    r = random.Random(4)
    rows = [(d, k, n, [r.randrange(3) for _ in range(n)], r.randrange(1, 9)) for d in range(1, 8) for k in (0, 1) for n in (1, 2) for _ in range(3)]
    df = spark.createDataFrame(rows, "d int, instrument_id int, length int, seq array<int>, cnt long")
    df = df.groupBy("d", "instrument_id", "length", "seq").agg(F.sum("cnt").alias("cnt"))
    return df.withColumn("trade_date", F.expr("date_add(date'2024-01-01', d)")).drop("d")


def _rows(df):
    return sorted((r.instrument_id, r.length, tuple(r.seq), r.cnt, r.total) for r in df.collect())


def test_days_out_of_order_and_again_equal_a_recount(spark, tmp_path):
    df = _partials(spark).cache()
    store = DistributionStore(spark, str(tmp_path / "s"))
    day = lambda *n: df.where(F.dayofmonth("trade_date").isin(*n))
    assert store.version() == 0
    assert store.add(day(7, 3), "b1") == 1
    assert store.add(day(2, 5, 3), "b2") == 2  # the third day is there already
    assert store.add(day(7, 3), "b1") == 2 and store.add(day(2), "other") == 2
    assert store.add(day(4, 6, 8), "b3") == 3
    assert _rows(store.folded(KEYS)) == _rows(ngrams.fold(df, KEYS))
    assert _rows(store.folded(KEYS, version="first")) == _rows(ngrams.fold(day(7, 3), KEYS))
    assert _rows(store.folded(KEYS, version=2)) == _rows(ngrams.fold(day(2, 3, 5, 7), KEYS))
    assert {str(r.day) for r in store.day("first").select("day").distinct().collect()} == {"2024-01-02"}
    assert {str(r.day) for r in store.day("last").select("day").distinct().collect()} == {"2024-01-08"}
    assert store.changes(KEYS).where("before > 0").count() > 0


def test_a_day_can_be_replaced_and_the_old_state_read(spark, tmp_path):
    df = _partials(spark).cache()
    store = DistributionStore(spark, str(tmp_path / "s"))
    store.add(df, "a")
    twice = df.where(F.dayofmonth("trade_date") == 4).withColumn("cnt", F.col("cnt") * 2)
    assert store.add(twice, "b", replace=True) == 2
    assert store.add(twice, "b", replace=True) == 2  # once more: nothing new
    assert _rows(store.folded(KEYS)) == _rows(ngrams.fold(df.where(F.dayofmonth("trade_date") != 4).unionByName(twice), KEYS))
    assert _rows(store.folded(KEYS, version=1)) == _rows(ngrams.fold(df, KEYS))


def test_rows_that_were_never_committed_are_not_read(spark, tmp_path):
    df = _partials(spark).cache()
    store = DistributionStore(spark, str(tmp_path / "s"))
    store.add(df.where("dayofmonth(trade_date) < 4"), "a")
    lost = df.where("dayofmonth(trade_date) = 5").withColumnRenamed("trade_date", "day").withColumn("batch", F.lit("broken"))
    lost.write.partitionBy("day", "batch").mode("append").parquet(str(tmp_path / "s" / "parts"))
    assert _rows(store.folded(KEYS)) == _rows(ngrams.fold(df.where("dayofmonth(trade_date) < 4"), KEYS))
    with pytest.raises(ValueError):
        DistributionStore(spark, str(tmp_path / "none")).read()
    with pytest.raises(ValueError):
        store.read("middle")


def test_class_distributions_fold_too(spark, tmp_path):
    rows = [(datetime.date(2024, 1, d), 1, [0], [d, 1, 0]) for d in (1, 2)]
    df = spark.createDataFrame(rows, "trade_date date, length int, seq array<int>, class_counts array<bigint>")
    store = DistributionStore(spark, str(tmp_path / "s"))
    store.add(df, "x")
    assert list(store.folded().first().class_counts) == [3, 2, 0]


# --- day files ----------------------------------------------------------------------------------------------------

COLUMNS = T.StructType().add("sequence", T.LongType()).add("price", T.DoubleType()).add("note", T.StringType())


def _write(path, symbol, day, n, cut):
    """A CSV of n rows as frames of ``cut`` bytes each, wherever lines end."""
    import zstandard

    text = "note,sequence,price,unused\n" + "".join(f"row {i},{i},{i / 4},x\n" for i in range(n))
    data, folder = text.encode(), path / symbol
    folder.mkdir(exist_ok=True)
    packer = zstandard.ZstdCompressor(write_checksum=True)
    skip = b"\x50\x2a\x4d\x18" + (3).to_bytes(4, "little") + b"abc"
    body = b"".join(packer.compress(data[a : a + cut]) + (skip if a == 0 else b"") for a in range(0, len(data), cut))
    (folder / f"feed-{day}.book-10.csv.zst").write_bytes(body)


@pytest.mark.parametrize(("cut", "size"), [(10**9, "1"), (997, "1"), (10, "1"), (997, "1200")])
def test_frames_are_read_apart_and_give_every_row_once(spark, tmp_path, cut, size):
    _write(tmp_path, "AB", "20240102", 700, cut)
    df = days.read_days(spark, f"file://{tmp_path}", COLUMNS, frameBytes=size)
    got = sorted((r.sequence, r.price, r.note, r.symbol, str(r.trade_date)) for r in df.collect())
    assert got == [(i, i / 4, f"row {i}", "AB", "2024-01-02") for i in range(700)]
    parts = len(days.DayReader(COLUMNS, {"path": f"file://{tmp_path}", "framebytes": size}).partitions())
    assert parts == 2 if cut > 10**6 else parts > 3


def test_days_and_symbols_that_are_not_asked_for_are_not_opened(spark, tmp_path):
    for symbol in ("AB", "CD"):
        for day in ("20240102", "20240103"):
            _write(tmp_path, symbol, day, 5, 60)
    (tmp_path / "CD" / "feed-20240104.book-10.csv.zst").write_bytes(b"no zstd at all")
    (tmp_path / "CD" / "notes.txt").write_text("x")
    read = lambda **o: days.read_days(spark, f"file://{tmp_path}", COLUMNS, **o)
    sound = read(until="2024-01-03")
    assert sound.where("sequence > 1 and symbol = 'CD'").count() == 6 and sound.count() == 20  # one frame, several queries
    assert sorted(r.sequence for r in read(since="2024-01-03", until="2024-01-03", symbols="CD").collect()) == list(range(5))
    assert read(symbols="AB").count() == 10 and read(since="2025-01-01").count() == 0
    with pytest.raises(Exception, match="no zstd frame"):
        read().count()
