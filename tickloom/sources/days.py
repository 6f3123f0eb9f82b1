"""Day files of events, zstd CSV, as a Spark data source: read by ranges of frames, with whole files left out by their names.

    spark.dataSource.register(DayFiles)
    spark.read.format("tickloom_days").schema(columns).option("since", "2024-01-02").load("file:///data")

A file's name says its symbol and day. The options ``symbols``, ``since`` and ``until`` choose among names when the read is planned,
so other files are never opened. (Filters pushed to the source would do so too, but Spark 4.1 keeps what a frame's first
filter has planned, and a later query of the same frame without that filter would lack rows; so none are taken.) A zstd file may be many frames, each of which can be read on its own: a task takes a run of frames of about
``frameBytes``, begins after the first line's end in it and reads on to the end of the line that its last byte is in.
"""

from __future__ import annotations

import datetime
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: <folder: the symbol>/<anything>-<yyyymmdd>.<anything>.zst
NAME = r"(?:^|/)(?P<symbol>[^/]*)/[^/]*-(?P<day>\d{8})\.[^/]*\.zst$"
#: Fixed values of the zstd format: frame and skippable magic numbers.
_FRAME, _SKIP = b"\x28\xb5\x2f\xfd", b"\x2a\x4d\x18"


@dataclass
class FrameRange(InputPartition):
    """Bytes ``start`` to ``end`` of a file, whole frames."""

    path: str
    symbol: str
    day: str
    start: int
    end: int

    def __init__(self, path: str, symbol: str, day: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.symbol, self.day, self.start, self.end = path, symbol, day, start, end


def frames(f, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each frame of an open file, by its block headers: no data is decompressed or even read."""
    import zstandard

    at = 0
    while at < size:
        f.seek(at)
        head = f.read(18)
        if head[1:4] == _SKIP and head[0] & 0xF0 == 0x50:
            end = at + 8 + int.from_bytes(head[4:8], "little")
            yield at, end
            at = end
            continue
        if head[:4] != _FRAME:
            raise ValueError(f"no zstd frame at byte {at}")
        end, last = at + zstandard.frame_header_size(head), False
        while not last:
            f.seek(end)
            block = int.from_bytes(f.read(3), "little")
            last, kind = block & 1, block >> 1 & 3
            end += 3 + (1 if kind == 1 else block >> 3)
        end += 4 if head[4] & 4 else 0  # a checksum
        yield at, end
        at = end


class _Part(io.RawIOBase):
    """Bytes ``start`` to ``end`` of an open file."""

    def __init__(self, f, start: int, end: int):
        self.f, self.left = f, end - start
        f.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        got = self.f.read(min(len(b), self.left))
        self.left -= len(got)
        b[: len(got)] = got
        return len(got)


def _unpacked(f, start: int, end: int) -> Iterator[bytes]:
    import zstandard

    stream = zstandard.ZstdDecompressor().stream_reader(_Part(f, start, end), read_across_frames=True)
    while piece := stream.read(1 << 20):
        yield piece


class DayReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.root = schema, options.get("path", "")
        self.name, self.target = re.compile(options.get("name", NAME)), int(options.get("framebytes", options.get("frameBytes", 64_000_000)))
        self.symbols = set(filter(None, options.get("symbols", "").split(",")))
        self.since, self.until = (options.get(k, d).replace("-", "") for k, d in (("since", "00000000"), ("until", "99999999")))
        if not self.root:
            raise ValueError("load() needs a path")

    def _wanted(self, symbol: str, day: str) -> bool:
        return (not self.symbols or symbol in self.symbols) and self.since <= day <= self.until

    def partitions(self) -> list[FrameRange]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(self.root)
        out = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            m = self.name.search(info.path)
            if not m or info.type != pafs.FileType.File:
                continue
            symbol = m["symbol"]
            if not self._wanted(symbol, m["day"]):
                continue
            with fs.open_input_file(info.path) as f:
                start = None
                for a, b in frames(f, info.size):
                    start = a if start is None else start
                    if b - start >= self.target:
                        out.append(FrameRange(info.path, symbol, m["day"], start, b))
                        start = None
                if start is not None:
                    out.append(FrameRange(info.path, symbol, m["day"], start, info.size))
        return out or [FrameRange("", "", "", 0, 0)]

    def _lines(self, f, part: FrameRange, size: int) -> Iterator[bytes]:
        """Blocks of whole lines, the file's head line left out."""
        rest, skipping = b"", part.start > 0
        first = not skipping
        for piece in _unpacked(f, part.start, part.end):
            rest += piece
            if skipping or first:  # the rest of the line before, or the head
                cut = rest.find(b"\n")
                if cut < 0:
                    continue
                rest, skipping, first = rest[cut + 1 :], False, False
            cut = rest.rfind(b"\n") + 1
            if cut:
                yield rest[:cut]
                rest = rest[cut:]
        if skipping or first:  # no line begins here
            return
        if part.end < size:  # the line that goes on beyond these frames
            for piece in _unpacked(f, part.end, size):
                cut = piece.find(b"\n")
                rest += piece[: cut + 1] if cut >= 0 else piece
                if cut >= 0:
                    break
        if rest:
            yield rest

    def read(self, part: FrameRange):
        import pyarrow as pa
        import pyarrow.csv as csv
        import pyarrow.fs as pafs
        from pyspark.sql.pandas.types import to_arrow_schema

        if not part.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.root)
        arrow, own = to_arrow_schema(self.schema), ("symbol", "trade_date")
        day = datetime.datetime.strptime(part.day, "%Y%m%d").date()
        with fs.open_input_file(part.path) as f:
            size, head = f.size(), b""
            for piece in _unpacked(f, 0, size):
                head += piece
                if b"\n" in head:
                    break
            names = next(csv.open_csv(io.BytesIO(head.split(b"\n")[0] + b"\n" + b"," * head.split(b"\n")[0].count(b",") + b"\n"))).schema.names
            types = {x.name: x.type for x in arrow if x.name not in own}
            convert = csv.ConvertOptions(column_types=types, include_columns=list(types))
            for block in self._lines(f, part, size):
                table = csv.read_csv(io.BytesIO(block), read_options=csv.ReadOptions(column_names=names, use_threads=False), convert_options=convert)
                for b in table.to_batches(max_chunksize=50_000):
                    fixed = {"symbol": pa.array([part.symbol] * b.num_rows, pa.string()), "trade_date": pa.array([day] * b.num_rows, pa.date32())}
                    yield pa.RecordBatch.from_arrays([fixed[x.name].cast(x.type) if x.name in own else b.column(x.name) for x in arrow], schema=arrow)


class DayFiles(DataSource):
    """The columns asked for, ``symbol`` and ``trade_date`` (from the file's name) among them if the schema has them.

    Options: ``path`` (a URI that Arrow opens), ``symbols`` (with commas between), ``since`` and ``until`` (days, both included), ``name`` (a
    pattern with groups symbol and day), ``frameBytes`` (compressed bytes of a task). Lines must not hold quoted line ends.
    """

    @classmethod
    def name(cls) -> str:
        return "tickloom_days"

    def schema(self) -> str:
        raise ValueError("give the columns with schema(...)")

    def reader(self, schema: T.StructType) -> DayReader:
        return DayReader(schema, self.options)


def read_days(spark, path: str, columns: T.StructType, **options: str):
    """:class:`DayFiles` below ``path`` with ``columns`` and those of the file's name, symbol and trade_date."""
    spark.dataSource.register(DayFiles)
    own = [T.StructField("symbol", T.StringType()), T.StructField("trade_date", T.DateType())]
    return spark.read.format("tickloom_days").schema(T.StructType([*columns.fields, *own])).options(**options).load(path)
