"""Files of lines: heads read on the driver, bodies by Spark, ordered output written atomically."""

from __future__ import annotations

import itertools
import mmap
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text that one task takes of a blocked file, and that it passes on at once
SPAN, BATCH = 1 << 25, 1 << 23
REMOTE = ("http://", "https://", "s3://", "s3a://", "gs://", "hdfs://")


def head(spark: SparkSession, path: str) -> Iterator[str]:
    """Lines of a file of any file system Hadoop knows, gunzipped where its first bytes say so."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.open(where)
    magic = [stream.read(), stream.read()]
    stream.seek(0)
    if magic == [0x1F, 0x8B]:
        stream = jvm.java.util.zip.GZIPInputStream(stream)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        while (line := lines.readLine()) is not None:
            yield line
    finally:
        lines.close()


def _gunzipped(batches):
    import gzip
    import io

    import pandas as pd

    for pdf in batches:
        for content in pdf["content"]:
            lines = io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(content)), encoding="utf-8")
            while block := lines.readlines(1 << 22):
                yield pd.DataFrame({"value": [x.rstrip("\r\n") for x in block]})


def local(spark: SparkSession, path: str) -> str | None:
    """The path of a file that lies in the local file system, where Spark's tasks open it too; else none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return where.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def shared(spark: SparkSession, path: str) -> bool:
    """Whether what tasks write at a local path is seen by all: in a single process, or below ``spark.checkpoint.dir``."""
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return True
    base = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:").rstrip("/")
    return base.startswith("/") and os.path.abspath(path).startswith(f"{base}/")


def blocks(path: str) -> list[tuple[int, int, int]] | None:
    """(offset, bytes, bytes of text) of each block of a blocked gzip file; none where it is no such file."""
    found, at, end = [], 0, os.path.getsize(path)
    if not end:
        return None
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        while at < end:
            if end - at < 18 or data[at : at + 4] != b"\x1f\x8b\x08\x04":
                return None
            extra, stop, size = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0], None
            while extra + 4 <= min(stop, end):
                kind, n = data[extra : extra + 2], struct.unpack_from("<H", data, extra + 2)[0]
                if kind == b"BC" and n == 2 and extra + 6 <= end:
                    size = struct.unpack_from("<H", data, extra + 4)[0] + 1
                extra += 4 + n
            if size is None or at + size > end:
                return None
            found.append((at, size, struct.unpack_from("<I", data, at + size - 4)[0]))
            at += size
    return found


def spans(found: list[tuple[int, int, int]], text: int = 0) -> list[tuple[int, int, int]]:
    """(first offset, offset after the last, place in the text) of runs of blocks that hold about ``text`` bytes of it."""
    out, at, begins, place = [], 0, None, 0
    for offset, size, n in found:
        begins = offset if begins is None else begins
        at += n
        if at - place >= (text or SPAN):
            out.append((begins, offset + size, place))
            begins, place = None, at
    return out if begins is None else [*out, (begins, found[-1][0] + found[-1][1], place)]


def blocked(f, start: int, end: int) -> bytes:
    """The text of the blocks in a range of a file."""
    f.seek(start)
    out, data, at = [], memoryview(f.read(end - start)), 0
    while at < len(data):
        extra, stop, size = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0], 0
        while extra + 4 <= stop:
            if data[extra : extra + 2] == b"BC":
                size = struct.unpack_from("<H", data, extra + 4)[0] + 1
            extra += 4 + struct.unpack_from("<H", data, extra + 2)[0]
        out.append(zlib.decompress(data[at : at + size], 31))
        at += size
    return b"".join(out)


def span_lines(path: str, start: int, end: int, place: int, sizes: list[tuple[int, int]]) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, lines) of the lines that begin in a run of blocks: after its first byte, up to the byte after its last.

    ``sizes`` has (offset, bytes) of the blocks that follow, for a line that goes on there.
    """
    with open(path, "rb") as f:
        text = blocked(f, start, end)
        n = len(text)
        more, cut = [text], -1
        for offset, size in sizes:
            more.append(blocked(f, offset, offset + size))
            if (cut := more[-1].find(b"\n")) >= 0:
                more[-1] = more[-1][:cut]
                break
        text = b"".join(more)
    first = 0 if place == 0 else text.find(b"\n") + 1
    if (place and not 0 < first <= n) or first == len(text):
        return
    # without a line break after the run the file ends here: what follows its last one is no line
    found = text[first:].split(b"\n")
    if cut < 0 and not found[-1]:
        found.pop()
    at, held, begins, size = place + first, [], place + first, 0
    for x in found:
        held.append(x)
        at += len(x) + 1
        size += len(x) + 1
        if size >= BATCH:
            yield begins, held
            held, begins, size = [], at, 0
    if held:
        yield begins, held


def _lines_of_blocks(spark: SparkSession, path: str, found: list[tuple[int, int, int]], made: Callable | None) -> DataFrame:
    """(rec_idx, value): a blocked file's lines, by tasks that each take a run of blocks; rec_idx is a line's place in the text."""
    runs, starts = spans(found), [(offset, size) for offset, size, _ in found]

    def task(batches):
        import bisect

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for nth in batch.column(0).to_pylist():
                start, end, place = runs[nth]
                after = itertools.islice(starts, bisect.bisect_left(starts, (end, 0)), None)
                for at, held in span_lines(path, start, end, place, after):
                    places = at + np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
                    held = [x[:-1] if x.endswith(b"\r") else x for x in held]
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(made(held) if made else held, pa.binary()).view(pa.string())], ["rec_idx", "value"])

    return spark.range(0, len(runs), 1, len(runs)).mapInArrow(task, "rec_idx bigint, value string")


def lines(spark: SparkSession, path: str, made: Callable[[list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(rec_idx, value): the lines of a file in their order; gzip is told by its bytes, not its name.

    A blocked file that tasks can open is read by many of them. ``made`` makes a line of each.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    zipped = [stream.read(), stream.read()] == [0x1F, 0x8B]
    stream.close()
    if zipped and (here := local(spark, path)) and (found := blocks(here)):
        return _lines_of_blocks(spark, here, found, made)
    if zipped and not path.endswith(".gz"):
        text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_gunzipped, "value string")
    else:
        text = spark.read.text(path)
    numbered = text.select(F.monotonically_increasing_id().alias("rec_idx"), "value")
    if made is None:
        return numbered

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            held = made(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary()).view(pa.string())], ["rec_idx", "value"])

    return numbered.mapInArrow(task, "rec_idx bigint, value string")


def refuse_remote(path: str) -> None:
    if path.startswith(REMOTE):
        raise ValueError(f"{path} is a remote locator: output must be local")


class Bgzf:
    """Blocked gzip: blocks of at most 64 KiB, each a gzip member that tells its size."""

    #: fixed value of the format: the empty block that ends a file
    END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")

    def __init__(self, path: str, last: bool = True):
        self.file, self.held, self.at, self.last = open(path, "wb"), b"", 0, last

    def write(self, data: bytes) -> None:
        data = self.held + bytes(data) if self.held else data
        whole = len(data) - len(data) % 65_280
        for at in range(0, whole, 65_280):
            self._block(data[at : at + 65_280])
        self.held = bytes(data[whole:])

    def flush(self) -> None:
        """End the block, so that what follows begins another."""
        if self.held:
            self._block(self.held)
            self.held = b""

    def tell(self) -> int:
        """The virtual offset of the next byte."""
        return self.at << 16 | len(self.held)

    def _block(self, data: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        block = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
        self.file.write(block)
        self.at += len(block)

    def close(self) -> None:
        self.flush()
        if self.last:
            self.file.write(self.END)
        self.file.close()


def _bin(start: int, end: int) -> int:
    """The bin of [start, end) in the binning scheme of tabix."""
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return offset + (start >> shift)
    return 0


class Tabix:
    """The index of a blocked file: chunks of bins, and the first offset of every 16 KiB window."""

    def __init__(self, columns: tuple[int, int, int], zero_based: bool, preset: int = 0, meta: str = "#", skip: int = 0):
        self.layout = (preset | (0x10000 if zero_based else 0), *columns, ord(meta), skip)
        self.names: dict[str, int] = {}
        self.bins: list[dict[int, list[list[int]]]] = []
        self.windows: list[dict[int, int]] = []
        self.last: tuple[int, int] = (-1, -1)

    def add(self, name: str, start: int, end: int, begins: int, ends: int) -> None:
        at = self.names.setdefault(name, len(self.names))
        if at == len(self.bins):
            self.bins.append({})
            self.windows.append({})
        if (at, start) < self.last:
            raise ValueError(f"records are not sorted at {name}:{start}")
        self.last = (at, start)
        chunks = self.bins[at].setdefault(_bin(start, max(end, start + 1)), [])
        if chunks and chunks[-1][1] == begins:
            chunks[-1][1] = ends
        else:
            chunks.append([begins, ends])
        for w in range(start >> 14, (max(end, start + 1) - 1 >> 14) + 1):
            self.windows[at].setdefault(w, begins)

    def save(self, path: str) -> None:
        names = b"".join(n.encode() + b"\0" for n in self.names)
        out = [b"TBI\1", struct.pack("<8i", len(self.names), *self.layout, len(names)), names]
        for bins, windows in zip(self.bins, self.windows, strict=True):
            out.append(struct.pack("<i", len(bins)))
            for number, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            size, before = max(windows, default=-1) + 1, 0
            offsets = []
            for w in range(size):
                before = windows.get(w, before)
                offsets.append(before)
            out.append(struct.pack(f"<i{size}Q", size, *offsets))
        packed = Bgzf(path)
        packed.write(b"".join(out))
        packed.close()


def write_lines(path: str, text: Iterable[str], index: Tabix | None = None, place=None) -> None:
    """Write lines to a local file in their order; nothing is left if that fails.

    Names that end in .gz or .bgz are blocked gzip. ``place`` gives (name, start, end), 0-based and
    half-open, of the lines to index; if only indexing fails, the data stay.
    """
    refuse_remote(path)
    if index and not path.endswith((".gz", ".bgz")):
        raise ValueError("an index needs a blocked file: a name that ends in .gz")
    temp = f"{path}.part"
    unsorted = None
    try:
        if path.endswith((".gz", ".bgz")):
            out = Bgzf(temp)
            for line in text:
                begins = out.tell()
                out.write(f"{line}\n".encode())
                if index and unsorted is None and (at := place(line)):
                    try:
                        index.add(*at, begins, out.tell())
                    except ValueError as e:
                        unsorted = e
            out.close()
        else:
            with open(temp, "w", encoding="utf-8", newline="") as f:
                f.writelines(f"{line}\n" for line in text)
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.remove(temp)
        raise
    if unsorted:
        raise unsorted
    if index:
        index.save(f"{path}.tbi")


def _text(batch) -> memoryview:
    """The bytes of a batch of one column of text, one value after another."""
    import pyarrow as pa

    values = batch.column(0)
    _, places, data = values.buffers()
    places = memoryview(places).cast("q" if pa.types.is_large_string(values.type) else "i")
    return memoryview(data or b"")[places[values.offset] : places[values.offset + len(values)]]


def write_parts(rows: DataFrame, path: str, head: bytes, pack: Callable, blocked: bool) -> None:
    """Write what ``pack`` makes of each batch of rows (bytes, or a list of them, each for blocks of its own) to a local file, in their order; nothing is left if that fails.

    Each task writes a part beside the file, in a folder that all share; the driver puts them together,
    and each goes as soon as it is there.
    """
    temp, folder = f"{path}.part", os.path.abspath(f"{path}.{uuid.uuid4().hex[:8]}.parts")

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        nth = TaskContext.get().partitionId()
        name = f"{folder}/{nth}-{uuid.uuid4().hex}"
        out = Bgzf(name, last=False) if blocked else open(name, "wb")
        for batch in batches:
            made = pack(batch)
            if not isinstance(made, list):
                out.write(made)
                continue
            for piece in made:  # of whole records: each begins a block
                out.write(piece)
                out.flush()
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([nth], pa.int32()), pa.array([name])], ["nth", "name"])

    os.makedirs(folder)
    try:
        parts = sorted((r["nth"], r["name"]) for r in rows.mapInArrow(task, "nth int, name string").collect())
        first = Bgzf(temp, last=False) if blocked else open(temp, "wb")
        first.write(head)
        first.close()
        with open(temp, "ab") as out:
            for _, name in parts:
                with open(name, "rb") as part:
                    shutil.copyfileobj(part, out, 1 << 22)
                os.remove(name)
            if blocked:
                out.write(Bgzf.END)
        os.replace(temp, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        if os.path.exists(temp):
            os.remove(temp)


def write_table(rows: DataFrame, path: str, head: Iterable[str] = ()) -> None:
    """Write a head and a table of lines (one column) to a local file, in the order of its rows.

    Tasks write it where all see what they write; else the lines go through the driver.
    """
    refuse_remote(path)
    line = rows.columns[0]
    if not shared(rows.sparkSession, path):
        write_lines(path, itertools.chain(head, (r[0] for r in rows.toLocalIterator())))
        return
    text = rows.select(F.concat(F.col(line), F.lit("\n")).alias("line"))
    write_parts(text, path, "".join(f"{x}\n" for x in head).encode(), _text, path.endswith((".gz", ".bgz")))


def write_each(rows: DataFrame, name: Callable[[int], str], head: Iterable[str] = ()) -> None:
    """Write a table (nth, place, line) as one local file for each number, in the order of places; ``name`` tells it.

    A file is written by one task in a folder that all share; the driver moves all to their names.
    """
    first = "".join(f"{x}\n" for x in head).encode()
    folder = os.path.abspath(f"{name(0)}.{uuid.uuid4().hex[:8]}.parts")
    blocked = name(0).endswith((".gz", ".bgz"))

    def task(batches):
        import pyarrow as pa

        now, out, made = None, None, []
        for batch in batches:
            for nth, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if nth != now:
                    if out:
                        out.close()
                    now, path = nth, f"{folder}/{nth}-{uuid.uuid4().hex}"
                    out = Bgzf(path) if blocked else open(path, "wb")
                    out.write(first)
                    made.append((nth, path))
                out.write(f"{line}\n".encode())
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.int64()), pa.array([p for _, p in made], pa.string())], ["nth", "name"])

    os.makedirs(folder)
    try:
        each = rows.repartition("nth").sortWithinPartitions("nth", "place").select("nth", "line")
        for r in each.mapInArrow(task, "nth bigint, name string").collect():
            os.replace(r["name"], name(r["nth"]))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
