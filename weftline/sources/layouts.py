"""Spark data source for headers of GGUF tensor files: one row a file, payload never read."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC, VERSIONS, ALIGNMENT = 0x46554747, (2, 3), 32
WINDOW, GROWTH = 8 << 20, 4
MAX_COUNT, MAX_DIMS, MAX_STRING = 1 << 24, 8, 1 << 31
#: Formats of scalar values by code of the public format; 8 is a string, 9 an array.
SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
SCHEMA = """path string, name string, file_size long, version int, alignment int, header_end long, data_start long, data_size long,
 tensors array<struct<pos: int, name: string, dims: array<long>, ggml_type: int, rel_offset: long>>,
 kv_string_locs map<string, struct<off: long, len: long>>, parse_error string, header binary"""


class LayoutError(ValueError):
    """The bytes aren't a header that this reader understands."""


class _Short(Exception):
    """The window ends before the header does."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def skip(self, n: int) -> int:
        start, self.at = self.at, self.at + n
        if self.at > len(self.data):
            raise _Short
        return start

    def number(self, form: str):
        return struct.unpack_from(form, self.data, self.skip(struct.calcsize(form)))[0]

    def text(self) -> tuple[str, int, int]:
        size = self.number("<Q")
        if size > MAX_STRING:
            raise LayoutError(f"string of {size} bytes")
        start = self.skip(size)
        return self.data[start : start + size].decode("utf-8", "replace"), start, size

    def pass_value(self, kind: int) -> None:
        if kind in SCALARS:
            self.skip(struct.calcsize(SCALARS[kind]))
        elif kind == 8:
            self.skip(self.number("<Q"))
        elif kind == 9:
            inner, count = self.number("<I"), self.number("<Q")
            if inner in SCALARS:
                self.skip(struct.calcsize(SCALARS[inner]) * count)
            elif inner == 8:
                for _ in range(count):
                    self.skip(self.number("<Q"))
            else:
                raise LayoutError(f"array of value type {inner}")
        else:
            raise LayoutError(f"value type {kind}")


def _signed(n: int, what: str) -> int:
    if n >= 1 << 63:
        raise LayoutError(f"{what} {n} is beyond a signed 64-bit integer")
    return n


def read_header(data: bytes, file_size: int) -> dict:
    """The layout that the first bytes of a file describe; raises _Short if they end too soon."""
    r = _Reader(data)
    if r.number("<I") != MAGIC:
        raise LayoutError("not a tensor file (magic)")
    version = r.number("<I")
    if version not in VERSIONS:
        raise LayoutError(f"version {version}")
    n_tensors, n_values = r.number("<Q"), r.number("<Q")
    if max(n_tensors, n_values) > MAX_COUNT:
        raise LayoutError(f"{n_tensors} tensors, {n_values} values")
    strings, alignment = {}, ALIGNMENT
    for _ in range(n_values):
        key, kind = r.text()[0], r.number("<I")
        if kind == 8:
            size = r.number("<Q")
            strings[key] = {"off": r.skip(size), "len": size}
        elif key == "general.alignment" and kind in SCALARS:
            alignment = r.number(SCALARS[kind])
        else:
            r.pass_value(kind)
    if alignment != alignment or alignment <= 0 or alignment >= 1 << 31 or alignment != int(alignment) or int(alignment) & (int(alignment) - 1):
        raise LayoutError(f"alignment {alignment}")
    alignment = int(alignment)
    tensors = []
    for pos in range(n_tensors):
        name, n_dims = r.text()[0], r.number("<I")
        if n_dims > MAX_DIMS:
            raise LayoutError(f"{n_dims} dimensions")
        dims = [_signed(r.number("<Q"), "dimension") for _ in range(n_dims)]
        tensors.append({"pos": pos, "name": name, "dims": dims, "ggml_type": r.number("<i"), "rel_offset": _signed(r.number("<Q"), "offset")})
    start = -(-r.at // alignment) * alignment
    if start > file_size:
        raise LayoutError(f"data would start at {start} of {file_size} bytes")
    return {"version": version, "alignment": alignment, "header_end": r.at, "data_start": start, "data_size": file_size - start, "tensors": tensors, "kv_string_locs": strings}


def parse_layout(path: str, with_header: bool = False) -> dict:
    """The layout of a file; a file that can't be read or understood gives its reason as parse_error."""
    out: dict = {"path": path, "name": os.path.basename(path), "parse_error": None}
    try:
        size = out["file_size"] = os.path.getsize(path)
        window = WINDOW
        with open(path, "rb") as file:
            while True:
                file.seek(0)
                data = file.read(window)
                try:
                    out |= read_header(data, size)
                    if with_header:
                        file.seek(0)
                        out["header"] = file.read(out["data_start"])
                    return out
                except _Short:
                    if len(data) >= size:
                        raise LayoutError("the header is cut off") from None
                    window *= GROWTH
    except (LayoutError, OSError) as e:
        out["parse_error"] = str(e)
        return out


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _LayoutReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.with_header = options.get("header", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Files([p]) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ["path", "name", "file_size", "version", "alignment", "header_end", "data_start", "data_size", "tensors", "kv_string_locs", "parse_error", "header"]
        for path in getattr(partition, "paths", []):
            one = parse_layout(path, self.with_header)
            if one.get("tensors") is not None:
                one["tensors"] = [tuple(t.values()) for t in one["tensors"]]
                one["kv_string_locs"] = {k: tuple(v.values()) for k, v in one["kv_string_locs"].items()}
            yield tuple(one.get(n) for n in names)


class LayoutSource(DataSource):
    """format('gguf'): option paths holds file names by lines; header=true adds the bytes before the data."""

    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _LayoutReader(dict(self.options))


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _ChunkReader(DataSourceReader):
    PER_TASK = 16

    def __init__(self, options: dict):
        self.path, self.start = options["path"], int(options.get("start", 0))
        self.chunk = int(options.get("chunk", 8 << 20))
        self.size = int(options["size"]) if "size" in options else os.path.getsize(self.path) - self.start

    def partitions(self) -> list[InputPartition]:
        n = -(-self.size // self.chunk)
        return [_Range(i, min(n, i + self.PER_TASK)) for i in range(0, n, self.PER_TASK)] or [_Range(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as file:
            for i in range(partition.first, partition.last):
                want = min(self.chunk, self.size - i * self.chunk)
                file.seek(self.start + i * self.chunk)
                data = file.read(want)
                if len(data) != want:
                    raise OSError(f"{self.path}: {len(data)} of {want} bytes at {self.start + i * self.chunk}")
                yield (i, self.start + i * self.chunk, data)


class ChunkSource(DataSource):
    """format('chunks'): a region of a file (path, start, size) as rows of fixed size; a short read is an error."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return "chunk_idx long, offset long, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LayoutSource)
    spark.dataSource.register(ChunkSource)
    return spark


def read_layouts(spark: SparkSession, paths: list[str], header: bool = False) -> DataFrame:
    return register(spark).read.format("gguf").options(paths="\n".join(paths), header=str(header).lower()).load()


def read_chunks(spark: SparkSession, path: str, start: int = 0, size: int | None = None, chunk: int = 8 << 20) -> DataFrame:
    options = {"path": path, "start": start, "chunk": chunk} | ({} if size is None else {"size": size})
    return register(spark).read.format("chunks").options(**options).load()
