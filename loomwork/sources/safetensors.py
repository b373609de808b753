"""Safetensors files as a DataFrame source and sink (survey S1-S8).

Format: an 8-byte little-endian header length, a JSON header of name ->
{dtype, shape, data_offsets}, then the tensors' bytes.  Read as rows
(name, dtype, shape, file, row, data): one per tensor, or with the rows option
one per leading index in a range, and nothing else is read then.  Only headers
are read where ``data`` isn't asked for; equality and prefix filters on names
reach the reader.  Headers are read once, on the driver; tasks get tensors or
ranges of rows of up to SPLIT_BYTES, so neither a large file nor a large tensor
is one task's.  A tensor that is too large for a row must be read by rows.

Written files get one file a task, moved into place when all tasks are done,
and an index file with the weight map.

Paths are URIs of any file system that pyarrow opens (local, HDFS, S3 and
others), on the driver and on executors alike.
"""

from __future__ import annotations

import json
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

#: Bytes of each dtype's items.
ITEM = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1, "F8_E4M3": 1, "F8_E8M0": 1}
NUMPY = {"float64": "F64", "float32": "F32", "float16": "F16", "int64": "I64", "int32": "I32", "int16": "I16", "int8": "I8", "uint8": "U8", "bool": "BOOL"}
SCHEMA = "name string, dtype string, shape array<bigint>, file string, row bigint, data binary"
#: Bytes that a task reads, but for one row or tensor that is longer; bytes that a row can hold.
SPLIT_BYTES, ROW_BYTES = 128 << 20, (1 << 31) - (1 << 16)
INDEX = "model.safetensors.index.json"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri)


def header(uri: str) -> tuple[dict, int]:
    """S3: a file's header and the offset of its tensors."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        (n,) = struct.unpack("<Q", f.read(8))
        return json.loads(f.read(n)), 8 + n


def _write(system: fs.FileSystem, path: str, tensors: Iterator[tuple[str, str, list[int], bytes]]) -> list[str]:
    """One file of tensors (name, dtype, shape, data); bodies wait in a task's own temporary file, as the header stands first."""
    head, at = {}, 0
    with tempfile.TemporaryFile() as body:
        for name, dtype, shape, data in tensors:
            head[name] = {"dtype": dtype, "shape": list(shape), "data_offsets": [at, at + len(data)]}
            at += len(data)
            body.write(data)
        raw = json.dumps(head).encode()
        raw += b" " * (-len(raw) % 8)
        body.seek(0)
        with system.open_output_stream(path) as f:
            f.write(struct.pack("<Q", len(raw)) + raw)
            while piece := body.read(1 << 20):
                f.write(piece)
    return list(head)


def write_file(uri: str, tensors: dict[str, np.ndarray]) -> None:
    """One file of some tensors."""
    _write(*opened(uri), ((name, NUMPY[x.dtype.name], list(x.shape), np.ascontiguousarray(x).tobytes()) for name, x in tensors.items()))


class Piece:
    """A tensor, or a range of its leading indices: where its bytes are, and how many each row has."""

    def __init__(self, name: str, tensor: dict, base: int, rows: tuple[int, int] | None):
        self.name, self.dtype, self.shape, self.rows = name, tensor["dtype"], tensor["shape"], rows
        start, end = tensor["data_offsets"]
        lead = self.shape[0] if self.shape else 1
        self.start, self.size = base + start, (end - start) // max(lead, 1) if rows else end - start

    @property
    def bytes(self) -> int:
        return self.size * (self.rows[1] - self.rows[0] if self.rows else 1)


class Part(InputPartition):
    """What a task reads of one file."""

    def __init__(self, uri: str, pieces: list[Piece]):
        self.uri, self.pieces = uri, pieces


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"].rstrip("/")
        system, path = opened(self.uri)
        folder = system.get_file_info(path).type == fs.FileType.Directory
        names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".safetensors")) if folder else []
        self.files = [f"{self.uri}/{n}" for n in names] if folder else [self.uri]
        self.rows = options.get("rows")
        self.body = options.get("data", "true").lower() == "true"
        self.names: set[str] | None = None
        self.prefix = ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Names by equality, membership or prefix; what is not taken stays with Spark."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("name",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("name",):
                self.names = {f.value} & (self.names if self.names is not None else {f.value})
            elif isinstance(f, In) and f.attribute == ("name",):
                self.names = set(f.value) & (self.names if self.names is not None else set(f.value))
            else:
                yield f

    def _pieces(self, uri: str) -> Iterator[Piece]:
        head, base = header(uri)
        for name, t in head.items():
            if name == "__metadata__" or not name.startswith(self.prefix) or (self.names is not None and name not in self.names):
                continue
            if not self.rows:
                yield Piece(name, t, base, None)
                continue
            a, b = (int(x) if x else None for x in self.rows.split(":"))
            lead = t["shape"][0] if t["shape"] else 1
            start, end = max(0, a or 0), min(lead, lead if b is None else b)
            size = (t["data_offsets"][1] - t["data_offsets"][0]) // max(lead, 1)
            step = max(1, SPLIT_BYTES // max(size, 1))
            for k in range(start, end, step):
                yield Piece(name, t, base, (k, min(end, k + step)))

    def partitions(self) -> list[Part]:
        out: list[Part] = []
        for uri in self.files:
            held = SPLIT_BYTES
            for piece in self._pieces(uri):
                if self.body and piece.size > ROW_BYTES:
                    raise ValueError(f"{piece.name} has {piece.size} bytes a row; read it by rows")
                if held + piece.bytes > SPLIT_BYTES:
                    out.append(Part(uri, []))
                    held = 0
                out[-1].pieces.append(piece)
                held += piece.bytes
        return out or [Part("", [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.pieces:
            return
        system, path = opened(partition.uri)
        name = path.rsplit("/", 1)[-1]
        with system.open_input_file(path) as f:
            for p in partition.pieces:
                for row in range(*p.rows) if p.rows else (None,):
                    data = f.read_at(p.size, p.start + p.size * (row or 0)) if self.body else None
                    yield p.name, p.dtype, p.shape, name, row, data


class Written(WriterCommitMessage):
    def __init__(self, file: str, names: list[str]):
        self.file, self.names = file, names


class Writer(DataSourceWriter):
    """Rows (name, dtype, shape, data) as files; what failed attempts wrote never gets into place."""

    def __init__(self, options: dict[str, str], fields: list[str], overwrite: bool):
        self.uri, self.fields, self.overwrite = options["path"].rstrip("/"), fields, overwrite

    def write(self, iterator: Iterator) -> Written:
        file = f"part-{uuid.uuid4().hex}.safetensors"
        system, path = opened(self.uri)
        system.create_dir(f"{path}/_temporary", recursive=True)
        at = [self.fields.index(c) for c in ("name", "dtype", "shape", "data")]
        return Written(file, _write(system, f"{path}/_temporary/{file}", (tuple(row[i] for i in at) for row in iterator)))

    def commit(self, messages: list) -> None:
        system, path = opened(self.uri)
        system.create_dir(path, recursive=True)
        weights: dict[str, str] = {}
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(path)):
                if old.base_name.endswith(".safetensors"):
                    system.delete_file(old.path)
        elif system.get_file_info(f"{path}/{INDEX}").type == fs.FileType.File:
            with system.open_input_stream(f"{path}/{INDEX}") as f:
                weights = json.loads(f.read())["weight_map"]
        for m in messages:
            if m is not None and m.names:
                system.move(f"{path}/_temporary/{m.file}", f"{path}/{m.file}")
                weights |= dict.fromkeys(m.names, m.file)
        with system.open_output_stream(f"{path}/{INDEX}") as f:
            f.write(json.dumps({"metadata": {}, "weight_map": weights}).encode())
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, path = opened(self.uri)
        if system.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_temporary")


class Safetensors(DataSource):
    """``spark.read.format("safetensors").option("rows", "2:5").load(path)``, ``df.write.format("safetensors").mode("append").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known, with filters that reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Safetensors)


def tensors(spark: SparkSession, path: str, rows: str | None = None, data: bool = True) -> DataFrame:
    """The tensors at path; rows: range of leading indices like "2:5"; without data only headers are read."""
    register(spark)
    reader = spark.read.format("safetensors").option("data", str(data).lower())
    return (reader.option("rows", rows) if rows else reader).load(path)


def write(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """df (name, dtype, shape, data) as files at path, one a partition, with their index."""
    register(df.sparkSession)
    df.select("name", "dtype", "shape", "data").write.format("safetensors").mode("overwrite" if overwrite else "append").save(path)


def catalog(spark: SparkSession, index: str) -> DataFrame:
    """Name, file out of an index file's weight_map."""
    raw = spark.read.text(index, wholetext=True)
    m = F.from_json(F.get_json_object("value", "$.weight_map"), "map<string,string>")
    return raw.select(F.explode(m).alias("name", "file"))


def floats(df: DataFrame) -> DataFrame:
    """df with values: F32 data as an array, by Arrow batches."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    at, schema = df.columns.index("data"), StructType([*df.schema.fields, StructField("values", ArrayType(FloatType()))])

    def run(batches):
        for batch in batches:
            x = [None if v is None else np.frombuffer(v, "<f4").tolist() for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.list_(pa.float32()))], names=[*batch.schema.names, "values"])

    return df.mapInArrow(run, schema)
