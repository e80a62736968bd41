"""Binary model headers as tables, through a Python data source.

    spark.dataSource.register(GgufSource)
    spark.read.format("gguf").option("table", "metadata").load(folder)

Options: ``table`` (models, metadata, tensors, or headers: one row a file with the other two as arrays), ``mode`` (full, metadata), ``keys`` (comma-separated: only these keys'
values are decoded), ``materialize`` (keys whose arrays are kept whole), ``sha256`` (true: the whole file is hashed too; without it weights are never read), ``prefix_mb`` (ladder
of prefix sizes to try, for files that are long to fetch; a file that needs more than the last is an error row). A file that can't be opened or parsed is a models row with parse_error and
has no other rows. ``pushdown`` (true, where the session has spark.sql.python.filterPushdown.enabled; :func:`load` sees to it) takes filters on model_id and path, by which other files aren't opened, and on
the key of metadata, by which other values are skipped and neither decoded nor sent; rows are the same. Paths are local, URLs, or URIs (s3://, gs://, hdfs://) that pyarrow's file systems open: of the latter two only ranges are read, by the ladder. Local headers
are parsed where the file is mapped, of whatever length. Files are dealt over at most ``MOST_TASKS`` partitions.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from lakeproof.functions import fixed
from lakeproof.sources.staging import written
from lakeproof.sources.web import WebFile

MODELS = """model_id string, path string, version int, tensor_count decimal(20,0), file_size bigint, data_start decimal(38,0), alignment decimal(20,0),
    sha256 string, parse_error string, complete boolean"""
METADATA = """model_id string, ord int, key string, vtype string, v_str string, v_int decimal(20,0), v_double double, v_bool boolean,
    arr struct<elem_type: string, length: decimal(20,0), preview_str: array<string>, preview_int: array<decimal(20,0)>, truncated: boolean, max_elem_bytes: bigint>"""
TENSORS = "model_id string, ord int, name string, shape array<decimal(20,0)>, dtype string, type_id bigint, offset decimal(20,0)"
_inner = lambda ddl: "array<struct<" + re.sub(r"\b(\w+) (?=string|int|bigint|double|boolean|decimal|struct|array)", r"\1: ", ddl.split(",", 1)[1].strip()) + ">>"
SCHEMAS = {"models": MODELS, "metadata": METADATA, "tensors": TENSORS, "headers": f"{MODELS}, metadata {_inner(METADATA)}, tensors {_inner(TENSORS)}"}
MOST_TASKS = 10_000
#: Prefix sizes in MB for files that aren't local, and bytes that are hashed at a time.
REMOTE_LADDER, HASHED = (16, 48, 120), 8 << 20
DTYPE_NAMES = {t[0]: t[1] for t in fixed.TENSOR_TYPES}


class HeaderError(Exception):
    """The bytes are no readable header."""


class Short(HeaderError):
    """More bytes might help: the header goes on beyond the ones at hand."""


@dataclass
class Array:
    elem_type: str
    length: int
    preview: list
    truncated: bool
    max_elem_bytes: int


@dataclass
class Header:
    version: int = 0
    tensor_count: int = 0
    pairs: list[tuple[str, int, Any]] = field(default_factory=list)
    tensors: list[tuple[str, list[int], int, int]] = field(default_factory=list)
    data_start: int = 0
    alignment: int = fixed.DEFAULT_ALIGNMENT

    @property
    def metadata(self) -> dict[str, Any]:
        """Current values: the last of a key, at the place of its first."""
        return {k: v for k, _, v in self.pairs}


class Cursor:
    """Reads forward; every length is held against what is there before anything is allocated."""

    def __init__(self, data, size: int | None = None):
        self.data, self.at, self.size = memoryview(data), 0, len(data) if size is None else size

    def left(self) -> int:
        return self.size - self.at

    def take(self, n: int) -> memoryview:
        if n > self.left():
            raise Short(f"read of {n} bytes at {self.at} exceeds the end of file")
        if self.at + n > len(self.data):
            raise Short(f"read of {n} bytes at {self.at} exceeds the bytes at hand")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def number(self, kind: str):
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def string(self) -> str:
        return bytes(self.take(self.number("Q"))).decode("utf-8", errors="replace")


def _array(c: Cursor, whole: bool, keep: bool) -> Array | None:
    kind, length = c.number("I"), c.number("Q")
    if kind == fixed.ARRAY or kind not in fixed.LEAST_SIZES:
        raise HeaderError(f"array of type {kind} is not supported")
    if length * fixed.LEAST_SIZES[kind] > c.left():
        raise Short(f"array of {length} elements cannot fit in the file")
    wanted = 0 if not keep else length if whole else min(length, fixed.PREVIEW)
    preview: list = []
    most = 0
    if kind == fixed.STRING:
        for i in range(length):
            n = c.number("Q")
            raw = c.take(n)
            most = max(most, n)
            if i < wanted:
                preview.append(bytes(raw).decode("utf-8", errors="replace"))
    else:
        code = fixed.SCALAR_FORMATS[kind]
        raw = c.take(length * struct.calcsize("<" + code))
        preview = [x[0] for x in struct.iter_unpack("<" + code, raw[: wanted * struct.calcsize("<" + code)])]
        most = struct.calcsize("<" + code)
    return Array(fixed.VALUE_NAMES[kind], length, preview, length > len(preview), most) if keep else None


def _value(c: Cursor, kind: int, whole: bool, keep: bool = True):
    if kind == fixed.STRING:
        return c.string() if keep else c.take(c.number("Q")) and None
    if kind == fixed.ARRAY:
        return _array(c, whole, keep)
    if kind not in fixed.SCALAR_FORMATS:
        raise HeaderError(f"unknown value type {kind}")
    return c.number("B") != 0 if kind == fixed.BOOL else c.number(fixed.SCALAR_FORMATS[kind])


def parse_header(data, size: int | None = None, materialize: Iterable[str] = (), mode: str = "full", keys: Iterable[str] | None = None, values_of: set[str] | None = None) -> Header:
    """Decode a header. ``size`` is the file's size if ``data`` is only its beginning; ``keys`` limits which pairs are kept.

    With ``values_of`` the pairs of other keys keep their places but have no value, and all else is read and checked as ever.
    """
    c, whole, wanted = Cursor(data, size), set(materialize), None if keys is None else set(keys)
    if bytes(c.take(4)) != fixed.MAGIC:
        raise HeaderError("not a model file: wrong magic")
    out = Header(version=c.number("I"))
    if out.version not in fixed.VERSIONS:
        raise HeaderError(f"version {out.version} is not supported")
    out.tensor_count, pairs = c.number("Q"), c.number("Q")
    if pairs * fixed.LEAST_PAIR > c.left():
        raise Short(f"{pairs} metadata pairs cannot fit in the file")
    if mode == "full" and wanted is None and out.tensor_count * fixed.LEAST_TENSOR > c.left():
        raise Short(f"{out.tensor_count} tensors cannot fit in the file")
    for _ in range(pairs):
        key, kind = c.string(), c.number("I")
        keep = wanted is None or key in wanted
        value = _value(c, kind, key in whole, keep and (values_of is None or key in values_of))
        if keep:
            out.pairs.append((key, kind, value))
    raw = out.metadata.get("general.alignment")
    if isinstance(raw, int) and raw > 0:
        out.alignment = int(raw)
    if mode != "full" or wanted is not None:
        return out
    for _ in range(out.tensor_count):
        name, n = c.string(), c.number("I")
        if n > fixed.MOST_DIMS:
            raise HeaderError(f"tensor {name!r} has {n} dimensions")
        out.tensors.append((name, [c.number("Q") for _ in range(n)], c.number("I"), c.number("Q")))
    out.data_start = -(-c.at // out.alignment) * out.alignment
    return out


def parse_prefixes(read, size: int, ladder: Iterable[int], **options) -> Header:
    """Parse ever longer beginnings of a file, each from ``read(n)``, until one holds the header."""
    error: Short | None = None
    for n in ladder:
        try:
            return parse_header(read(min(n, size)), size, **options)
        except Short as e:
            error = e
            if n >= size:
                break
    raise error or Short("no prefix sizes")


def metadata_rows(model_id: str, header: Header, only: set[str] | None = None) -> Iterator[tuple]:
    dec = lambda x: Decimal(int(x))
    for i, (key, kind, v) in enumerate(header.pairs):
        if only is not None and key not in only:
            continue
        arr = None
        if isinstance(v, Array):
            ints = [dec(x) for x in v.preview if isinstance(x, int)] if v.elem_type not in ("string", "float32", "float64") else None
            arr = (v.elem_type, dec(v.length), list(v.preview) if v.elem_type == "string" else None, ints, v.truncated, v.max_elem_bytes)
        yield (
            model_id, i, key, fixed.VALUE_NAMES[kind], v if isinstance(v, str) else None, dec(v) if isinstance(v, int) and not isinstance(v, bool) else None,
            v if isinstance(v, float) else None, v if isinstance(v, bool) else None, arr,
        )


def tensor_rows(model_id: str, header: Header) -> Iterator[tuple]:
    for i, (name, shape, kind, offset) in enumerate(header.tensors):
        yield (model_id, i, name, [Decimal(d) for d in shape], DTYPE_NAMES.get(kind, f"GGML_TYPE_{kind}"), kind, Decimal(offset))


@dataclass
class _Files(InputPartition):
    paths: list[str]


def _is_uri(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def file_system(uri: str):
    """pyarrow's file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Handle:
    """A file whose ranges can be read: mapped if it is local, else through pyarrow's file system of its URI."""

    def __init__(self, path: str):
        if path.startswith(("http://", "https://")):
            self.file, self.mapped = WebFile(path), None
            self.size = self.file.size
        elif _is_uri(path):
            system, inside = file_system(path)
            self.file = system.open_input_file(inside)
            self.size, self.mapped = self.file.size(), None
        else:
            import mmap

            self.file = open(_local(path), "rb")  # noqa: SIM115
            self.size = os.path.getsize(_local(path))
            self.mapped = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ) if self.size else None

    def read(self, at: int, n: int) -> bytes:
        if self.mapped is not None:
            return self.mapped[at : at + n]
        if isinstance(self.file, WebFile):
            return self.file.read(at, n)
        self.file.seek(at)
        return self.file.read(n)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for at in range(0, self.size, HASHED):
            digest.update(self.read(at, HASHED))
        return digest.hexdigest()


def found_files(path: str) -> list[str]:
    """The model files under a path, in order; the path itself if it is a file."""
    if path.startswith(("http://", "https://")):
        return [path]
    if _is_uri(path):
        from pyarrow import fs

        system, inside = file_system(path)
        if system.get_file_info(inside).type != fs.FileType.Directory:
            return [path]
        root = path[: len(path) - len(inside)] if path.endswith(inside) else path.split("://")[0] + "://"
        return sorted(root + f.path for f in system.get_file_info(fs.FileSelector(inside, recursive=True)) if f.is_file and f.path.lower().endswith(".gguf"))
    path = _local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.lower().endswith(".gguf"))
    return [path]


def model_row(path: str, size: int | None, header: Header, sha256: str | None, error: str | None, complete: bool) -> tuple:
    return (path, path, header.version or None, Decimal(header.tensor_count), size, Decimal(header.data_start), Decimal(header.alignment), sha256, error, complete)


def rows_of(table: str, name: str, size: int | None, header: Header, sha256: str | None, error: str | None, complete: bool, only: set[str] | None = None) -> Iterator[tuple]:
    """One file's rows of a table."""
    if table == "metadata":
        yield from metadata_rows(name, header, only)
    elif table == "tensors":
        yield from tensor_rows(name, header)
    else:
        model = model_row(name, size, header, sha256, error, complete)
        inner = ([r[1:] for r in metadata_rows(name, header)], [r[1:] for r in tensor_rows(name, header)]) if table == "headers" else ()
        yield (*model, *inner)


class GgufSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gguf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "models")]

    def reader(self, schema) -> DataSourceReader:
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (_PushingReader if pushes else _Reader)(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.table = options.get("table", "models")
        split = lambda k: [x.strip() for x in options[k].split(",") if x.strip()] if options.get(k) else None
        self.parse = {"materialize": split("materialize") or [], "mode": options.get("mode", "full"), "keys": split("keys")}
        self.ladder = [int(float(x) * (1 << 20)) for x in split("prefix_mb") or []]
        self.files: set[str] | None = None
        self.only: set[str] | None = None
        self.hashed = options.get("sha256", "false").lower() == "true" and self.table in ("models", "headers")

    def partitions(self) -> list[InputPartition]:
        found = [f for f in found_files(self.options["path"]) if self.files is None or f in self.files]
        n = min(len(found), MOST_TASKS)
        return [_Files(found[i::n]) for i in range(n)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                file, error, header = _Handle(path), None, Header()
            except OSError as e:
                yield from rows_of(self.table, path, None, Header(), None, str(e), False)
                continue
            ladder = self.ladder or ([n << 20 for n in REMOTE_LADDER] if file.mapped is None else [])
            try:
                if not file.size:
                    raise HeaderError("the file is empty")
                if ladder:
                    header = parse_prefixes(lambda n, f=file: f.read(0, n), file.size, ladder, values_of=self.only, **self.parse)
                else:
                    header = parse_header(file.mapped, file.size, values_of=self.only, **self.parse)
            except HeaderError as e:
                error, header = str(e), Header()
            yield from rows_of(self.table, path, file.size, header, file.sha256() if self.hashed else None, error, not ladder and error is None, self.only)


class _PushingReader(_Reader):
    """A reader that takes equality with one or some texts, of model_id, path and the key of metadata; all other filters stay Spark's."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        both = lambda old, new: new if old is None else old & new
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and (f.attribute == ("model_id",) or f.attribute == ("path",) and self.table in ("models", "headers")):
                self.files = both(self.files, values)
            elif values is not None and f.attribute == ("key",) and self.table == "metadata":
                self.only = both(self.only, values)
            else:
                yield f


def load(spark, path: str, **options):
    """(models, metadata, tensors) of the model files under a path, each read from the files when it is used."""
    spark.dataSource.register(GgufSource)
    options = {"pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | options
    read = lambda table: spark.read.format("gguf").options(table=table, **options).load(path)
    return read("models"), read("metadata"), read("tensors")


def split_headers(headers):
    """(models, metadata, tensors) of a headers table."""
    inner = lambda c: headers.where(f"size({c}) > 0").selectExpr("model_id", f"inline({c})")
    return headers.drop("metadata", "tensors"), inner("metadata"), inner("tensors")


def load_once(spark, path: str, **options):
    """(models, metadata, tensors) as :func:`load` gives them, after every file has been read once into a table in the shared folder."""
    spark.dataSource.register(GgufSource)
    return split_headers(written(spark.read.format("gguf").options(table="headers", **options).load(path), "headers"))


def header_packer(spark):
    """The schema of a headers table, and a function that makes an Arrow batch of such rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = SCHEMAS["headers"].replace("\n", " ")
    shape = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    names = {c: [f.name for f in shape.field(c).type.value_type] for c in ("metadata", "tensors")}
    arr = [f.name for f in shape.field("metadata").type.value_type.field("arr").type]

    def pack(rows: Iterable[tuple]):
        packed = []
        for row in rows:
            meta, tensors = ([dict(zip(names[c], r)) for r in inner] for c, inner in zip(names, row[-2:]))
            for m in meta:
                m["arr"] = m["arr"] and dict(zip(arr, m["arr"]))
            packed.append([*row[:-2], meta, tensors])
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*packed), shape)], schema=shape)

    return ddl, pack


def load_bytes(spark, path: str, **options):
    """(models, metadata, tensors) as :func:`load_once` gives them, from any store that Spark reads; each file (under 2 GB) is taken into memory as a whole."""
    parse = {"materialize": [k for k in options.get("materialize", "").split(",") if k], "mode": options.get("mode", "full"), "keys": options["keys"].split(",") if options.get("keys") else None}
    hashed = str(options.get("sha256", "false")).lower() == "true"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gguf").load(path).select("path", "content")

    ddl, pack = header_packer(spark)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                error, header, data = None, Header(), data.as_buffer()
                try:
                    header = parse_header(data, data.size, **parse)
                except HeaderError as e:
                    error = str(e)
                yield pack(rows_of("headers", name, data.size, header, hashlib.sha256(data).hexdigest() if hashed else None, error, error is None))

    return split_headers(written(raw.mapInArrow(run, ddl), "headers"))


# --- writing, for fixtures ---


def _string(s: str) -> bytes:
    raw = s.encode("utf-8")
    return struct.pack("<Q", len(raw)) + raw


def _kind_of(v) -> int:
    if isinstance(v, bool):
        return fixed.BOOL
    if isinstance(v, int):
        return fixed.INT64 if abs(v) >= 1 << 31 else fixed.INT32 if v < 0 else fixed.UINT32
    if isinstance(v, float):
        return fixed.FLOAT32
    return fixed.STRING if isinstance(v, str) else fixed.ARRAY


def _encoded(v, kind: int) -> bytes:
    if kind == fixed.STRING:
        return _string(v)
    if kind == fixed.ARRAY:
        inner = _kind_of(v[0]) if v else fixed.INT32
        inner = fixed.INT32 if inner == fixed.UINT32 else inner
        return struct.pack("<IQ", inner, len(v)) + b"".join(_encoded(x, inner) for x in v)
    return struct.pack("<" + ("B" if kind == fixed.BOOL else fixed.SCALAR_FORMATS[kind]), v)


def build(pairs: list[tuple[str, Any]] | dict, tensors: list[tuple[str, list[int], int]], version: int = 3, offsets: list[int] | None = None, data_len: int | None = None, tail: bytes = b"") -> bytes:
    """The bytes of a model file with these pairs and tensors (name, shape, type id) over zeros."""
    pairs = list(pairs.items()) if isinstance(pairs, dict) else pairs
    out = [fixed.MAGIC, struct.pack("<IQQ", version, len(tensors), len(pairs))]
    for key, v in pairs:
        kind = _kind_of(v)
        out += [_string(key), struct.pack("<I", kind), _encoded(v, kind)]
    layout = {t[0]: t[2:] for t in fixed.TENSOR_TYPES}
    align, at, sizes = fixed.DEFAULT_ALIGNMENT, 0, []
    for i, (name, shape, kind) in enumerate(tensors):
        block, size = layout.get(kind, (None, None))
        n = 0
        if block and size and shape:
            n = shape[0] * size // block
            for d in shape[1:]:
                n *= d
        where = offsets[i] if offsets else at
        out += [_string(name), struct.pack("<I", len(shape)), struct.pack(f"<{len(shape)}Q", *shape), struct.pack("<IQ", kind, where)]
        at += -(-min(n, 1 << 20) // align) * align
        sizes.append(n)
    head = b"".join(out)
    head += b"\0" * (-len(head) % align)
    return head + b"\0" * (at if data_len is None else data_len) + tail
