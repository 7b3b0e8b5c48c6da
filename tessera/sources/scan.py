"""Scans of folders of tagged JSON documents: a data source "tagged_json", and `scan`, which holds it to an error budget.

    spark.read.format("tagged_json").option("profile", "core,patient").load("/data/in")

A file is one document, or with `lines` one document a line. Each document gives one row: `path`, `offset` (of its line, in
bytes), `error` and `limit` (what went wrong, without any value of the document), the columns of the profiles asked for,
`missing` and `invalid` (the columns whose element is absent or can't be read), and `selected`. Columns of other profiles
aren't made, and a document that can't be read has nulls in all of its own.

Planning lists the folder breadth first, with bounds on files, folders, depth and paths, and deals it out in parts of about
`part_bytes`; a large file of lines is cut into several, each of which begins after a line's end. Exceeding a bound is an
error of the whole scan (ScanLimit), never a cut. So is a part with more than `max_errors` errors. `scan` counts the
errors of all parts.

Folders are read by pyarrow's file systems: local or mounted ones, S3, GCS, HDFS. For a store that only Spark reads, read
the files by Spark and give their texts to `documents`, which makes the same rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.checkpoints import checkpointed

#: Column, tag and kind of the fields of each profile (fixed values).
PROFILES = {
    "core": (("study_uid", "0020000D", "uid"), ("series_uid", "0020000E", "uid"), ("modality", "00080060", "text"), ("series_number", "00200011", "text"), ("class_uid", "00080016", "uid"), ("instance_uid", "00080018", "uid"), ("instance_number", "00200013", "text"), ("number_of_frames", "00280008", "integer")),
    "patient": (("patient_name", "00100010", "text"), ("patient_id", "00100020", "text"), ("patient_birth_date", "00100030", "text"), ("patient_sex", "00100040", "text")),
    "descriptions": (("accession_number", "00080050", "text"), ("study_date", "00080020", "text"), ("study_time", "00080030", "text"), ("study_description", "00081030", "text"), ("series_date", "00080021", "text"), ("series_time", "00080031", "text"), ("series_description", "0008103E", "text")),
    "geometry": (("rows", "00280010", "integer"), ("columns", "00280011", "integer"), ("pixel_spacing", "00280030", "decimals"), ("image_position", "00200032", "decimals"), ("image_orientation", "00200037", "decimals"), ("slice_thickness", "00180050", "decimal")),
}
TYPES = {"uid": T.StringType(), "text": T.StringType(), "integer": T.LongType(), "decimal": T.DoubleType(), "decimals": T.ArrayType(T.DoubleType())}
SELECTED = T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("vr", T.StringType()), T.StructField("values", T.ArrayType(T.StringType()))])))
#: What went wrong: the file system, a document that isn't one, a bound, a link.
FILESYSTEM, READ, LIMIT, LINK = "filesystem", "read", "resource_limit", "symlink"
UID = re.compile(r"([01]\.([0-9]|[1-3][0-9])|2\.(0|[1-9][0-9]*))(\.(0|[1-9][0-9]*))*")
TAG = re.compile(r"[0-9A-Fa-f]{8}")


class ScanLimit(RuntimeError):
    """A bound of the scan is exceeded; the message names the option."""


@dataclass(frozen=True)
class Selector:
    """Values of one tag below a path of sequence tags (items of any number): the first, the last, or all, of which more than `most` are an error."""

    id: str
    tag: str
    path: tuple[str, ...] = ()
    occurrence: str = "last"
    most: int = 64

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}", self.id) or self.occurrence not in ("first", "last", "all") or not all(map(TAG.fullmatch, (self.tag, *self.path))) or self.most < 1:
            raise ValueError(f"not a selector: {self}")


@dataclass(frozen=True)
class Options:
    profile: tuple[str, ...] = ("core",)
    selectors: tuple[Selector, ...] = ()
    lines: bool = False
    links: str = "ignore"  # or reject, or follow (to files below the root only)
    suffixes: tuple[str, ...] = ()
    max_files: int = 100_000
    max_directories: int = 50_000
    max_depth: int = 64
    max_path_bytes: int = 4096
    max_errors: int = 1000
    max_file_bytes: int = 64 << 20  # of a document
    max_selected: int = 4096
    part_bytes: int = 32 << 20
    columns: tuple[tuple[str, str, str], ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        unknown = set(self.profile) - {*PROFILES, "none"}
        if unknown or self.links not in ("ignore", "reject", "follow") or any(getattr(self, f.name) < 0 for f in fields(self) if f.name.startswith("max_")) or len({s.id for s in self.selectors}) < len(self.selectors):
            raise ValueError(f"not the options of a scan: {self}")
        object.__setattr__(self, "columns", tuple(c for p, own in PROFILES.items() if p in self.profile for c in own))

    @classmethod
    def of(cls, given: dict[str, str]) -> Options:
        """From the texts that a reader's options are."""
        own = {k: v for k, v in ((f.name, given.get(f.name)) for f in fields(cls) if f.init) if v is not None}
        split = lambda v: tuple(x.strip() for x in v.split(",") if x.strip())
        read = {"profile": split, "suffixes": split, "links": str, "lines": lambda v: v.lower() == "true", "selectors": lambda v: tuple(Selector(**{**s, "path": tuple(s.get("path", ()))}) for s in json.loads(v))}
        return cls(**{k: read.get(k, int)(v) for k, v in own.items()})

    def schema(self) -> T.StructType:
        out = T.StructType().add("path", T.StringType()).add("offset", T.LongType()).add("error", T.StringType()).add("limit", T.StringType())
        for name, _, kind in self.columns:
            out = out.add(name, TYPES[kind])
        return out.add("missing", T.ArrayType(T.StringType())).add("invalid", T.ArrayType(T.StringType())).add("selected", SELECTED)


class _Bad(Exception):
    def __init__(self, code: str, limit: str | None = None):
        self.code, self.limit = code, limit


def _text(value: object, vr: str) -> str | None:
    if vr == "PN" and isinstance(value, dict):
        value = next((value[k] for k in ("Alphabetic", "Ideographic", "Phonetic") if value.get(k)), "")
    if value is None or isinstance(value, (dict, list)):
        return None
    return str(value).strip() if not isinstance(value, float) or not value.is_integer() else str(int(value))


def _field(element: dict, kind: str) -> object:
    """A column's value; ValueError if it isn't one of its kind."""
    texts = [_text(v, element["vr"]) for v in element.get("Value") or []]
    if kind == "text":
        return (texts[0] if texts else "") or ""
    if kind == "uid":
        uid = (texts[0] if texts else None) or ""
        if len(uid) > 64 or not UID.fullmatch(uid):
            raise ValueError
        return uid
    if kind == "integer":
        if not texts or texts[0] is None or not re.fullmatch(r"[+-]?\d+", texts[0]):
            raise ValueError
        return int(texts[0])
    if not texts or None in texts:
        raise ValueError
    numbers = [float(t) for t in texts]
    return numbers if kind == "decimals" else numbers[0]


def _walk(document: dict, path: str, tags: tuple[str, ...]) -> Iterator[tuple[str, tuple[str, ...], str, dict]]:
    """(path with items, tags of the sequences above, tag, element) of all elements, in order."""
    for tag, element in document.items():
        if not TAG.fullmatch(tag) or not isinstance(element, dict) or not isinstance(element.get("vr"), str) or not isinstance(element.get("Value", []), list):
            raise _Bad(READ)
        yield path + tag, tags, tag, element
        if element["vr"] == "SQ":
            for k, item in enumerate(element.get("Value") or []):
                if item is not None and not isinstance(item, dict):
                    raise _Bad(READ)
                yield from _walk(item or {}, f"{path}{tag}[{k}].", (*tags, tag))


def _select(document: dict, options: Options) -> dict[str, list[dict]]:
    wanted: dict[tuple, list[Selector]] = {}
    for s in options.selectors:
        wanted.setdefault((*(t.upper() for t in s.path), s.tag.upper()), []).append(s)
    found: dict[str, list[dict]] = {}
    total = 0
    for path, tags, tag, element in _walk(document, "", ()):
        for s in wanted.get((*(t.upper() for t in tags), tag.upper()), ()):
            held = found.setdefault(s.id, [])
            one = {"path": path, "vr": element["vr"], "values": [_text(v, element["vr"]) for v in element.get("Value") or []]}
            if s.occurrence == "first" and held:
                continue
            if s.occurrence == "last" and held:
                held[-1] = one
                continue
            if s.occurrence == "all" and len(held) >= s.most:
                raise _Bad(LIMIT, "selector")
            total += 1
            if total > options.max_selected:
                raise _Bad(LIMIT, "max_selected")
            held.append(one)
    return found


def record(text: str | bytes, options: Options) -> tuple:
    """(error, limit, the columns of the profiles, missing, invalid, selected) of one document."""
    try:
        if len(text) > options.max_file_bytes:
            raise _Bad(LIMIT, "max_file_bytes")
        try:
            document = json.loads(text)
        except (ValueError, RecursionError):
            raise _Bad(READ) from None
        if not isinstance(document, dict):
            raise _Bad(READ)
        selected = _select(document, options)
        document = {k.upper(): v for k, v in document.items()}
        values, missing, invalid = [], [], []
        for name, tag, kind in options.columns:
            value = None
            if tag not in document:
                missing.append(name)
            else:
                try:
                    value = _field(document[tag], kind)
                except ValueError:
                    invalid.append(name)
            values.append(value)
        return None, None, *values, missing, invalid, selected
    except _Bad as e:
        return e.code, e.limit, *([None] * (len(options.columns) + 3))


@dataclass
class Part(InputPartition):
    """Files, or pieces of them, as (path to show, path to read, first byte, byte after the last, error)."""

    pieces: list[tuple[str, str, int, int, str | None]]


def _listed(fs, root: str, options: Options) -> Iterator[tuple[str, str, int, str | None]]:
    """(path, path to read, bytes, error) of all files, folder by folder and by name."""
    from pyarrow.fs import FileSelector, FileType, LocalFileSystem

    local = isinstance(fs, LocalFileSystem)
    bounded = {"max_files": 0, "max_directories": 1}

    def count(what: str) -> None:
        bounded[what] += 1
        if bounded[what] > getattr(options, what):
            raise ScanLimit(what)

    def path_bound(path: str) -> None:
        if len(path.encode()) > options.max_path_bytes:
            raise ScanLimit("max_path_bytes")

    path_bound(root)
    top = fs.get_file_info(root)
    if top.type == FileType.File:
        count("max_files")
        yield root, root, top.size, None
        return
    if top.type != FileType.Directory:
        yield root, root, 0, FILESYSTEM
        return
    folders = [(root, 0)]
    for folder, depth in folders:
        try:
            infos = sorted(fs.get_file_info(FileSelector(folder)), key=lambda i: i.path)
        except OSError:
            yield folder, folder, 0, FILESYSTEM
            continue
        for info in infos:
            path_bound(info.path)
            link = local and _is_link(info.path)
            if info.type == FileType.Directory and not link:
                if depth + 1 > options.max_depth:
                    raise ScanLimit("max_depth")
                count("max_directories")
                folders.append((info.path, depth + 1))
                continue
            count("max_files")
            if link and options.links == "ignore" or options.suffixes and not info.path.endswith(options.suffixes):
                continue
            if link and options.links == "reject":
                yield info.path, info.path, 0, LINK
            elif link:
                target = _target(info.path, root)
                yield info.path, target or info.path, fs.get_file_info(target).size if target else 0, None if target else LINK
            elif info.type == FileType.File:
                yield info.path, info.path, info.size, None


def _is_link(path: str) -> bool:
    import os

    return os.path.islink(path)


def _target(path: str, root: str) -> str | None:
    """The regular file below the root that a link leads to."""
    import os

    target = os.path.realpath(path)
    inside = PurePosixPath(target).is_relative_to(os.path.realpath(root))
    return target if inside and os.path.isfile(target) else None


class _Reader(DataSourceReader):
    def __init__(self, path: str, options: Options):
        self.path, self.options = path, options

    def _root(self):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        return fs, root.rstrip("/") or "/"

    def partitions(self) -> list[Part]:
        fs, root = self._root()
        parts, held, size = [], [], 0
        for shown, read, length, error in _listed(fs, root, self.options):
            step = self.options.part_bytes if self.options.lines and not error else max(length, 1)
            for low in range(0, max(length, 1), step):
                high = min(low + step, length)
                if held and (size + high - low > self.options.part_bytes or len(held) >= 4096):
                    parts.append(Part(held))
                    held, size = [], 0
                held.append((shown, read, low, high, error))
                size += high - low
        return [*parts, Part(held)]

    def read(self, partition: Part) -> Iterator[tuple]:
        fs, _ = self._root()
        errors = 0
        for shown, read, low, high, error in partition.pieces:
            try:
                rows = [(low, (error, None, *([None] * (len(self.options.columns) + 3))))] if error else self._documents(fs, read, low, high)
                for offset, own in rows:
                    errors += own[0] is not None
                    if errors > self.options.max_errors:
                        raise ScanLimit("max_errors")
                    yield (shown, offset, *own)
            except OSError:
                yield (shown, low, FILESYSTEM, None, *([None] * (len(self.options.columns) + 3)))
                errors += 1

    def _documents(self, fs, path: str, low: int, high: int) -> Iterator[tuple[int, tuple]]:
        with fs.open_input_file(path) as f:
            if not self.options.lines:
                yield 0, record(f.read(self.options.max_file_bytes + 1), self.options)
                return
            f.seek(max(low - 1, 0))
            held, at = b"", max(low - 1, 0)
            skipping = low > 0  # up to the end of the line that an earlier piece has
            while at < high or held:
                block = f.read(1 << 20)
                *lines, held = (held + block).split(b"\n")
                for line in lines:
                    if skipping:
                        skipping = False
                    elif at < high and line.strip():
                        yield at, record(line, self.options)
                    at += len(line) + 1
                if at >= high:
                    return
                if not block:
                    if held.strip() and not skipping:
                        yield at, record(held, self.options)
                    return


class TaggedJson(DataSource):
    """The data source "tagged_json"; see this module."""

    @classmethod
    def name(cls) -> str:
        return "tagged_json"

    def schema(self) -> T.StructType:
        return Options.of(self.options).schema()

    def reader(self, schema: T.StructType) -> _Reader:
        path = self.options.get("path", "").strip()
        if not path:
            raise ValueError("tagged_json needs a path")
        return _Reader(path, Options.of(self.options))


def scan(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The rows of all documents below path, read once and kept; ScanLimit if more than `max_errors` of them are errors."""
    spark.dataSource.register(TaggedJson)
    text = lambda v: v if isinstance(v, str) else json.dumps([{f.name: getattr(s, f.name) for f in fields(s)} for s in v]) if v and not isinstance(v, (bool, int)) and isinstance(v[0], Selector) else ",".join(v) if isinstance(v, (list, tuple)) else str(v)
    given = {k: text(v) for k, v in options.items()}
    rows = checkpointed(spark.read.format("tagged_json").options(**given).load(path))
    most = Options.of(given).max_errors
    if rows.where("error IS NOT NULL").count() > most:
        raise ScanLimit("max_errors")
    return rows


def documents(texts: DataFrame, path: str, text: str, options: Options) -> DataFrame:
    """The same rows of documents that Spark has read: one row of texts is one document. A null text is an error."""
    schema = options.schema()

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows = [(p, 0, *(record(t, options) if t is not None else (READ, None, *([None] * (len(options.columns) + 3))))) for p, t in zip(*(c.to_pylist() for c in batch.slice(low, 500).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in column], f.type) for column, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return texts.select(F.col(path).cast("string"), F.col(text).cast("binary")).mapInArrow(run, schema)
