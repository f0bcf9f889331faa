"""Scenes as folders of array files, images and settings: a Spark data source and sink, `array_scenes`.

    spark.dataSource.register(ArrayScenes)
    rows.write.format("array_scenes").mode("append").save(path)
    spark.read.format("array_scenes").option("bands", "mask,delta_down_m").option("from", 512).load(path)

A scene is a folder with `arrays.npz`, `metadata.json` and any images; in exports, a file `arrays/name.npz` with its
`metadata/name.json` beside. Reading gives a row for every `rows` lines of a
scene with the named bands only; of bands that are stored without compression only the bytes of those lines are read.
With `images` (names by commas), `name_png` are the bytes values of the same lines of the image `name.png` beside, channels innermost; null
where there is no readable image of as many pixels. The options `scenes` (names by commas), `from` and `to` (lines) keep files and lines from being read at all. (Spark 4.1 keeps
filters that are pushed into a Python source for later queries over the same DataFrame, so they are not used.) Writing puts each scene into a folder
of its own job, which is renamed when all tasks have ended; what a failed task or job leaves is never read."""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridloom.sources.files import png
from gridloom.sources.images import decoded_png

ROWS, WHOLE = 1024, 1 << 26  # lines to a row; bytes of a file that one task reads whole
FILES, SMALL, BATCH = 512, 1 << 20, 1 << 22  # files to a task; bytes of a file that is read at once; bytes of values handed on at once
HIDDEN = ("_", ".")
ARRAYS, METADATA = "arrays.npz", "metadata.json"


def spark_type(band: str) -> str:
    """Fixed rule of the format: names that end in mask are bytes, all others 32-bit floats."""
    return "tinyint" if band.endswith("mask") else "float"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _scenes(path: str) -> list[tuple[str, str, str, int]]:
    """(scene, array file, metadata file, size) below a path."""
    store, root = opened(path)
    out, top = [], []

    def add(infos) -> None:
        for info in infos:
            if info.type != fs.FileType.File or info.extension != "npz":
                continue
            parts = info.path.removeprefix(root).strip("/").split("/")
            if any(p.startswith(HIDDEN) for p in parts):
                continue
            if info.base_name == ARRAYS and len(parts) > 1:
                out.append((parts[-2], info.path, info.path.removesuffix(ARRAYS) + METADATA, info.size))
            else:
                stem = info.base_name.removesuffix(".npz")
                out.append((stem, info.path, f"{info.path.rsplit('/', 2)[0]}/metadata/{stem}.json", info.size))

    for info in store.get_file_info(fs.FileSelector(root)):  # a folder at a time: the list of all files may be long
        if info.type == fs.FileType.Directory:
            if not info.base_name.startswith(HIDDEN):
                add(store.get_file_info(fs.FileSelector(info.path, recursive=True)))
        else:
            top.append(info)
    add(top)
    return sorted(out)


@lru_cache(1 << 12)
def _header(data: bytes) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type that the header of an array tells."""
    file = io.BytesIO(data)
    version = np.lib.format.read_magic(file)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if fortran or kind.hasobject:
        raise ValueError("an array is not in row order")
    return shape, kind


def _read_header(read) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and length of the header at the start of an array; `read` gives the next n bytes."""
    start = read(8)
    length = read(2 if start[6:7] == b"\1" else 4)
    data = start + length + read(int.from_bytes(length, "little"))
    return *_header(data), len(data)


class Bands:
    """The bands of one array file, read by lines through a seekable file."""

    def __init__(self, file):
        self.file, self.zip = file, zipfile.ZipFile(file)
        self.names = [n.removesuffix(".npy") for n in self.zip.namelist()]
        self.heads: dict[str, tuple[tuple[int, ...], np.dtype, int, int]] = {}

    def _head(self, band: str) -> tuple[tuple[int, ...], np.dtype, int, int]:
        """As head(), and where the array starts in the file."""
        if band not in self.heads:
            info, start = self.zip.getinfo(band + ".npy"), 0
            try:
                if info.compress_type == zipfile.ZIP_STORED:
                    self.file.seek(info.header_offset)
                    local = self.file.read(30)
                    if local[:4] != b"PK\3\4":
                        raise zipfile.BadZipFile(f"no entry for band {band}")
                    names, extra = struct.unpack("<26xHH", local)
                    start = info.header_offset + 30 + names + extra
                    self.file.seek(start)
                    self.heads[band] = *_read_header(self.file.read), start
                else:
                    with self.zip.open(info) as f:
                        self.heads[band] = *_read_header(f.read), start
            except ValueError as error:
                raise ValueError(f"band {band}: {error}") from error
        return self.heads[band]

    def head(self, band: str) -> tuple[tuple[int, ...], np.dtype, int]:
        """Shape, type and length of the header; nothing of the values is read."""
        return self._head(band)[:3]

    def lines(self, band: str, a: int, b: int) -> np.ndarray:
        """Lines a to b of a band of two axes."""
        shape, kind, head, start = self._head(band)
        if len(shape) != 2:
            raise ValueError(f"band {band} has {len(shape)} axes")
        b, line = min(b, shape[0]), shape[1] * kind.itemsize
        info = self.zip.getinfo(band + ".npy")
        if info.compress_type == zipfile.ZIP_STORED:
            self.file.seek(start + head + a * line)
            raw = self.file.read((b - a) * line)
        else:  # from its start, a megabyte at a time
            with self.zip.open(info) as f:
                left = head + a * line
                while left:
                    left -= len(f.read(min(left, 1 << 20)))
                raw = f.read((b - a) * line)
        return np.frombuffer(raw, kind).reshape(b - a, shape[1])


def _image(store: fs.FileSystem, path: str) -> np.ndarray | None:
    """The values of an image in one row; None if there is none or it can't be read."""
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    try:
        with store.open_input_file(path) as f:
            return decoded_png(f.read()).ravel()
    except (ValueError, struct.error, zlib.error):
        return None


def _lists(values: list[np.ndarray | None], kind: np.dtype) -> pa.Array:
    """A list a row, null for None."""
    ends = np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in values])]).astype(np.int32)
    flat = [v for v in values if v is not None]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.empty(0, kind)), mask=pa.array([v is None for v in values]))


@dataclass
class Part(InputPartition):
    """Lines of some scenes: (scene, array file, metadata file, first, end); end None for all."""

    files: list[tuple[str, str, str, int, int | None]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bands, self.rows = options["path"], _names(options, "bands"), int(options.get("rows", ROWS))
        self.images = _names(options, "images")
        self.scenes = set(_names(options, "scenes")) or None
        self.first, self.last = int(options.get("from", 0)), int(options.get("to", 1 << 62))

    def partitions(self) -> list[Part]:
        store, _ = opened(self.path)
        out, batch, size = [], [], 0
        for scene, file, metadata, bytes_ in _scenes(self.path):
            if self.scenes is not None and scene not in self.scenes:
                continue
            if bytes_ > WHOLE:  # a task for each range of lines
                with store.open_input_file(file) as f:
                    bands = Bands(f)
                    height = next((bands.head(b)[0][0] for b in self.bands or bands.names if b in bands.names), 0)
                out += [Part([(scene, file, metadata, a, min(a + self.rows, height, self.last))]) for a in range(self.first, min(height, self.last), self.rows)]
                continue
            batch.append((scene, file, metadata, self.first, None))
            size += bytes_
            if size > WHOLE or len(batch) == FILES:
                out.append(Part(batch))
                batch, size = [], 0
        return out + ([Part(batch)] if batch else []) or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self._rows(part):
            rows.append(row)
            size += sum(v.nbytes for v in row[-1] if v is not None)
            if size > BATCH:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        *told, values = zip(*rows)
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
        columns = [pa.array(c, k) for c, k in zip(told, kinds)]
        types = [np.dtype("i1" if b.endswith("mask") else "f4") for b in self.bands] + [np.dtype("i4")] * len(self.images)
        columns += map(_lists, map(list, zip(*values)), types)
        return pa.RecordBatch.from_arrays(columns, ["scene", "first_row", "height", "width", "metadata", "kinds", *self.bands, *(f"{n}_png" for n in self.images)])

    def _rows(self, part: Part) -> Iterator[tuple]:
        """scene, first_row, height, width, metadata, kinds as pairs, and the values of bands and images."""
        store, _ = opened(self.path)
        for scene, path, beside, a, b in part.files:
            metadata = None
            if store.get_file_info(beside).type == fs.FileType.File:
                with store.open_input_file(beside) as f:
                    metadata = f.read().decode()
            with store.open_input_file(path) as f:
                bands = Bands(io.BytesIO(f.read()) if f.size() <= SMALL else f)
                heads = {n: bands.head(n) for n in self.bands if n in bands.names}
                shape = next((s for s, _, _ in heads.values()), (0, 0))
                kinds = [(n, f"{k.name}:{'x'.join(map(str, s))}") for n, (s, k, _) in heads.items()]
                stop = min(shape[0], self.last) if b is None else b
                images = [_image(store, f"{path.rsplit('/', 1)[0]}/{n}.png") for n in self.images] if a < stop else []
                pixels = int(np.prod(shape[:2]))
                images = [None if v is None or not pixels or len(v) % pixels else v.astype("i4").reshape(shape[0], -1) for v in images]
                for first in range(a, stop, self.rows):
                    end = min(first + self.rows, stop)
                    values = [bands.lines(n, first, end).astype("i1" if n.endswith("mask") else "f4").ravel() if n in heads else None for n in self.bands]
                    yield (scene, first, *shape[:2], metadata, kinds, values + [None if v is None else v[first:end].ravel() for v in images])


@dataclass
class Written(WriterCommitMessage):
    folders: list[tuple[str, str]]


@lru_cache(1 << 8)
def _array_head(kind: str, shape: tuple[int, int]) -> bytes:
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(np.broadcast_to(np.zeros((), kind), shape)) | {"fortran_order": False})
    return head.getvalue()


def _packed(bands: dict[str, np.ndarray], compressed: bool) -> bytes:
    """An array file, as numpy writes it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED) as z:
        for name, a in bands.items():
            z.writestr(name + ".npy", _array_head(a.dtype.str, a.shape) + a.tobytes())
    return out.getvalue()


class _Writer(DataSourceArrowWriter):
    """Rows (scene, height, width, metadata (JSON or null), bands as arrays, .._png as arrays of bytes values 0 to 255) -> a folder a row."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], schema.fieldNames(), overwrite
        self.compressed, self.job = options.get("compressed", "false").lower() == "true", uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = opened(self.path)
        task, done = TaskContext.get(), []
        base = f"{root}/_job-{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        for batch in batches:
            told = {n: batch.column(n).to_pylist() for n in ("scene", "height", "width", "metadata") if n in self.names}
            columns = {n: batch.column(n) for n in self.names if n not in told}
            for i in range(len(batch)):
                scene, shape = str(told["scene"][i]), (told["height"][i], told["width"][i])
                if not scene or "/" in scene or scene.startswith(HIDDEN):
                    raise ValueError(f"not a folder's name: {scene}")
                if not self.overwrite and store.get_file_info(f"{root}/{scene}").type != fs.FileType.NotFound:
                    raise FileExistsError(f"{scene} is there already")
                folder = f"{base}/{scene}"
                store.create_dir(folder, recursive=True)
                bands, images = {}, {}
                for name, column in columns.items():
                    if not column[i].is_valid:
                        continue
                    a = column[i].values.to_numpy(zero_copy_only=False)  # null floats are NaN
                    if name.endswith(("_png", "mask")) and len(a) and not 0 <= a.min() <= a.max() <= 255:
                        raise ValueError(f"{name} of {scene} has values that are no bytes")
                    if name.endswith("_png"):
                        a = a.astype(np.uint8)
                        images[name.removesuffix("_png") + ".png"] = png(a.reshape(*shape, -1) if a.size != shape[0] * shape[1] else a.reshape(shape))
                    else:
                        bands[name] = a.astype("u1" if name.endswith("mask") else "f4").reshape(shape)
                metadata = (told["metadata"][i] if "metadata" in told else None) or "{}"
                for name, data in {**images, METADATA: metadata.encode(), ARRAYS: _packed(bands, self.compressed)}.items():
                    with store.open_output_stream(f"{folder}/{name}") as f:
                        f.write(data)
                done.append((folder, f"{root}/{scene}"))
        return Written(done)

    def commit(self, messages) -> None:
        store, root = opened(self.path)
        moves = [move for m in messages if m for move in m.folders]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("several rows of one scene")
        for at, to in moves:
            if self.overwrite and store.get_file_info(to).type != fs.FileType.NotFound:
                store.delete_dir(to)
            store.move(at, to)
        self._clear(store, root)

    def abort(self, messages) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/_job-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_job-{self.job}")


def _names(options: dict, name: str) -> list[str]:
    return [b.strip() for b in options.get(name, "").split(",") if b.strip()]


class ArrayScenes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_scenes"

    def schema(self) -> str:
        bands = "".join(f", `{b}` array<{spark_type(b)}>" for b in _names(self.options, "bands"))
        images = "".join(f", `{n}_png` array<int>" for n in _names(self.options, "images"))
        return "scene string, first_row int, height int, width int, metadata string, kinds map<string,string>" + bands + images

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayScenes)


def read_scenes(spark: SparkSession, path: str, *bands: str, rows: int = ROWS, scenes: tuple[str, ...] = (), lines: tuple[int, int] | None = None, images: tuple[str, ...] = ()):
    """Scenes below path: scene, first_row, height, width, metadata, kinds (type and shape by band), and the named bands; of
    the named scenes (all, if none) and the lines from .. to only; with `name_png` of the named images."""
    register(spark)
    reader = spark.read.format("array_scenes").option("bands", ",".join(bands)).option("rows", rows).option("scenes", ",".join(scenes)).option("images", ",".join(images))
    return (reader.option("from", lines[0]).option("to", lines[1]) if lines else reader).load(path)


def write_scenes(rows, path: str, overwrite: bool = False, compressed: bool = False) -> None:
    """One folder a row; scenes that are there already fail the job unless overwrite is set."""
    register(rows.sparkSession)
    rows.write.format("array_scenes").mode("overwrite" if overwrite else "append").option("compressed", compressed).save(path)
