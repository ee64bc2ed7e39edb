"""A sink that writes whole files by name, with nothing left over when a task or the job fails.

Spark's own writers give folders of part files. Here rows (name, content, and place if names may repeat) become the files called
name below a folder. A task writes below a temporary folder of its own; its commit message says what it wrote. The commit moves
the files to their names, and commit and abort both delete everything temporary, also what lost executors left. A task that goes
on after the job has ended sees that its mark is gone and takes back what it wrote. The folder can be in any store that pyarrow's
file systems reach.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.shipping import ship
from ..functions.tables import release


@dataclass
class Wrote(WriterCommitMessage):
    """(name, place, temporary path) of each file of a task."""

    files: list[tuple[str, int, str]]


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


class _Gzipped(io.BufferedWriter):
    """Writes to a stream through gzip, many short rows at a time."""

    def __init__(self, plain: pa.NativeFile) -> None:
        super().__init__(gzip.GzipFile(fileobj=plain, mode="wb", compresslevel=1, mtime=0), 1 << 17)
        self.plain = plain

    def close(self) -> None:
        super().close()
        self.plain.close()


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.head = options["folder"], options.get("head", "").encode()
        self.whole, self.gzip, self.job = options.get("whole") == "true", options.get("gzip") == "true", uuid.uuid4().hex

    def _temporary(self, root: str) -> str:
        return f"{root}/_temporary-{self.job}"

    def _mark(self, root: str) -> str:
        return f"{self._temporary(root)}/open"

    def _opened(self, store: fs.FileSystem, path: str) -> io.BufferedIOBase | pa.NativeFile:
        plain = store.open_output_stream(path, compression=None)
        return _Gzipped(plain) if self.gzip else plain

    def begin(self) -> NamedFilesWriter:
        store, root = _store(self.folder)
        store.create_dir(self._temporary(root))
        store.open_output_stream(self._mark(root)).close()
        return self

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        store, root = _store(self.folder)
        own, files, now, out = f"{self._temporary(root)}/{uuid.uuid4().hex}", [], None, None
        try:
            for batch in iterator:
                places = batch.column("place").to_pylist() if "place" in batch.schema.names else [0] * batch.num_rows
                for name, content, place in zip(batch.column("name").to_pylist(), batch.column("content"), places):
                    if self.whole or name != now:
                        if out:
                            out.close()
                        if not files:
                            store.create_dir(own)
                        files.append((name, place or 0, f"{own}/{len(files)}"))
                        now, out = name, self._opened(store, files[-1][2])
                        out.write(self.head)
                    data = content.as_py()
                    out.write(data.encode() if isinstance(data, str) else data or b"")
            if out:
                out.close()
            if files and store.get_file_info(self._mark(root)).type != fs.FileType.File:
                raise RuntimeError("the job that this task belongs to has ended")
        except BaseException:
            if files:
                store.delete_dir(own)
                if store.get_file_info(self._mark(root)).type != fs.FileType.File:
                    self._clear(store, root)
            raise
        return Wrote(files)

    def commit(self, messages: list[Wrote | None]) -> None:
        store, root = _store(self.folder)
        store.create_dir(root)
        last = {}
        for name, place, path in sorted(f for m in messages if m for f in m.files):
            last[name] = path  # of equal names the largest place
        for name, path in last.items():
            target = f"{root}/{name}"
            if "/" in name:
                store.create_dir(target.rpartition("/")[0])
            store.move(path, target)
        self._clear(store, root)

    def abort(self, messages: list[Wrote | None]) -> None:
        self._clear(*_store(self.folder))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(self._mark(root)).type == fs.FileType.File:
            store.delete_file(self._mark(root))
        if store.get_file_info(self._temporary(root)).type == fs.FileType.Directory:
            store.delete_dir(self._temporary(root))


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options).begin()


def write_named(rows: DataFrame, folder: str, **options: str) -> None:
    """Rows of name, content (text or bytes) and maybe place, as they are dealt: rows of one name that follow each other are one file,
    which head begins. With whole=true each row is a file, and of equal names the largest place stays. With gzip=true files are
    compressed. Shuffle files that only the write needed are let go."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(NamedFiles)
    rows.write.format("named_files").option("folder", folder).options(**options).mode("append").save()
    release(spark)


def file_name(value: Column, end: str = "") -> Column:
    """A name of value without characters that file systems forbid; where some went, a checksum keeps different values apart."""
    safe = F.regexp_replace(value, r'[<>:"/\\|?*\x00-\x1F]', "_")
    return F.concat(F.when(safe == value, safe).otherwise(F.concat(safe, F.lit("-"), F.lower(F.hex(F.crc32(value))))), F.lit(end))
