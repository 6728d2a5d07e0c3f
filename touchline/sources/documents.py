"""A sink that leaves whole documents: one valid file for each output path, at that path, or nothing.

Rows (output, at, value) become files: a file's lines are its rows' values in the order of at. Each task writes its documents to a folder of the job's beside the outputs; when all tasks have ended, they are moved to
their places, and when the job fails, they go. So a failed or repeated task leaves nothing behind, and no reader sees half a document. Paths may be of any file system that Arrow opens.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .package import ship


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _folder(path: str, job: str) -> str:
    """Where a job's documents for a path wait: a folder of its own beside it."""
    head, _, _ = path.rpartition("/")
    return f"{head}/.touchline-{job}" if head else f".touchline-{job}"


@dataclass
class Written(WriterCommitMessage):
    """(waiting file, output) of a task's documents."""

    moves: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, job: str):
        self.job = job

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        moves: list[tuple[str, str]] = []
        out, current = None, None
        try:
            for b in batches:
                for output, value in zip(b.column("output").to_pylist(), b.column("value").to_pylist(), strict=True):
                    if output != current:
                        if out:
                            out.close()
                        place, path = _place(output)
                        folder = _folder(path, self.job)
                        place.create_dir(folder, recursive=True)
                        waiting = f"{folder}/{uuid.uuid4().hex}"
                        out, current = place.open_output_stream(waiting), output
                        moves.append((waiting, output))
                    out.write(value.encode() + b"\n")
            if out:
                out.close()
        except BaseException:
            if out:
                with contextlib.suppress(Exception):
                    out.close()
            for waiting, output in moves:
                place, path = _place(output)
                with contextlib.suppress(Exception):
                    place.delete_file(waiting)
                    if not place.get_file_info(fs.FileSelector(_folder(path, self.job))):
                        place.delete_dir(_folder(path, self.job))
            raise
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for w in messages if w for m in w.moves]
        for waiting, output in done:
            place, path = _place(output)
            place.move(waiting, path)
        self._clear(done)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear([m for w in messages if w for m in w.moves])

    def _clear(self, moves: list[tuple[str, str]]) -> None:
        """The waiting folders go, with what lost tasks may have left in them."""
        for place, path in {(_place(o)[0].type_name, _folder(_place(o)[1], self.job)): (_place(o)[0], _folder(_place(o)[1], self.job)) for _, o in moves}.values():
            with contextlib.suppress(Exception):
                place.delete_dir(path)


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "touchline_documents"

    def schema(self) -> str:
        return "output string, at long, value string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["job"])


def write(rows: DataFrame) -> None:
    """rows: output, at, value. A document is one task's; rows whose output is null go nowhere. A document that is there already is replaced."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(Documents)
    dealt = rows.filter(F.col("output").isNotNull()).select("output", F.col("at").cast("long").alias("at"), "value").repartition("output").sortWithinPartitions("output", "at")
    dealt.write.format(Documents.name()).option("job", uuid.uuid4().hex).mode("append").save()
