"""Text sinks for transcript lines (``rec, pos, line``), in order within each recording."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from turnweave.sources.storage import file_system

FORMAT = "transcript_files"


@dataclass
class Written(WriterCommitMessage):
    files: int


class TranscriptFiles(DataSource):
    """A file ``STEM.txt`` per recording in the folder ``path``, from rows (rec, line) in order; a null line leaves the file
    as it is, so a recording with no other line gets an empty one."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceWriter):
    """Tasks write whole files next to the folder; the driver puts them in its place at once, by renaming.

    A file gets its name once it is complete, so attempts of a task that fail, run twice or are lost leave no part of one.
    The file system must be able to rename folders, as local and shared disks and HDFS are.
    """

    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        mark = uuid.uuid4().hex
        self.staged, self.unfinished = f"{self.folder}.staged-{mark}", f"{self.folder}.unfinished-{mark}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, staged = file_system(self.staged)
        _, unfinished = file_system(self.unfinished)
        for folder in (staged, unfinished):
            files.create_dir(folder, recursive=True)
        rec, out, part, n = None, None, "", 0

        def finish() -> None:
            if out is not None:
                out.close()
                files.move(part, f"{staged}/{rec}.txt")

        for row in iterator:
            if out is None or row["rec"] != rec:
                finish()
                if not row["rec"] or "/" in row["rec"]:
                    raise ValueError(f"a recording named {row['rec']!r} has no file name")
                rec, part, n = row["rec"], f"{unfinished}/{uuid.uuid4().hex}", n + 1
                out = files.open_output_stream(part)
            if row["line"] is not None:
                out.write(f"{row['line']}\n".encode())
        finish()
        return Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, staged = file_system(self.staged)
        _, folder = file_system(self.folder)
        before = f"{folder}.before-{uuid.uuid4().hex}"
        files.create_dir(staged, recursive=True)  # there is none without recordings
        exists = files.get_file_info(folder).type.name == "Directory"
        if exists and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{folder} is there already")
        if exists:
            files.move(folder, before)
        files.move(staged, folder)
        if exists:
            files.delete_dir(before)
        self._drop(self.unfinished)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop(self.staged)
        self._drop(self.unfinished)

    def _drop(self, folder: str) -> None:
        files, path = file_system(folder)
        if files.get_file_info(path).type.name == "Directory":
            files.delete_dir(path)


def write_files(lines: DataFrame, folder: str, recordings: DataFrame | None = None) -> None:
    """``STEM.txt`` per recording in the folder, which is replaced as a whole; all files are written by executors.

    With ``recordings`` (``rec``), those without lines get an empty file. Recordings are dealt by ``rec``: one file is
    written by one task, whatever else that task writes. If the job fails, the folder is as it was.
    """
    rows = lines.select("rec", F.col("pos").cast("bigint").alias("pos"), "line")
    if recordings is not None:
        rows = rows.union(recordings.select("rec", F.lit(None).cast("bigint"), F.lit(None).cast("string")).distinct())
    lines.sparkSession.dataSource.register(TranscriptFiles)
    ordered = rows.repartition("rec").sortWithinPartitions("rec", "pos")  # nulls come first
    ordered.select("rec", "line").write.format(FORMAT).mode("overwrite").option("path", folder).save()


def write_single(lines: DataFrame, path: str) -> None:
    """One file at a path of the driver, replaced when all is written; rows stream from the executors in order."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    ordered = lines.orderBy("rec", "pos").select("line")
    unfinished = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(unfinished, "w", encoding="utf-8", newline="\n") as out:
            for row in ordered.toLocalIterator():
                out.write(f"{row.line}\n")
        os.replace(unfinished, path)
    finally:
        if os.path.exists(unfinished):
            os.remove(unfinished)
