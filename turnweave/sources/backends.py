"""Speech tools, which stay outside: where to find one, and how to run it over recordings.

The engine's boundary is the JSON that a tool leaves; ``JsonFolder`` reads what is there already. ``ExternalTool`` runs
a command per recording on the executors. Credentials go by the environment, never on a command line.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
import tempfile
import threading
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from itertools import islice
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.sources.documents import raw_documents
from turnweave.sources.storage import count_files, file_system, is_file, put, shared_folder

#: The model of both tools; the settings of the transcription, which keep it from inventing repeated text
#: in silence; the tools' names; where the first may be besides PATH.
MODEL = "mlx-community/whisper-large-v3-turbo"
TRANSCRIPTION_OPTIONS = ("--condition-on-previous-text", "False", "--hallucination-silence-threshold", "1", "-f", "json")
SPEECH_TOOL, SPEAKER_TOOL = "mlx_whisper", "whispermlx"
SPEECH_TOOL_PATH = "~/Library/Python/3.9/bin/mlx_whisper"
#: Tasks over which an external tool's recordings are spread at most.
TASKS = 1000
#: Recordings whose contents one job reads, where only Spark can open their paths.
CONTENTS = 10_000


class Backend(Protocol):
    def documents(self, spark: SparkSession, recordings: DataFrame) -> DataFrame:
        """``rec, json`` for the recordings ``rec, path``."""


def find_tool(name: str, known: Iterable[str] = ()) -> str:
    """The first known path that is a file, else the tool on PATH."""
    for path in map(os.path.expanduser, known):
        if os.path.isfile(path):
            return path
    if found := shutil.which(name):
        return found
    raise FileNotFoundError(f"{name} is neither at a known path nor on PATH")


@dataclass
class JsonFolder:
    """Documents that a tool has left, named after their recordings, or in folders ``rec=NAME``."""

    folder: str
    by_folder: bool = False

    def documents(self, spark: SparkSession, recordings: DataFrame) -> DataFrame:
        return raw_documents(spark, self.folder, self.by_folder).join(recordings.select("rec"), "rec", "left_semi")


def _key(recordings: DataFrame):
    """What tells a recording from others and from itself once it has changed: name, path and, if known, size and time."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("rec", "path", "length", "modificationTime") if c in recordings.columns]
    return F.sha2(F.concat_ws("\0", *parts), 256)


@dataclass
class ExternalTool:
    """A command that writes ``STEM.json`` into the folder after ``folder_option``; a failure stops the job.

    Each document is kept as soon as its tool has ended, as ``results/OPTIONS/RECORDING.json``, both by digest. A later run
    with the same folder ``results`` runs the tool for what is missing only: after a failure, for new or changed
    recordings, or with other options. Without ``results`` a new folder is used, and the tool runs once per recording,
    whatever reads the documents and however often.

    Recordings on the executors' own or shared disks are handed over by path. Others are read by Spark, a file a row in
    partitions of ``spark.sql.files.maxPartitionBytes`` or one file, and are a file in the task's scratch folder while the
    tool runs; they can be as large as a Spark row, 2 GB.

    ``progress`` is called on the driver every ``progress_seconds``, and once after the last tool, with the number of
    recordings finished in this run, counted by their documents and so exact whatever tasks are lost or run again.
    """

    command: str
    options: tuple[str, ...] = ()
    folder_option: str = "-o"
    environment: dict[str, str] = field(default_factory=dict)
    results: str | None = None
    progress: Callable[[int], None] | None = None
    progress_seconds: float = 30.0

    def documents(self, spark: SparkSession, recordings: DataFrame) -> DataFrame:
        told = hashlib.sha256("\0".join([self.command, *self.options, self.folder_option]).encode()).hexdigest()
        folder = f"{self.results or shared_folder(spark)}/{told}"
        files, path = file_system(folder)
        files.create_dir(path, recursive=True)
        named = recordings.select("rec", "path", _key(recordings).alias("key"))
        run = replace(self, progress=None)._run(folder)  # tasks need no callback of the driver
        with self._telling(folder):
            for missing in self._missing(named, folder):
                # the last action on what is missing; a task that runs again skips what its first attempt has kept
                missing.mapInArrow(run, "kept boolean").write.format("noop").mode("overwrite").save()
        kept = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", "^([0-9a-f]+)", 1).alias("key"), F.col("value").alias("json"))
        return named.join(kept, "key").select("rec", "json")

    @contextmanager
    def _telling(self, folder: str) -> Iterator[None]:
        """Calls ``progress`` while the block runs, and after it even if it fails."""
        if self.progress is None:
            yield
            return
        before, ended = count_files(folder, ".json"), threading.Event()

        def watch() -> None:
            while not ended.wait(self.progress_seconds):
                self.progress(count_files(folder, ".json") - before)

        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            ended.set()
            watcher.join()
            self.progress(count_files(folder, ".json") - before)

    def _missing(self, named: DataFrame, folder: str) -> Iterator[DataFrame]:
        """``rec, path, key, content`` of recordings without a document; content is null where a path will do."""

        def lacking(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not is_file(f"{folder}/{key}.json") for key in batch.column(2).to_pylist()], pa.bool_()))

        local = ~F.col("path").contains("://") | F.col("path").startswith("file:")
        apart = named.repartitionByRange(TASKS, "rec")
        yield apart.where(local).withColumn("content", F.lit(None).cast("binary"))
        remote = apart.where(~local).mapInArrow(lacking, "rec string, path string, key string").toLocalIterator()
        spark = named.sparkSession
        while some := [tuple(r) for r in islice(remote, CONTENTS)]:
            listed = spark.createDataFrame(some, "rec string, path string, key string")
            contents = spark.read.format("binaryFile").load([p for _, p, _ in some]).select(F.col("path").alias("read"), "content")
            # a few thousand names, CONTENTS at most, meet the files where they are read
            yield contents.join(F.broadcast(listed), F.col("read") == F.col("path")).select("rec", "path", "key", "content")

    def _run(self, folder: str):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    rec, path, key = (batch.column(c)[n].as_py() for c in range(3))
                    if not is_file(f"{folder}/{key}.json"):
                        put(f"{folder}/{key}.json", self._document(rec, path, batch.column(3)[n]))
                    yield pa.RecordBatch.from_arrays([pa.array([True])], names=["kept"])

        return run

    def _document(self, rec: str, path: str, content: pa.Scalar) -> bytes:
        with tempfile.TemporaryDirectory() as scratch:
            local = path.removeprefix("file:").replace("///", "/", 1)
            if content.is_valid:
                local = os.path.join(scratch, f"{rec}{os.path.splitext(path)[1]}")
                with open(local, "wb") as out:
                    out.write(content.as_buffer())
            left = os.path.join(scratch, "documents")
            os.mkdir(left)
            subprocess.run([self.command, *self.options, self.folder_option, left, local], check=True, capture_output=True, env=os.environ | self.environment)
            with open(os.path.join(left, f"{rec}.json"), "rb") as found:
                return found.read()


def speech_tool(results: str | None = None) -> ExternalTool:
    return ExternalTool(find_tool(SPEECH_TOOL, [SPEECH_TOOL_PATH]), ("--model", MODEL, *TRANSCRIPTION_OPTIONS), results=results)


def speaker_tool(token: str, results: str | None = None) -> ExternalTool:
    return ExternalTool(find_tool(SPEAKER_TOOL), ("--model", MODEL, "--diarize"), "--output_dir", {"HF_TOKEN": token}, results)
