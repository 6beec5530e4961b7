"""The folder that the driver and all executors share, and what tasks write there themselves."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="turnweave-shared-")
    return f"{root}/{uuid.uuid4()}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it; for tasks, which have no access to Spark's own."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def put(path: str, content: bytes) -> None:
    """Write a file that is there whole or not at all."""
    files, to = file_system(path)
    part = f"{to.rpartition('/')[0]}/_unfinished-{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(content)
    files.move(part, to)


def is_file(path: str) -> bool:
    files, at = file_system(path)
    return files.get_file_info(at).type == fs.FileType.File


def count_files(folder: str, suffix: str) -> int:
    files, at = file_system(folder)
    return sum(f.type == fs.FileType.File and f.path.endswith(suffix) for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)))
