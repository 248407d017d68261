"""Files that tasks write and read themselves, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from tessera.session import shared_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's URI under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


@contextlib.contextmanager
def written(uri: str) -> Iterator[BinaryIO]:
    """A file that appears under its name only when complete, so that a repeated or speculative task does no harm."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    try:
        with system.open_output_stream(draft) as out:
            yield out
        system.move(draft, path)
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(draft)
        raise


def opened(uri: str):
    """A file for random access."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def streamed(uri: str):
    """A file for reading from its beginning."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None)
