"""Binary files in the shared folder, written and read by executors."""

from __future__ import annotations

import pyarrow.fs
from pyspark import TaskContext


def opened(folder: str):
    """The file system of a folder's URI and the folder's path in it."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or ":/" in folder else f"file://{folder}")
    return fs, path.rstrip("/")


def own_name(prefix: str, number: int, suffix: str) -> str:
    """A file name that no other task attempt uses: what a failed attempt leaves is never read."""
    task = TaskContext.get()
    return f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId():09d}-{number:04d}{suffix}"
