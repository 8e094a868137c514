"""Answers that outlive their job: a file for each batch, written by the task that has its answer.

A job returns nothing until all its tasks have ended, and answers are paid for.
So the task that calls a service commits each batch when it is answered: the
file is written under another name and moved, and it is named by the batch, so a
batch that is answered again, by a retry or a second attempt of the task,
replaces itself. Whatever ends the job, ``memory.Workspace.recover`` takes what
is there into the memory. Results of jobs that end well get there at once, and
their files go, so there are never more files than a wave has batches.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq

from glossaflow.sources import store

_KIND = pa.schema([(c, pa.string()) for c in ("segment_id", "source_hash", "config_hash", "draft_text", "revise_text", "provider")] + [("updated_at", pa.timestamp("us", "UTC"))])


class ResultLog:
    def __init__(self, path: str):
        self.path = path

    def commit(self, batch_key: str, rows: list[dict]) -> None:
        """Keeps the rows of a batch (those of the memory without their time)."""
        if not rows:
            return
        fs, folder = store.opened(self.path)
        fs.create_dir(folder, recursive=True)
        now = datetime.now(timezone.utc)
        part, whole = f"{folder}/_{uuid.uuid4().hex}", f"{folder}/{hashlib.sha256(batch_key.encode()).hexdigest()[:32]}.parquet"
        pq.write_table(pa.Table.from_pylist([{**r, "updated_at": now} for r in rows], _KIND), part, filesystem=fs)
        fs.move(part, whole)

    def files(self) -> list[str]:
        """What is committed; the path may be a pattern."""
        try:
            return [f.path for f in store.listed(f"{self.path}/*.parquet")]
        except FileNotFoundError:
            return []

    @staticmethod
    def drop(files: list[str]) -> None:
        for f in files:
            fs, inner = store.opened(f)
            fs.delete_file(inner)

    def clear(self) -> None:
        store.drop(self.path)
