"""Small files that say which folders count: written last, and seen whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession


def publish(spark: SparkSession, folder: str, name: str, lines: Iterable[Mapping]) -> None:
    """Write ``lines`` as the file ``name`` of a folder, one JSON object a line.

    The file is built under a hidden name, which readers pass over, and then renamed. A name that
    is taken already raises: what is published never changes.
    """
    fs, path = _place(spark, folder)
    hidden = _path(spark, f"{folder}/.{uuid.uuid4().hex}")
    fs.mkdirs(path)
    out = fs.create(hidden, False)
    try:
        out.write(bytearray("".join(json.dumps(dict(line), default=str) + "\n" for line in lines).encode()))
    finally:
        out.close()
    if not fs.rename(hidden, _path(spark, f"{folder}/{name}.json")):
        fs.delete(hidden, False)
        raise FileExistsError(f"{folder}/{name}.json cannot be published")


def published(spark: SparkSession, folder: str) -> list[dict]:
    """All lines of all files of a folder, in order of the files' names; for folders of few files."""
    fs, path = _place(spark, folder)
    if not fs.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    lines: list[dict] = []
    for name in names:
        if name.endswith(".json") and not name.startswith((".", "_")):
            stream = fs.open(_path(spark, f"{folder}/{name}"))
            try:
                text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            lines += [json.loads(line) for line in text.splitlines()]
    return lines


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _place(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no manifest names any more."""
    fs, at = _place(spark, path)
    fs.delete(at, True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _place(spark: SparkSession, path: str):
    at = _path(spark, path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
