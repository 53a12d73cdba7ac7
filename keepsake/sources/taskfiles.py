"""Files that tasks read, move and delete themselves, one at a time and piece by piece.

Paths come as Spark shows them in the ``path`` column of file listings: a scheme and a name in
which nothing is escaped. Local files are opened by name; other stores by the file system of
their scheme, which is looked up for the store alone, so that blanks and ``%`` in names pass.
All operations can be repeated: a task that is run again finds its work done.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

# Tasks need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE_BYTES = 8 * 1024 * 1024
# Hadoop's names of schemes that other clients call differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss", "wasbs": "abfss"}


def located(path: str):
    """(file system or None for local, name in it)."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)$", path, re.S)
    if not found or found[1] == "file":
        return None, found[3] if found else path
    from pyarrow import fs

    scheme, store = SCHEMES.get(found[1], found[1]), found[2] or ""
    system, base = fs.FileSystem.from_uri(f"{scheme}://{store}/")
    return system, f"{base.rstrip('/')}{found[3]}"


def pieces(path: str, size: int = PIECE_BYTES) -> Iterator[bytes]:
    system, name = located(path)
    with open(name, "rb") if system is None else system.open_input_stream(name, compression=None) as stream:
        while piece := stream.read(size):
            yield piece


def md5(path: str) -> str:
    import hashlib

    digest = hashlib.md5()
    for piece in pieces(path):
        digest.update(piece)
    return digest.hexdigest()


def exists(path: str) -> bool:
    system, name = located(path)
    if system is None:
        return os.path.exists(name)
    from pyarrow import fs

    return system.get_file_info(name).type != fs.FileType.NotFound


def delete(path: str) -> None:
    """Remove a file or a whole folder; nothing happens if it is not there."""
    import shutil

    if not exists(path):
        return
    system, name = located(path)
    if system is None:
        if os.path.isdir(name):
            shutil.rmtree(name)
        else:
            os.remove(name)
            beside = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
            if os.path.exists(beside):
                os.remove(beside)
        return
    from pyarrow import fs

    if system.get_file_info(name).type == fs.FileType.Directory:
        system.delete_dir(name)
    else:
        system.delete_file(name)


def move(source: str, target: str) -> None:
    """Put a file in its place; if that was done before, or an equal file is there, the source only goes."""
    if exists(target):
        delete(source)
        return
    system, name = located(source)
    _, goal = located(target)
    if system is None:
        os.makedirs(os.path.dirname(goal), exist_ok=True)
        os.replace(name, goal)
        delete(source)
        beside = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
        if os.path.exists(beside):
            os.remove(beside)
    else:
        system.create_dir(os.path.dirname(goal), recursive=True)
        system.move(name, goal)


def spread(listed: DataFrame) -> DataFrame:
    """A listing dealt out evenly, large files and small."""
    return listed.repartition("path")


def each(listed: DataFrame, act) -> None:
    """Run ``act(row)`` for every row of a listing, in tasks. ``act`` has to be repeatable."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                act(row)
        return iter([])

    spread(listed).mapInArrow(run, "done int").write.format("noop").mode("append").save()


def holding(listed: DataFrame, inside: str) -> DataFrame:
    """(path) of the folders of a listing that have a file of this name; tasks look, so that the session need not ask for each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [p for p in batch.column("path").to_pylist() if exists(f"{p}/{inside}")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["path"])

    return spread(listed.select("path").distinct()).mapInArrow(run, "path string")


def checksums(listed: DataFrame) -> DataFrame:
    """(path, checksum, size) of a listing ``path, size``: every file is streamed, whatever its size."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array([md5(p) for p in batch.column("path").to_pylist()], pa.string()), batch.column("size")],
                ["path", "checksum", "size"])

    return spread(listed.select("path", "size")).mapInArrow(run, "path string, checksum string, size bigint")


def listing(spark, path: str, pattern: str) -> DataFrame:
    """(path, size) of the files below a folder, listed by the session's own file system; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    listed = files.select("path", F.col("length").alias("size"))
    names = files._jdf.inputFiles()
    if len(names) == listed.count():
        return listed
    # the reader passes over empty files; names are escaped here and have two more slashes
    every = spark.createDataFrame([(re.sub("^file:///", "file:/", unquote(n)),) for n in names], "path string")
    return listed.unionByName(every.join(listed.select("path"), "path", "left_anti").withColumn("size", F.lit(0).cast("bigint")))
