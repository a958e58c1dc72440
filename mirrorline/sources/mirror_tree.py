"""A mirror as a directory tree: one file per (site, path) under a root folder that
all executors reach (a mounted path, or an address that Arrow's file systems know).

Tasks write and read the files themselves, a megabyte at a time when reading, so a
file may be larger than a row can be. Spark's own readers list neither empty files
nor names that start with "_" or "."; here the entries say which files to look for.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HASH_PREFIX
from ..session import workers_import, written

READ_BYTES = 1 << 20


def _file_system(root: str):
    from pyarrow import fs
    if re.match(r"^(file:)?/", root):
        return fs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", root).rstrip("/")
    found, path = fs.FileSystem.from_uri(root)
    return found, path.rstrip("/")


def _address(folder: str, site: str | None, path: str | None) -> str:
    """Where a file lies; ValueError for names that would lie elsewhere or nowhere."""
    names = [site or "", *(path or "").split("/")]
    if any(n in ("", ".", "..") or "\0" in n for n in names) or "/" in names[0]:
        raise ValueError("no file name")
    return "/".join([folder, *names])


def _is_file(fs, folder: str, site: str | None, path: str | None) -> bool:
    from pyarrow.fs import FileType
    try:
        return fs.get_file_info(_address(folder, site, path)).type == FileType.File
    except (OSError, ValueError):  # a name that no file can have
        return False


def folder_clashes(files: DataFrame) -> DataFrame:
    """(site, path) of files whose path is a folder of another file of the site."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = (files.where(F.col("path").contains("/")).select("site", F.explode(above).alias("path")).distinct())
    return files.select("site", "path").join(folders, ["site", "path"], "left_semi")


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Writes ``files(site, path, content)``, a path once, and returns those that could
    not be written as (site, path, reason): a path that is another file's folder, a
    name that is none, one the file system refuses.

    A file is put in place by a rename, so a task that runs twice leaves the same
    files and a reader sees whole ones only."""
    def run(batches, folder=root, file_system=_file_system, address=_address):
        fs, base = file_system(folder)
        for batch in batches:
            lost = []
            sites, paths, contents, clash = batch.columns
            for k in range(batch.num_rows):
                site, path = sites[k].as_py(), paths[k].as_py()
                try:
                    if clash[k].as_py():
                        raise ValueError("the path is another file's folder")
                    to = address(base, site, path)
                    fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
                    part = f"{base}/{site}/.part-{uuid.uuid4().hex}"
                    with fs.open_output_stream(part) as out:
                        out.write(contents[k].as_buffer() if contents[k].is_valid else b"")
                    try:
                        fs.move(part, to)
                    except OSError:
                        fs.delete_file(part)
                        raise
                except (OSError, ValueError) as why:
                    lost.append((site, path, re.sub(r"/\S+", "", str(why)) if isinstance(why, OSError) else str(why)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in lost], pa.string()) for k in range(3)], ["site", "path", "reason"])

    workers_import(files.sparkSession)
    clashes = written(folder_clashes(files).withColumn("_clash", F.lit(True)))
    rows = (files.join(clashes, ["site", "path"], "left")
            .select("site", "path", F.col("content").cast("binary").alias("content"), "_clash"))
    return written(rows.mapInArrow(run, "site string, path string, reason string"))


def tree_digests(entries: DataFrame, root: str) -> DataFrame:
    """(site, path, disk_size, disk_hash) of the files that ``entries(site, path)`` name;
    null where there is none."""
    def run(batches, folder=root, file_system=_file_system, address=_address, is_file=_is_file):
        fs, base = file_system(folder)
        for batch in batches:
            sizes, hashes = [], []
            for site, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size, name = None, None
                if is_file(fs, base, site, path):  # an error from here on fails the task, which is tried again
                    digest, size = hashlib.sha256(), 0
                    with fs.open_input_stream(address(base, site, path)) as file:
                        while block := file.read(READ_BYTES):
                            digest.update(block)
                            size += len(block)
                    name = HASH_PREFIX + digest.hexdigest()
                sizes.append(size)
                hashes.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())],
                                             ["site", "path", "disk_size", "disk_hash"])

    workers_import(entries.sparkSession)
    keys = entries.select("site", "path").distinct()
    return keys.mapInArrow(run, "site string, path string, disk_size bigint, disk_hash string")
