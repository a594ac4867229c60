"""Source-tree reader (S1): one row per source file, `(file, code)`.

Rules of the walk: recurse; skip directories whose name starts with `.` and
directories named `node_modules`; keep plain files ending in .ts .tsx .js .jsx
(case-sensitive; names that start with `.` or `_` too). Links are not followed.
A missing root gives an empty result.

The tree is listed by tasks, one level a round: a round's directories are
spread over the cluster, each is listed where its row lies, and the
subdirectories found are written and become the next round. The driver sees
neither names nor entries, only whether a round found directories. Files are
read by tasks as well, some `READ_BYTES` of them a task.

`file` is the path below the root, decoded, with `/` between names: what is
`my dir/50%.js` on disk is `my dir/50%.js` here. Spark's own file index is not
used: it hides names that start with `_` or `.` and gives percent-encoded URIs.
Bytes that are no UTF-8 are replaced in names and in texts.

On a local or mounted path the listing is `os.scandir`; other roots go through
pyarrow's file systems (hdfs, s3, gs, abfs), which must be reachable from the
executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# Extensions and skipped directory names.
EXTENSIONS = ("ts", "tsx", "js", "jsx")
SKIP_DIR = "node_modules"

#: Bytes of source text that one task reads, and bytes of texts handed on in one go.
READ_BYTES, BATCH_BYTES = 32 << 20, 8 << 20

SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("code", T.StringType())])
_ENTRY = "raw binary, is_dir boolean, size long"


def wanted_dir(name: str) -> bool:
    return not name.startswith(".") and name != SKIP_DIR


def _local(root: str) -> str | None:
    """The plain path of a local root (with or without `file:`), else None."""
    if root.startswith("file:"):
        rest = root[len("file:"):]
        return rest[2:] if rest.startswith("//") else rest
    return root if "://" not in root else None


def _entries(root: str, below: bytes) -> Iterator[tuple[bytes, str, bool, int]]:
    """(path below the root, name, is a directory, size) of one directory's plain files and directories."""
    local = _local(root)
    if local is not None:
        with os.scandir(os.path.join(os.fsencode(local), below)) as found:
            for e in found:
                is_dir = e.is_dir(follow_symlinks=False)
                if is_dir or e.is_file(follow_symlinks=False):
                    size = 0 if is_dir else e.stat(follow_symlinks=False).st_size
                    yield os.path.join(below, e.name), e.name.decode("utf-8", "replace"), is_dir, size
        return
    from pyarrow import fs as pafs

    system, path = pafs.FileSystem.from_uri(_arrow_uri(root))
    at = "/".join(x for x in (path.rstrip("/"), below.decode()) if x)
    for e in system.get_file_info(pafs.FileSelector(at)):
        if e.type in (pafs.FileType.File, pafs.FileType.Directory):
            inner = f"{below.decode()}/{e.base_name}" if below else e.base_name
            yield inner.encode(), e.base_name, e.type == pafs.FileType.Directory, e.size or 0


def _arrow_uri(root: str) -> str:
    return "s3://" + root.split("://", 1)[1] if root.startswith(("s3a://", "s3n://")) else root


def _exists(root: str) -> bool:
    local = _local(root)
    if local is not None:
        return os.path.isdir(local)
    from pyarrow import fs as pafs

    system, path = pafs.FileSystem.from_uri(_arrow_uri(root))
    return system.get_file_info(path).type == pafs.FileType.Directory


def _read(root: str, below: bytes) -> str:
    local = _local(root)
    if local is not None:
        with open(os.path.join(os.fsencode(local), below), "rb") as fh:
            return fh.read().decode("utf-8", "replace")
    from pyarrow import fs as pafs

    system, path = pafs.FileSystem.from_uri(_arrow_uri(root))
    with system.open_input_stream(f"{path.rstrip('/')}/{below.decode()}") as fh:
        return fh.read().decode("utf-8", "replace")


def _list_level(root: str, extensions: Sequence[str]):
    """mapInArrow body: what the directories of a batch hold, a batch of entries at a time."""
    endings = tuple("." + e for e in extensions)

    def made(rows):
        columns = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.bool_(), pa.int64()))], ["raw", "is_dir", "size"])

    def run(batches):
        for batch in batches:
            rows = []
            for below in batch.column(0).to_pylist():
                for raw, name, is_dir, size in _entries(root, below):
                    if wanted_dir(name) if is_dir else name.endswith(endings):
                        rows.append((raw, is_dir, size))
                    if len(rows) >= 10_000:
                        yield made(rows)
                        rows = []
            yield made(rows)

    return run


def list_tree(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(raw, size) of the source files below `root`: their paths as bytes and their sizes. One round a level."""
    empty = spark.createDataFrame([], "raw binary, size long")
    exists = spark.range(1).mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([_exists(root)] * b.num_rows)], ["there"]) for b in batches), "there boolean")
    if not exists.first()["there"]:
        return empty
    files, level, n = empty, spark.createDataFrame([(b"",)], "raw binary"), 1
    while n:
        # dealt by a hash of the path, at most one directory a task until there are more than tasks
        spread = min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
        found = materialize(level.repartition(spread, "raw").mapInArrow(_list_level(root, extensions), _ENTRY))
        files = files.unionByName(found.where(~F.col("is_dir")).select("raw", "size"))
        level = found.where("is_dir").select("raw")
        n = level.count()
    return files


def _read_files(root: str):
    """mapInArrow body: the texts of listed files, handed on before they exceed BATCH_BYTES."""

    def run(batches):
        for batch in batches:
            names, codes, size = [], [], 0
            for raw in batch.column(0).to_pylist():
                names.append(raw.decode("utf-8", "replace"))
                codes.append(_read(root, raw))
                size += len(codes[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(codes, pa.string())], ["file", "code"])
                    names, codes, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(codes, pa.string())], ["file", "code"])

    return run


def read_source_tree(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(file, code) of every source file below `root`."""
    files = list_tree(spark, root, extensions)
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, -(-total // READ_BYTES))
    return files.select("raw").repartition(tasks, "raw").mapInArrow(_read_files(root), SCHEMA)
