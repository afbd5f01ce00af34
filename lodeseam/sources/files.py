"""Files through Spark's own file systems, so that paths may lie in any store that Spark reads; and a data source that walks a tree."""

from __future__ import annotations

import os
import tempfile
import time
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from lodeseam.config import Indexing
from lodeseam.operators.filters import Rules


def _system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, where, _ = _system(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where, _ = _system(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where, _ = _system(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    except Py4JJavaError as e:
        raise OSError(f"could not read {path}: {e.java_exception}") from e
    finally:
        stream.close()


#: Bytes of files that a task works on.
PART_BYTES = 32 << 20


def parts_for(df: DataFrame) -> int:
    """Tasks enough for the bytes of the files that ``df`` reads, and no fewer than there are cores."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt by its first column (a key) to tasks enough for its bytes, if its scan does not spread it so: a file is often one row group, which one task would read and work on alone, whatever its size.

    How many rows each task gets is counted first, without their columns, from what the files say of their row groups. Rows are dealt by hash, as round robin would sort them all first.
    """
    if not df.inputFiles():
        return df
    n = parts_for(df)
    held = df.select(F.spark_partition_id().alias("task")).groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    most, rows = held.agg(F.max("n"), F.sum("n")).first()
    return df.repartition(n, df.columns[0]) if rows and most * n > 2 * rows else df


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside ``path`` and renames over it in one step, so that a reader always sees the old or the new text."""
    _, where, hadoop = _system(spark, path)
    context = hadoop.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    beside = hadoop.Path(f"{path}.new")
    jvm = spark.sparkContext._jvm
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(beside, where, how)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; only a local session may do without it and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="lodeseam-shared-")


def remove(spark: SparkSession, path: str) -> None:
    fs, where, _ = _system(spark, path)
    fs.delete(where, True)


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    """One partition for each top folder and one for the root's own files; excluded folders are never entered."""

    def __init__(self, root: str, rules: Rules):
        self.root, self.rules = root, rules

    def partitions(self) -> list[_Part]:
        try:
            tops = [e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and self.rules.enters(e.name)]
        except OSError:
            tops = []
        return [_Part("", False), *(_Part(t, True) for t in sorted(tops))]

    def read(self, part: _Part) -> Iterator[tuple[str, str, int, float]]:
        waiting = [part.folder]
        while waiting:
            rel = waiting.pop()
            try:
                entries = sorted(os.scandir(os.path.join(self.root, rel)), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                path = f"{rel}/{e.name}" if rel else e.name
                try:
                    if e.is_dir(follow_symlinks=False):
                        if part.deep and self.rules.enters(e.name):
                            waiting.append(path)
                    elif e.is_file(follow_symlinks=False) and self.rules.considers(path):
                        stat = e.stat(follow_symlinks=False)
                        if self.rules.indexes(path, stat.st_size):
                            yield path, e.path, stat.st_size, stat.st_mtime * 1000
                except OSError:
                    continue


class TreeSource(DataSource):
    """``spark.read.format("sourcetree").load(root)``: the files of a tree that are indexed."""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return "path string, file string, size long, mtime_ms double"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], Rules.of(Indexing()))


def tree(spark: SparkSession, root: str, indexing: Indexing | None = None):
    """Files under ``root`` with the rules of ``indexing``."""
    rules = Rules.of(indexing or Indexing())

    class Own(TreeSource):
        def reader(self, schema) -> TreeReader:
            return TreeReader(self.options["path"], rules)

    spark.dataSource.register(Own)
    return spark.read.format("sourcetree").load(root)


class ChangesReader(SimpleDataSourceStreamReader):
    """The changes of a tree since an offset, a moment in ms: files written since then, and, while the reader lives, files that are gone. What vanished while nobody
    watched is found by a full reconcile, with which a watch begins."""

    def __init__(self, root: str, rules: Rules):
        self.tree = TreeReader(root, rules)
        self.seen: dict[str, float] | None = None

    def initialOffset(self) -> dict:
        return {"at": time.time_ns() // 1_000_000}

    def _files(self) -> dict[str, float]:
        return {path: mtime for part in self.tree.partitions() for path, _, _, mtime in self.tree.read(part)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = time.time_ns() // 1_000_000
        files, before = self._files(), self.seen or {}
        self.seen = files
        written = [(p, False, int(m)) for p, m in files.items() if (m != before[p] if p in before else m >= start["at"] or bool(before))]
        gone = [(p, True, now) for p in before if p not in files]
        return iter(written + gone), {"at": now} if written or gone else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(p, False, int(m)) for p, m in self._files().items() if start["at"] <= m <= end["at"]])

    def commit(self, end: dict) -> None:
        pass


def changes_of(spark: SparkSession, root: str, rules: Rules) -> DataFrame:
    """A stream of ``(path, deleted, at_ms)``: the changes of the files under ``root`` that ``rules`` take in."""

    class TreeChanges(DataSource):
        @classmethod
        def name(cls) -> str:
            return "treechanges"

        def schema(self) -> str:
            return "path string, deleted boolean, at_ms long"

        def simpleStreamReader(self, schema) -> ChangesReader:
            return ChangesReader(self.options["path"], rules)

    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("treechanges").load(root)
