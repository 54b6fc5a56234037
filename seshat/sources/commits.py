"""Outputs that grow by commits: what a stopped run has committed is kept and passed over, what it has not is not there.

A commit writes its tables into folders of its own and is then named by one small file, made under another name and
renamed. Readers take the tables of named commits alone, so a run that is stopped at any moment leaves whole commits.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where none is set and all runs in this process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='seshat-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Commits:
    """Commits under a folder, in their order. One writer at a time; readers may come at any time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str) -> tuple:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def names(self) -> list[str]:
        files, where = self._file("commits")
        if not files.exists(where):
            return []
        return sorted(n for n in (s.getPath().getName() for s in files.listStatus(where)) if not n.startswith((".", "_")))

    def write(self, tables: dict[str, DataFrame], partition_by: dict[str, str] | None = None) -> str:
        """Write the tables and commit them; gives the commit's name, which sorts behind those before."""
        name = f"{len(self.names()):08d}-{uuid.uuid4().hex}"
        for table, df in tables.items():
            writer = df.write
            if column := (partition_by or {}).get(table):
                writer = writer.partitionBy(column)
            writer.parquet(f"{self.path}/{table}/commit={name}")
        files, made = self._file(f"commits/.{name}")
        files.create(made, True).close()
        if not files.rename(made, self._file(f"commits/{name}")[1]):
            raise RuntimeError(f"commit {name} could not be named")
        return name

    def read(self, table: str, names: list[str] | None = None) -> DataFrame | None:
        """A table of the named commits with their names as `commit`; None where there are none."""
        names = self.names() if names is None else names
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/commit={n}" for n in names)) if names else None

    def forget(self, names: list[str]) -> None:
        """Take commits back, their names first."""
        for n in names:
            files, where = self._file(f"commits/{n}")
            files.delete(where, False)
        self.clean()

    def clean(self) -> None:
        """Remove what stopped runs have written and not committed."""
        known = {f"commit={n}" for n in self.names()}
        files, top = self._file("")
        for table in files.listStatus(top) if files.exists(top) else []:
            if table.isDirectory() and table.getPath().getName() != "commits":
                for made in files.listStatus(table.getPath()):
                    if made.getPath().getName() not in known:
                        files.delete(made.getPath(), True)


def resumed(rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, batches: int = 16) -> DataFrame:
    """work(rows), done a batch of keys at a time and committed with them; keys that are committed are not done again.

    work takes rows and gives rows of its own, each made from rows of one key alone, of which it may make none. Keys are
    dealt over batches by hash; null keys are done once too. A run that is stopped, at any moment, is taken up by calling
    this again with the same path: batches that are committed are passed over as a whole, and new keys among the rows are
    done. A batch reads the rows anew, so there should be as many batches as work that may be lost is worth.
    """
    store = Commits(rows.sparkSession, path)
    store.clean()
    hashed = F.xxhash64(F.col(key).cast("string"))
    done = store.read("keys")
    left = rows if done is None else rows.join(done.select(F.col("k").alias("_k")).distinct(), hashed == F.col("_k"), "left_anti")
    # one row a batch that still has keys
    for batch in sorted(r["b"] for r in left.select(F.pmod(hashed, F.lit(batches)).alias("b")).distinct().collect()):
        part = left.where(F.pmod(hashed, F.lit(batches)) == batch)
        store.write({"rows": work(part), "keys": part.select(hashed.alias("k")).distinct()})
    out = store.read("rows")
    return work(rows.limit(0)) if out is None else out.drop("commit")
