"""Tables, intermediate results and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where none is set and all runs in this process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='seshat-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def settle(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it back: the lineage ends there and a lost executor costs nothing.

    What discard() has not removed before goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seshat-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _place(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._seshat_path = path
    return out


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(*settled: DataFrame) -> None:
    """Remove what settle() wrote, once nothing reads it any more."""
    for df in settled:
        if path := getattr(df, "_seshat_path", None):
            files, where = _place(df.sparkSession, path)
            files.delete(where, True)


def spare(name: str, *taken: Sequence[str]) -> str:
    """name, or name with underscores behind it if columns are called that."""
    known = {c.lower() for columns in taken for c in columns}
    while name.lower() in known:
        name += "_"
    return name


def groups(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[pd.DataFrame]:
    """The runs of equal keys in batches that arrive sorted by the keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        ks = [batch[key].to_numpy() for key in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in ks])) + 1
        if held and any(held[-1][key].iloc[-1] != k[0] for key, k in zip(keys, ks)):
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        edges = [0, *cuts.tolist(), len(batch)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            part = batch.iloc[a:b]
            if i == 0 and held:
                part = pd.concat([*held, part], ignore_index=True) if b < len(batch) else part
            if b < len(batch):
                yield part
                held = []
            else:
                held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
