"""Sessions, the cutting of long lineages, and relations that are kept for reuse."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "orebody", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; a cluster's own settings are left alone."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where it is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orebody-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@dataclass
class Kept:
    """A relation kept for reuse: where it lies, and how many hold it."""

    path: str
    holders: int


#: What this process has written into the shared folder and what of it is kept for reuse, by application.
_WRITTEN: dict[str, set[str]] = {}
_KEPT: dict[tuple[str, str], Kept] = {}


def _table(df: DataFrame, name: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/orebody-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read again: the lineage ends, and no executor's loss undoes it."""
    return df.sparkSession.read.schema(df.schema).parquet(_table(df, "cut"))


def grows(df: DataFrame) -> DataFrame:
    """df, which grows with the input, for a join: it is sorted and merged, not broadcast, as files of a few MB may hold a million rows that the driver would have to hold."""
    return df.hint("merge")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files under the paths: names, sizes and times, without their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(F.concat_ws("|", "path", "length", F.col("modificationTime").cast("string")).alias("f"))
    one = found.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("f")), "\n"), 256)).first()[0]
    return hashlib.sha256(json.dumps([sorted(paths), one]).encode()).hexdigest()


def relation_id(name: str, inputs: str, settings: dict) -> str:
    """The name of a relation: a digest of what it is, of its inputs' fingerprint and of the settings that it depends on."""
    return hashlib.sha256(json.dumps([name, inputs, settings], sort_keys=True, default=str).encode()).hexdigest()


def reused(spark: SparkSession, name: str, inputs: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The relation of this name, inputs (a fingerprint) and settings: built and written once by a driver, then read by whoever asks again.

    It stays until release() has been called once for each time it was asked for, or forget(); if
    its files were removed meanwhile, it is built again.
    """
    key = (spark.sparkContext.applicationId, relation_id(name, inputs, settings))
    if key not in _KEPT or not _there(spark, _KEPT[key].path):
        _KEPT[key] = Kept(_table(build(), name), _KEPT[key].holders if key in _KEPT else 0)
    _KEPT[key].holders += 1
    return spark.read.parquet(_KEPT[key].path)


def release(spark: SparkSession, name: str, inputs: str, settings: dict) -> bool:
    """One holder less; the relation's files go with the last one. Whether they went."""
    key = (spark.sparkContext.applicationId, relation_id(name, inputs, settings))
    if key not in _KEPT:
        return False
    _KEPT[key].holders -= 1
    if _KEPT[key].holders > 0:
        return False
    _remove(spark, {_KEPT.pop(key).path})
    return True


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _remove(spark: SparkSession, paths: set[str]) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).difference_update(paths)


def forget(spark: SparkSession) -> int:
    """Remove all that this driver has written into the shared folder; frames that read it can't be used any more. How many relations went."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _KEPT if k[0] == app]:
        del _KEPT[key]
    paths = set(_WRITTEN.get(app, set()))
    _remove(spark, paths)
    return len(paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written within goes at the end, but for relations kept for reuse: for jobs that have stored their results elsewhere by then."""
    app = spark.sparkContext.applicationId
    before = set(_WRITTEN.get(app, set()))
    try:
        yield
    finally:
        kept = {k.path for (a, _), k in _KEPT.items() if a == app}
        _remove(spark, _WRITTEN.get(app, set()) - before - kept)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, so that Python functions find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_orebody_sent", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="orebody-"), "orebody_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("orebody") / p.relative_to(root)))
    sc.addPyFile(target)
    sc._orebody_sent = True
