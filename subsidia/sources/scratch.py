"""Folders and tables for intermediate results that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_FOLDERS: list[str] = []
_TABLES: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, deleted at the end of the driver's process.

    Where the setting is missing, a session on one machine gets a temporary folder; a cluster doesn't.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "subsidia-shared")
    _registered(spark)
    _FOLDERS.append(f"{base}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def table(spark: SparkSession, name: str) -> str:
    """A new table's name, dropped at the end of the driver's process."""
    _registered(spark)
    _TABLES.append(f"{name}_{uuid.uuid4().hex}")
    return _TABLES[-1]


def _registered(spark: SparkSession) -> None:
    if not _FOLDERS and not _TABLES:
        atexit.register(clear, spark)


def clear(spark: SparkSession) -> None:
    """Delete what folder() and table() have named; results that read it must have been used."""
    try:
        while _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
        while _FOLDERS:
            place = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001 - the session may be gone by now
        _FOLDERS.clear()
        _TABLES.clear()


def sent_along(module: str) -> None:
    """Let workers get a module's functions and classes by value, wherever they run."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
