"""Helpers of the operators: stored steps, objects kept per worker process, typed input columns."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as characters and as a class of a regular expression.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
#: For ``translate``, where only these letters change their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may leave the setting out; it then gets a temporary folder.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: later steps never repeat the work before."""
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path, compression=compression)
    return spark.read.schema(frame.schema).parquet(path)


def columns(frame: DataFrame, **types_: str) -> DataFrame:
    """Only the named columns, in their types; whatever else the table has stays out."""
    return frame.select(*(F.col(name).cast(kind).alias(name) for name, kind in types_.items()))


def per_process(key: tuple, build: Callable[[], Any]) -> Any:
    """An object built once in each Python worker and kept for its later tasks."""
    kept = sys.modules.setdefault("plumbline_worker_objects", types.ModuleType("plumbline_worker_objects"))
    objects = kept.__dict__.setdefault("objects", {})
    if key not in objects:
        objects[key] = build()
    return objects[key]
