"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import shutil
from urllib.parse import unquote, urlsplit

from pyspark.sql import SparkSession

_local: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset one in the warehouse.

    The one in a warehouse on the driver's own disk (a local session) is deleted when the program ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tidelake"
    parts = urlsplit(path)
    if parts.scheme in ("", "file") and path not in _local:
        _local.add(path)
        atexit.register(shutil.rmtree, unquote(parts.path), ignore_errors=True)
    return path
