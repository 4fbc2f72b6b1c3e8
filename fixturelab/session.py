"""The shared folder used to cut lineage, and the package on the workers."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting (a test) gets a folder of its own; a cluster session
    without it is refused, since each executor would write to its own disk.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="fixturelab-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, wherever they run; once, also if fits begin side by side."""
    context = spark.sparkContext
    with _SHIPPING:
        if context.applicationId in _SHIPPED:
            return
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="fixturelab-code-")
        archive = os.path.join(folder, "fixturelab_code.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for base, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(base, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
