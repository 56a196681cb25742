"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), "sparsela.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster. Where none is set, a local master gets a folder of
    its own; several machines have no folder in common then, which is an error."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that all of them see")
        path = tempfile.mkdtemp()
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()
