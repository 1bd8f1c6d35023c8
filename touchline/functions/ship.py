"""Gives the executors this package, as ``--py-files`` would.

Python functions that run inside tasks are pickled by module name, so the
executors of a cluster must be able to import the package.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ensure_package(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once.  The archive
    is read by the driver's own file server only, so it may be local."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    above = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="touchline-code-"), "touchline_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in (n for n in sorted(names) if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, above))
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)
