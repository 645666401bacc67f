"""Let Python workers import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def workers_see_package(spark: SparkSession) -> None:
    """Put the folder of the package on the workers' path, as it is on the driver's.

    Workers of a local session need nothing more. On a cluster the package is shipped by
    ``--py-files`` or installed on the machines, and this does no harm.
    """
    environment = spark.sparkContext.environment
    before = environment.get("PYTHONPATH", "")
    if ROOT not in before.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, before]))
