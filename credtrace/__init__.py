"""Credential-exposure analytics on Spark: from files to scored, safe findings and their rollups."""

from __future__ import annotations

import os


def share_package(spark) -> None:
    """Let Python workers import this package from where the driver has it, whatever their working directory.

    On a cluster that does not mount that place the package is handed over by ``--py-files`` as usual.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
