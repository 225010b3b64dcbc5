"""What workers need of the driver: this package wherever it was found, and a folder that all of them share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to all executors, once per application. Returns the session.

    A package that came as an archive was shipped with the application already."""
    context = spark.sparkContext
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here) and not getattr(context, "_rowdelta_shipped", False):
        path = os.path.join(tempfile.mkdtemp(prefix="rowdelta-"), "rowdelta.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for top, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(top, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        context.addPyFile(path)
        context._rowdelta_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session may lack the setting: it gets a temporary folder of this machine. On a cluster a machine's
    own folder would lose rows, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="rowdelta-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")
