"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors through the driver's file server, once for each
    application, so that nothing has to be installed on them. Batches to Python get 4 MB unless
    the session says otherwise: with 64 MB, each held several times over on either side, long
    texts fill an executor."""
    context = spark.sparkContext
    if not spark._jsparkSession.conf().contains(_BATCH):  # nobody set it
        spark.conf.set(_BATCH, "4194304b")
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="threadloom-code-")  # on the driver, which serves it
        archive = os.path.join(folder, "threadloom_code.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, str(Path(here.name) / p.relative_to(here)))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark
