"""Makes a session ready for the package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows that go to a Python worker at a time, unless the session says otherwise: with long texts Spark's 10,000 take too much memory.
BATCH_ROWS, _DEFAULT_ROWS = "1000", "10000"
#: Bytes of such a batch, unless the session says otherwise.
BATCH_BYTES = str(32 << 20)
_ROWS_KEY, _BYTES_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's files, once, so that workers can import it wherever it isn't installed."""
    sc = spark.sparkContext
    if spark.conf.get(_ROWS_KEY) == _DEFAULT_ROWS:
        spark.conf.set(_ROWS_KEY, BATCH_ROWS)
    if not spark.sparkContext.getConf().contains(_BYTES_KEY):
        spark.conf.set(_BYTES_KEY, BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="edgeloom-"), "edgeloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
