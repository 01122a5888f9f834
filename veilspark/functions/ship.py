"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import hashlib
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

PACKAGE = Path(__file__).resolve().parents[1]


#: Bytes of an Arrow batch that goes to a Python worker; rows may be whole packages.
BATCH_BYTES = 4 << 20


def _bounded(spark) -> None:
    """Lowers the session's bound of a batch's bytes to `BATCH_BYTES` where it is larger or unset; it stays so, since plans run later."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    told = (spark.conf.get(key, None) or "").rstrip("bB")
    if not told.isdigit() or not 0 < int(told) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def ship(df: DataFrame) -> DataFrame:
    """Sends the package's sources to the executors, once a context, and bounds Arrow batches in bytes; returns `df` as it is."""
    _bounded(df.sparkSession)
    context = df.sparkSession.sparkContext
    if not hasattr(context, "_veilspark_sources"):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(PACKAGE.rglob("*.py")):
                z.writestr(zipfile.ZipInfo(str(path.relative_to(PACKAGE.parent)), (1980, 1, 1, 0, 0, 0)), path.read_bytes())
        folder = tempfile.TemporaryDirectory(prefix="veilspark-")
        target = Path(folder.name, f"{PACKAGE.name}-{hashlib.sha256(data.getvalue()).hexdigest()[:16]}.zip")
        target.write_bytes(data.getvalue())
        context.addPyFile(str(target))
        context._veilspark_sources = folder  # deleted with the context
    return df
