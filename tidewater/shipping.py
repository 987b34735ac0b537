"""Makes the package importable on executors.

Python functions that run on executors refer to modules of this package.  On a
cluster started without the repository on its path they are sent along once per
application, as ``--py-files`` would do.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidewater-ship-")) / "tidewater.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, f"{root.name}/{source.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(app)
