"""Make this package importable in the Python workers."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import SparkSession

from readmend.sources.scratch import scratch_dir

_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Ship the package as a zip, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    from readmend.sources import files
    import io

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = f"{scratch_dir(spark)}/readmend-{app}.zip"
    files.write_bytes(target, buffer.getvalue())
    spark.sparkContext.addPyFile(target)
    _SENT.add(app)
