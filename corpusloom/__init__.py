"""Document-retrieval analytics as Spark jobs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Give the executors this package once per application, so that functions of it run there.

    The archive goes through Spark's own file distribution; nothing is expected on the executors' disks.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-corpusloom-ship-"), "corpusloom_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(Path(top.name) / p.relative_to(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
