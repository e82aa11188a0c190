"""Send the package to the executors, which need not have it installed."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession

from ..session import with_default_folder

Job = TypeVar("Job", bound=Callable)
_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Once per application: Spark's own file server hands a zip of the
    package to every executor, also to those that join later."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="casefeat-")) / "casefeat.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(path))
    _SENT.add(sc.applicationId)


def with_package(job: Job) -> Job:
    """A job whose first argument is the session, with the package sent and
    a shared folder to write to."""

    @functools.wraps(job)
    def run(spark: SparkSession, *args, **kwargs):
        send_package(with_default_folder(spark))
        return job(spark, *args, **kwargs)

    return run
