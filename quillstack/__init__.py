"""quillstack: document-structure analytics and corpus preparation on Spark."""

from __future__ import annotations

import os

__version__ = "0.1.0"

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def attach(spark) -> None:
    """Lets Python workers import this package where it isn't on their path already.

    On a cluster without this folder, ship the package with --py-files instead.
    """
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    own = spark.sparkContext.environment
    if ROOT not in [*paths, *own.get("PYTHONPATH", "").split(os.pathsep)]:
        own["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, own.get("PYTHONPATH", "")]))
