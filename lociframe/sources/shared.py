"""Tables written in the folder that driver and executors share, which cut the lineage.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and Spark runs
in one process, as in tests, a folder of this machine is made.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _made.setdefault(app, _made.get(app) or "file://" + tempfile.mkdtemp(prefix="lociframe-"))
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/lociframe/{name}-{uuid.uuid4().hex}"


#: Spark's setting that lets a query's shuffle files go as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, path: str | None = None, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, at ``path`` if given, and read it back.

    A lost executor costs no recomputation of what came before. With ``release`` the shuffle
    files that the write needed go as soon as it is done.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)
