"""Spark session settings and the shared folder that jobs write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


CATALOGS = ("in-memory", "hive")


def build_session(app: str = "lakejobs", master: str | None = None, catalog: str = "in-memory", **conf: object) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI mode keeps its default (on).

    With ``catalog="hive"`` it sees the persistent catalog that the cluster's configuration names,
    so tables outlive the session; the default catalog ends with it.

    Give settings with ``__`` for the dots: ``build_session(spark__ui__enabled=False)``.
    On a cluster set ``spark.sql.adaptive.coalescePartitions.initialPartitionNum`` high
    (several times the core count): adaptive execution merges what turns out small.
    """
    if catalog not in CATALOGS:
        raise ValueError(f"catalog must be one of {CATALOGS}")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
    )
    if catalog == "hive":
        builder = builder.enableHiveSupport()
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        text = str(value).lower() if isinstance(value, bool) else str(value)
        builder = builder.config(name.replace("__", "."), text)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Only a local master, where one machine is the whole cluster, may do without it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{tempfile.gettempdir()}/lakejobs-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
