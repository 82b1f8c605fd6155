"""Where intermediate files go: the shared folder the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, or under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/veritab/{label}-{uuid.uuid4().hex}"


def numbered_folders(spark: SparkSession, root: str, column: str) -> list[int]:
    """The numbers N of the folders ``column=N`` below a root that may not exist yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(name.split("=", 1)[1]) for name in names if name.startswith(f"{column}="))
