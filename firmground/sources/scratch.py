"""Tables a query writes and reads again: they cut lineage, survive lost executors and give the planner true sizes."""
from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from firmground.session import checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in a fresh folder below ``spark.checkpoint.dir``, removed when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except (Py4JError, PySparkException, AttributeError, OSError):
            pass  # the session is gone already

    atexit.register(remove)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
