"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share. In local mode, where the driver's
    warehouse is as good a place, that serves if none is set; elsewhere it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_OPEN: set[str] = set()


#: Rows that a task writes of a table whose size is known to be small: some 20 MB of long numbers.
ROWS_A_TASK = 1 << 17


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later steps
    restart from files, whichever executors are lost. The files stay until ``release`` or the end of
    the driver's Python.

    ``rows`` is a bound of the table's rows, if tables written before tell one: no more tasks (and files) are
    made than these need, but one a core. Wide rows count as several. The result does not depend on it."""
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))
    spark = df.sparkSession
    if (app := spark.sparkContext.applicationId) not in _OPEN:
        _OPEN.add(app)
        atexit.register(release, spark)
    path = f"{shared_dir(spark).rstrip('/')}/atelier/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def place(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one for files that are no tables; it goes as the tables of ``cut`` do."""
    if (app := spark.sparkContext.applicationId) not in _OPEN:
        _OPEN.add(app)
        atexit.register(release, spark)
    return f"{shared_dir(spark).rstrip('/')}/atelier/{app}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for steps that need partitions to stay as they are."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote in this application; nothing if it has ended."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/atelier/{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
