"""Sessions and the shared folder that intermediate results are kept in."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lakeloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: The temporary folders of applications without the setting, and the tables that each application wrote.
_FOLDERS: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent (tests, one machine) a temporary folder is made; it goes when the process ends. A cluster needs the setting.
    """
    found = spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = tempfile.mkdtemp(prefix="lakeloom-")
        atexit.register(shutil.rmtree, _FOLDERS[app], ignore_errors=True)
    return _FOLDERS[app]


def scratch_folder(spark: SparkSession) -> str:
    """A name for a folder of the application's own in the shared folder; ``release`` deletes it."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/{app}-{uuid.uuid4().hex}"
    _TABLES.setdefault(app, []).append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a Parquet table, and read from there: it cuts the lineage and survives lost executors.

    Against ``checkpoint()`` it computes ``df`` once instead of twice, takes less disk, and lets columns be left out later.
    ``release`` deletes the tables of a session.
    """
    spark = df.sparkSession
    path = scratch_folder(spark) + ".parquet"
    _TABLES[spark.sparkContext.applicationId][-1] = path
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every table that ``written`` made for this application, on whatever file system; results that read them must be done.

    How many there were is returned.
    """
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores, for rows that cost much more to work on than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
