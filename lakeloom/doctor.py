"""Whether all that the engine needs is there."""

from __future__ import annotations

import platform
import sys
import uuid

from pyspark.sql import SparkSession

from lakeloom.plans.session import CHECKPOINT_DIR, shared_dir


def checks(spark: SparkSession, storage: str | None = None) -> list[dict]:
    """[{name, ok, detail}] for the versions, the shared folder, writing and reading tables, Arrow functions and the storage folder."""
    out: list[dict] = []

    def check(name: str, f) -> None:
        try:
            out.append({"name": name, "ok": True, "detail": str(f())})
        except Exception as e:  # any failure is what is looked for
            out.append({"name": name, "ok": False, "detail": str(e).splitlines()[0][:200]})

    def python() -> str:
        if sys.version_info < (3, 10):
            raise RuntimeError(f"Python 3.10 or later is needed, this is {platform.python_version()}")
        return platform.python_version()

    def table(folder: str) -> str:
        path = f"{folder}/doctor-{uuid.uuid4().hex}"
        spark.range(3).write.parquet(path)
        try:
            if spark.read.parquet(path).count() != 3:
                raise RuntimeError("a written table reads differently")
        finally:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return folder

    def arrow() -> str:
        import pyarrow

        if spark.range(2).mapInArrow(lambda b: b, "id long").count() != 2:
            raise RuntimeError("rows were lost")
        return pyarrow.__version__

    check("python", python)
    check("spark", lambda: spark.version)
    check("java", lambda: spark._jvm.java.lang.System.getProperty("java.version"))
    check("arrow", arrow)
    check("shared folder", lambda: table(shared_dir(spark)))
    check("shared folder setting", lambda: spark.sparkContext.getConf().get(CHECKPOINT_DIR) or "unset, a temporary folder is used on one machine")
    if storage:
        check("storage", lambda: table(storage))
    return out


def told(found: list[dict]) -> str:
    return "\n".join(f"{'ok  ' if c['ok'] else 'FAIL'} {c['name']}: {c['detail']}" for c in found)
