"""Sessions, and cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "codeloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; other settings as keywords with underscores for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir of the session names it.

    Only a local master may do without that setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codeloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df kept in the checkpoint folder that all executors share; a lost executor costs nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_anew(df: DataFrame) -> DataFrame:
    """As cut, and the planner forgets its estimate of the size, too.

    A checkpoint keeps the estimate of its plan. A loop that joins a table with itself multiplies that in each
    round, and after some rounds planning is arithmetic on numbers of millions of digits.
    """
    spark = df.sparkSession
    kept = cut(df)
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), spark)


def sorted_join(df: DataFrame) -> DataFrame:
    """df, which the next join with it sorts and never sends through the driver, however few bytes its shuffle has."""
    return df.hint("merge")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application: a small archive beside what --py-files gives."""
    import os
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="codeloom-")), "codeloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent).as_posix())
    sc.addPyFile(archive)
