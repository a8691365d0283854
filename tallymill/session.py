"""Session settings and the few facts the library reads from a running session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
# The JVM never compiles a method with more bytes.
_COMPILED_BYTES = 8000


def local_session(cores: int | str = "*", name: str = "tallymill", **conf: str) -> SparkSession:
    """Session for tests, benchmarks and laptops. On a cluster the caller brings its own.

    Nothing in the library depends on these settings for its results.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TALLYMILL_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # As limit_methods does; only tables as wide as all scored columns get there.
        .config(_METHOD_LIMIT, str(_COMPILED_BYTES))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def limit_methods(spark: SparkSession) -> None:
    """Lets Spark split a plan whose one method the JVM would never compile, instead of running it interpreted.

    A session's lower limit stays. It concerns the speed of plans, never their rows.
    """
    if int(spark.conf.get(_METHOD_LIMIT)) > _COMPILED_BYTES:
        spark.conf.set(_METHOD_LIMIT, str(_COMPILED_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: the one already set, else ``spark.checkpoint.dir``.

    Only a local master falls back to a temporary folder. On a cluster such a folder would die with its
    machine, so a missing setting is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallymill-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession) -> str:
    """Where this application keeps what it writes for itself, below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tallymill-{spark.sparkContext.applicationId}"


def delete_work_files(spark: SparkSession) -> None:
    """Deletes all that this application kept there. Results not yet read from it are gone too, so call it at the end of a run."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
