"""Session factory and the folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

#: Folders made for sessions on one machine, by application.
_folders: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "sondera", **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps.

    A master or a number of shuffle partitions that the cluster already names
    is left alone; only what is given here is set.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # what was settled goes when no frame needs it any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """The session of tests and of the benchmark on one machine."""
    return build_session(
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": str(cores),
            "spark.driver.memory": memory,
            "spark.ui.showConsoleProgress": "false",
        },
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset, as in tests on one machine,
    a temporary folder is made, which goes when the process ends.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        own = spark.sparkContext.applicationId
        if own not in _folders:
            made = tempfile.mkdtemp(prefix="sondera-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _folders[own] = "file://" + made
        folder = _folders[own]
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Compute a frame once and cut its lineage, in the shared folder.

    The files are in storage that outlives executors, so a lost executor costs
    no recomputation and later stages read what was written. In sessions of
    ``build_session`` they are deleted once no frame refers to them.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = shared_folder(spark)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(os.path.join(folder, "lineage"))
    return df.checkpoint(eager=True)
