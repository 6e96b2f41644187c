"""Session defaults and durable intermediate results."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Grouping into nested lists has many keys per task; keep it hash based for longer.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    # The JVM never compiles a method beyond 8000 bytes; wide projections run several times faster
    # when Spark splits them into operators instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the defaults that a running session can still take."""
    for key, value in SESSION_CONF.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    return spark


def get_session(app_name="thermocline", master=None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A local session that names none gets a fresh temporary folder; a cluster session must name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="thermocline-")
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, for written intermediate tables."""
    return f"{shared_dir(spark).rstrip('/')}/thermocline-{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table or file that was written for the moment, wherever Spark's writers reach."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so a lost executor cannot change the rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
