"""Session helpers: local builder for tests and bench, and the shared work folder."""
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores="*", app="coverlens", shuffle_partitions=8):
    """A local session for tests and measurements; clusters bring their own."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per column
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .getOrCreate())


def checkpoint_root(spark):
    """The folder every executor can reach, as the cluster names it.

    Only a local session that names none gets a temporary folder; on a cluster
    a machine-local folder would lose data with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="coverlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_dir(spark, name):
    """A fresh folder for tables written by one run."""
    return f"{checkpoint_root(spark).rstrip('/')}/coverlens/{name}-{uuid.uuid4().hex}"


def materialize(df, name, by=()):
    """Write and read back: cuts lineage in a way that survives lost executors. ``by`` names columns with a folder per value."""
    path = work_dir(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
