"""Session set-up, lineage cutting and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "themeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    Nothing here sizes the cluster: partition counts are left to AQE, which starts
    from `spark.sql.shuffle.partitions` and coalesces or splits at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


_SHIPPED: set[str] = set()
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application: tasks import it.

    A session that leaves the rows of an Arrow batch at Spark's default gets fewer: texts are long, and a task
    holds a batch more than once.
    """
    if spark.conf.get(_ARROW_ROWS) == "10000":
        spark.conf.set(_ARROW_ROWS, "1024")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="themeloom-code-")) / "themeloom.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    A local session (tests) may leave it unset and gets a fresh temporary folder. A
    cluster session must name one: a machine-local folder would not survive the loss of
    the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="themeloom-")
    return _LOCAL_FOLDERS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{app_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: reliable, and without lineage.

    A written table is used rather than `checkpoint()` because it brings its true size.
    A checkpointed frame keeps the size estimate of its plan, and in a loop of joins
    those estimates multiply round by round, which hides small tables from the planner
    and in the end costs more than the jobs. `codec` is for tables of long texts.
    """
    spark = df.sparkSession
    path = f"{app_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that `cut` wrote and that nothing will read again; a loop would pile them up otherwise."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if f"/themeloom-{spark.sparkContext.applicationId}/" in folder:
            _delete(spark, folder)


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends: a series of jobs that hand over tables never reads them again.

    Left to themselves they stay until the driver happens to collect garbage. A session that has the setting keeps its own.
    """
    if spark.conf.get(_SHUFFLE_CLEANUP, None) is not None:
        yield
        return
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLE_CLEANUP)


def app_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/themeloom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once its results are written."""
    _delete(spark, app_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame) -> DataFrame:
    """Cache for reuse; a lost block is recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def only_row(df: DataFrame) -> Column:
    """The single row of `df` as a struct, for use in another table's expressions.

    It becomes a scalar subquery, which is run once, and not a join.
    """
    return df.select(F.struct("*").alias("row")).scalar()
