"""Tables written in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder of this machine only where it is unset, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return known or f"file://{tempfile.gettempdir()}/talweg-shared"


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one. It is deleted when the driver's Python ends; one that a killed driver leaves
    has the application's id as its name."""
    path = f"{shared_dir(spark).rstrip('/')}/talweg-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_delete, spark, path)
    return path


_OWN: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Once a table is written, nothing reads the shuffles that made it; small batches keep Python workers small.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextmanager
def _written(spark: SparkSession):
    conf = spark.conf
    before = {k: conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            conf.set(k, v) if v else conf.unset(k)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, a lost executor costs no earlier work."""
    path = f"{own_dir(df.sparkSession)}/talweg-{name}-{uuid.uuid4().hex}"
    with _written(df.sparkSession):
        df.write.parquet(path)
    trim()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of stored() that nothing reads any more; what was made of it has been stored."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark, path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """stored() in buckets of a key, one for each shuffle partition: groups and joins on the key then read a bucket in place."""
    spark = df.sparkSession
    table = f"talweg_{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _written(spark):
        df.write.bucketBy(n, key).option("path", f"{own_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def drop_bucketed(df: DataFrame) -> None:
    """Deletes a table of bucketed() that nothing reads any more."""
    files = df.inputFiles()
    name = files[0].split("/")[-2] if files else None
    discard(df)
    if name:
        df.sparkSession.sql(f"drop table if exists {name}")


def free(name: str, df: DataFrame) -> str:
    """name, with underscores until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(df: DataFrame) -> DataFrame:
    """An aggregate that is to be joined on its own keys, dealt out anew before. Both sides of the join are then shuffled for the
    join alone, and Spark can split a key that holds much of the other side."""
    return df.hint("rebalance")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that their workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_talweg_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="talweg-")) / "talweg-code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    context._talweg_shipped = True


def trim() -> None:
    """Gives memory that Python and Arrow have freed back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if give:
        give(0)


def _lean(run: Callable) -> Callable:
    """run, in a worker that gives freed memory back to the system: idle workers stay alive and would hold it."""

    def lean(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim()

    return lean


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow of a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(_lean(run), schema)
