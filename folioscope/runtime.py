"""Session helpers: shared folder, staged tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Holds the largest bounded side, 100,000 words with 200-wide vectors, with room to spare.
BROADCAST_BYTES = 256 * 1024 * 1024

_own_dirs: dict[str, str] = {}
_own_paths: dict[str, list[str]] = {}


def ship(module: str) -> None:
    """Send the functions and classes of a module to tasks as they are, so that executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def build_session(app: str, cores: str = "*", **conf: str) -> SparkSession:
    """Session for tests and benchmarks; on a cluster spark-submit supplies the settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: spark.checkpoint.dir, or a scratch one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="folioscope-")
        atexit.register(shutil.rmtree, _own_dirs[context.applicationId], ignore_errors=True)
    return _own_dirs[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder nobody has used yet."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _own_paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_staged(spark: SparkSession) -> int:
    """Delete everything this session has staged so far; returns the number of paths.

    Results that still read staged tables are lost, so call it when they are written or collected.
    Only paths that `new_path` made are touched. Scratch folders of local mode also go at exit.
    """
    paths = _own_paths.pop(spark.sparkContext.applicationId, [])
    context = spark.sparkContext
    for path in paths:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Cuts lineage so that lost executors cost a re-read, not a re-run, and gives the
    optimizer true file sizes for its own broadcast decision.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(col: Column, kind: T.DataType) -> Column | None:
    """In-memory size of a value; None for types that cannot be measured (user-defined ones)."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, (T.AtomicType, T.ArrayType, T.MapType, T.StructType)):
            return None
        if isinstance(kind.elementType, T.AtomicType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType)):
            return F.greatest(F.size(col), F.lit(1)).cast("bigint") * 8 + 16
        if _bytes(col, kind.elementType) is None:
            return None
        return F.coalesce(F.aggregate(
            col, F.lit(16).cast("bigint"), lambda total, x: total + _bytes(x, kind.elementType)), F.lit(16))
    if isinstance(kind, T.MapType):
        parts = [_bytes(F.map_keys(col), T.ArrayType(kind.keyType)), _bytes(F.map_values(col), T.ArrayType(kind.valueType))]
        return None if any(p is None for p in parts) else parts[0] + parts[1]
    if isinstance(kind, T.StructType):
        parts = [_bytes(col[f.name], f.dataType) for f in kind.fields]
        return None if any(p is None for p in parts) else sum(parts, F.lit(16).cast("bigint"))
    return F.lit(16).cast("bigint") if isinstance(kind, T.AtomicType) else None


def measured_bytes(df: DataFrame) -> int | None:
    """In-memory size of all rows, computed on the executors; None where a column cannot be measured."""
    parts = [_bytes(F.col(f"`{field.name}`"), field.dataType) for field in df.schema.fields]
    if any(p is None for p in parts):
        return None
    return df.agg(F.coalesce(F.sum(sum(parts, F.lit(16).cast("bigint"))), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring `df`; larger and unmeasurable sides stay ordinary shuffle
    joins, where adaptive execution splits hot keys. `df` runs for the measurement, so give a staged one."""
    size = measured_bytes(df)
    return F.broadcast(df) if size is not None and size <= max_bytes else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute a scan that has fewer tasks than the cluster has cores; otherwise unchanged.

    Meant for expensive row work on small or single-block inputs. Call it on plain scans (asking a
    plan with joins for its tasks would run their shuffles) and give a unique `key`.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df
