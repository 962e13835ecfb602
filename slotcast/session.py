"""Session helpers: the shared folder for checkpoints and written tables."""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import constants as K

PACKAGE = Path(__file__).resolve().parent
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Codec of the tables in the shared folder, which lie there beside the shuffle files.
CODEC = "zstd"
_sweeping, _lock = {"depth": 0, "before": None}, threading.Lock()
_own = threading.local()  # open scopes and slices of this thread


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "slotcast"):
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: Python workers import it by name."""
    context = spark.sparkContext
    if any(Path(p).name.startswith(f"{PACKAGE.name}-") for p in context._python_includes):
        return
    path = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    active = context.getCheckpointDir()
    if named:
        if active is None:
            context.setCheckpointDir(named)
        return named
    if active:
        return active
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="slotcast-")
    context.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the tables stored inside go when each is stored, not when the driver collects garbage.

    Fits may store tables side by side, so the last one out puts the setting back.
    """
    with _lock:
        if _sweeping["depth"] == 0:
            _sweeping["before"] = spark.conf.get(SWEEP, None)
        _sweeping["depth"] += 1
        spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        with _lock:
            _sweeping["depth"] -= 1
            if _sweeping["depth"] == 0:
                spark.conf.unset(SWEEP) if _sweeping["before"] is None else spark.conf.set(SWEEP, _sweeping["before"])


class Scratch:
    """Paths of the tables that were stored while a ``scratch`` was open."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def free(self, *kept: DataFrame) -> None:
        """Delete these tables but the ``kept`` ones, which ``stored`` returned.

        Only for tables that no later step reads: a frame that was not stored itself may read any of them.
        """
        left = _read(self.paths, *kept)
        _delete(self.spark, [p for p in self.paths if p not in left])
        self.paths = left


def discard(df: DataFrame) -> None:
    """Delete the table that ``stored`` returned as ``df``, if a scratch that is open collected it."""
    for made in getattr(_own, "scopes", ()):
        gone = _read(made.paths, df) if made.paths else []
        _delete(made.spark, gone)
        made.paths = [p for p in made.paths if p not in gone]


def _read(paths: list[str], *frames: DataFrame) -> list[str]:
    files = [f for df in frames for f in df.inputFiles()]
    return [p for p in paths if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files)]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Collect the tables stored inside, so that they can go when the next one is stored.

    Nothing is deleted but by ``free`` and ``discard``; what is left at the end belongs to the scratch around this one.
    """
    scopes = _own.__dict__.setdefault("scopes", [])
    made = Scratch(spark)
    scopes.append(made)
    try:
        yield made
    finally:
        scopes.remove(made)
        if scopes:
            scopes[-1].paths += made.paths


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a table that goes with the open scratch, if there is one."""
    path = new_path(spark, label)
    if scopes := getattr(_own, "scopes", None):
        scopes[-1].paths.append(path)
    return path


@contextmanager
def sliced(key: str, rows: int) -> Iterator[None]:
    """Tables stored inside are made in slices by the hash of ``key``, about one per ``SLICE_ROWS`` rows.

    For a join by ``key`` of many wide rows: each slice of both sides is exchanged and stored before the next
    one, so only one lies on disk.  Every slice scans the inputs, so there are ``MAX_SLICES`` at most.
    """
    before = getattr(_own, "slices", None)
    _own.slices = (key, min(math.ceil(rows / K.SLICE_ROWS), K.MAX_SLICES))
    try:
        yield
    finally:
        _own.slices = before


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    For wide tables of many rows that are read again and again: each later pass reads its columns only.
    """
    path = scratch_path(df.sparkSession, label)
    key, n = getattr(_own, "slices", None) or ("", 1)
    # another hash than that of exchanges, or a slice would fill only some of their partitions
    parts = [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)] if n > 1 else [df]
    with swept(df.sparkSession):
        for part in parts:  # the new frame takes the setting
            part.select("*").write.mode("append").option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """The same rows and partitions; code is generated for what comes before and what comes after on its own.

    Long chains over many columns would otherwise become one method that the compiler of the JVM leaves alone.
    """
    return df.coalesce(K.MOST_PARTITIONS)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep the result in the shared folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    with swept(df.sparkSession):
        return df.select("*").checkpoint()  # the new frame takes the setting
