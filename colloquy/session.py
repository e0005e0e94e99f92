"""Session helpers: table access and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per application.

    Spark's own file server hands the archive out, so executors need neither the repository nor a path.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="colloquy-")) / "colloquy_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and the master is local (tests, a laptop) a
    temporary folder is made and set as the checkpoint folder; a cluster must name one.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="colloquy-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


_open: dict[str, object] = {}


def _delete(where: str, conf) -> None:
    path = SparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(conf).delete(path, True)


def _clear(roots: list[str] | None = None) -> None:
    """Removes the folders of tables that are still there."""
    for root in list(_open) if roots is None else roots:
        conf = _open.pop(root, None)
        try:
            if conf is not None:
                _delete(root, conf)
        except Exception:  # the JVM is gone; the folder's owner clears it
            pass


def _clear_on_stop(spark: SparkSession) -> None:
    """Tables go when the session is stopped, or else when the driver ends."""
    sc = spark.sparkContext
    if "_colloquy_stop" in sc.__dict__:
        return
    stop = sc._colloquy_stop = sc.stop

    def clear_and_stop() -> None:
        _clear()
        stop()

    sc.stop = clear_and_stop
    atexit.register(_clear)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Tables written inside are removed at the end: read or write a result before that.

    with scratch_scope():
        queries["turn_batches"](spark, base).write.parquet(out)
    """
    before = set(_open)
    try:
        yield
    finally:
        _clear([r for r in _open if r not in before])


class Scratch:
    """Tables written to the shared folder so that a lost executor costs a re-read, not a re-run.

    ``save`` writes a DataFrame and returns a reader of what was written;
    ``drop`` removes tables that no later step reads.  What a lazy result still reads is removed at the end of the
    ``scratch_scope`` it was made in, when the session is stopped, or when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        _clear_on_stop(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/colloquy-{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        _open[self.root] = self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        where = self.path(name)
        df.write.options(**({"compression": "zstd"} | options)).parquet(where)
        return self.load(where, df.schema)

    def load(self, where: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        out = reader.parquet(where)
        out._colloquy_path = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            where = getattr(t, "_colloquy_path", None)
            if where:
                _delete(where, self.conf)
