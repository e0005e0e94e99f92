"""Reading the tables of the shared folder inside the Python workers, and giving all of them work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def open_shared(path: str):
    """A Parquet file by its URI; of a scheme that pyarrow knows (file, hdfs, s3, gs, abfss)."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, inner = pafs.FileSystem.from_uri(path)
    return pq.ParquetFile(fs.open_input_file(inner))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer pieces than there are cores, dealt out to all of them; any other as it is, without a shuffle.

    Only the plan depends on the size: a corpus of many pieces is read where it lies.
    """
    lanes = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(lanes) if scan.rdd.getNumPartitions() < lanes else scan
