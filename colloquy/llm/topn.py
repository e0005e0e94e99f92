"""Top N items within every group by statistics-guided skipping of row groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .shared import open_shared

CATALOG = "path string, rg int, single boolean, g0 long, g1 long, top double, rows long"


def _constant(column) -> bool:
    """Whether the statistics prove that all values of a column chunk are the same."""
    st = column.statistics
    if st is None or not st.has_null_count:
        return False
    if st.null_count == column.num_values:
        return True
    return st.null_count == 0 and st.has_min_max and st.min == st.max


def _footers(columns: list[str]):
    """One row per row group, from the footers alone; a missing statistic never lets it be skipped.

    columns: the group columns.  Row groups inside a single group are told by all of them, not by the hashes alone.
    """

    def read(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                file = open_shared(path)
                meta, names = file.metadata, file.schema_arrow.names
                for i in range(meta.num_row_groups):
                    rg = meta.row_group(i)
                    top = rg.column(names.index("score")).statistics
                    single = all(_constant(rg.column(names.index(c))) for c in ("gkey", "gkey2", *columns))
                    key = [rg.column(names.index(c)).statistics.min if single else 0 for c in ("gkey", "gkey2")]
                    rows.append((path, i, single, *key, float(top.max) if top is not None and top.has_min_max else float("inf"), rg.num_rows))
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["path", "rg", "single", "g0", "g1", "top", "rows"])

    return read


def _changes(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns; nulls equal each other."""
    out = np.zeros(t.num_rows, bool)
    out[0] = True
    for c in columns:
        col = t.column(c)
        same = pa.compute.equal(col.slice(1), col.slice(0, len(col) - 1))
        nulls = col.is_null().to_numpy()
        out[1:] |= ~np.where(nulls[1:] & nulls[:-1], True, same.fill_null(False).to_numpy())
    return out


def _reader(n: int, columns: list[str]):
    """Reads row groups; of each run of equal groups, sorted by score, only its first n rows go on."""

    def read(batches):
        for batch in batches:
            for path, rg in zip(batch.column("path").to_pylist(), batch.column("rg").to_pylist()):
                t = open_shared(path).read_row_group(rg, columns=columns).combine_chunks()
                if not t.num_rows:
                    continue
                group = _changes(t, columns[:-2])
                new = group | _changes(t, columns[-2:])  # a row delivered twice stands next to itself
                nth = np.cumsum(new)
                at = np.maximum.accumulate(np.where(group, nth, 0))
                yield from t.filter(pa.array(new & (nth - at < n))).to_batches()

    return read


def top_n_per_group(
    items: DataFrame, groups: Sequence[str], score: str, key: str, n: int, row_group_rows: int = 20_000, report: dict | None = None
) -> DataFrame:
    """The n items of highest score in every group; of equal scores the smaller key goes first.

    The items are written clustered by (group, score descending): the range
    partitioning is on group, score and key, so a group with millions of items
    spreads over many files.  Row groups are then read in rounds of descending maximum
    score.  A row group that holds the start of a group is always read; one that
    lies inside a single group is skipped when its maximum is strictly below that
    group's current n-th score.  Equal maxima are read, since a smaller key may win.
    A round doubles the row groups it takes per group, so rounds are few.  Each
    read keeps at most n rows per group and row group; the window that merges
    them never sees a whole group.  The tasks read row groups with pyarrow, so the shared folder
    must be of a scheme it knows (file, hdfs, s3, gs, abfss).  Runs eagerly.  Groups smaller than a row group
    leave nothing to skip: their row groups hold the start of a group and are read once.
    report: takes the number of row groups there are (``row_groups``) and the number read (``read``).

    Defined cases: null and NaN scores and null keys take no part; null group
    values form a group; equal rows count once; an empty table gives no rows;
    a group with fewer than n items gives fewer rows.
    Result: the group columns, ``place`` from 1, the key, the score.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "topn")
    s = F.col(score).cast("double")
    gcols = [f"c{i}" for i in range(len(groups))]
    base = items.filter(s.isNotNull() & ~F.isnan(s) & F.col(key).isNotNull()).select(
        F.xxhash64(*groups).alias("gkey"), F.xxhash64(F.lit(1), *groups).alias("gkey2"), *[F.col(g).alias(a) for g, a in zip(groups, gcols)],
        F.col(key).alias("key"), s.alias("score"),
    )
    order = ["gkey", "gkey2", *gcols, F.desc("score"), "key"]
    clustered = scratch.save(
        base.repartitionByRange(*order).sortWithinPartitions(*order), "clustered",
        **{"parquet.block.row.count.limit": str(row_group_rows), "parquet.page.size.row.check.min": "1000"},
    )
    files = [(p,) for p in clustered.inputFiles()]
    listing = spark.createDataFrame(files, "path string")
    lanes = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    catalog = scratch.save(listing.repartition(lanes).mapInArrow(_footers(gcols), CATALOG), "catalog")

    columns = [*gcols, "key", "score"]
    schema = clustered.select(*columns).schema
    best = Window.partitionBy(*gcols).orderBy(F.desc("score"), "key")
    inside = Window.partitionBy("g0", "g1").orderBy(F.desc("top"), "path", "rg")
    # single: row groups within one group, numbered by descending maximum
    single = catalog.filter("single").withColumn("turn", F.row_number().over(inside))
    picks = catalog.filter("not single").select("path", "rg").unionByName(single.filter("turn = 1").select("path", "rg"))
    kept, done, step = None, 1, 1
    if report is not None:
        report |= {"row_groups": catalog.count(), "read": 0}
    while True:
        if report is not None:
            report["read"] += picks.count()
        found = picks.repartition(lanes).mapInArrow(_reader(n, columns), schema)
        if kept is not None:
            found = found.unionByName(kept)
        found = found.distinct().withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)
        now = scratch.save(found.select(*columns), "kept")
        if kept is not None:
            scratch.drop(kept)
        kept = now
        floors = kept.groupBy(*gcols).agg(F.count(F.lit(1)).alias("have"), F.min("score").alias("nth"))
        floors = floors.groupBy(F.xxhash64(*gcols).alias("g0"), F.xxhash64(F.lit(1), *gcols).alias("g1")).agg(
            F.min(F.when(F.col("have") >= n, F.col("nth")).otherwise(F.lit(float("-inf")))).alias("floor")
        )
        left = single.filter(F.col("turn") > done).join(floors, ["g0", "g1"], "left").filter("floor is null or top >= floor")
        picks = left.filter(F.col("turn") <= done + step).select("path", "rg")
        if left.isEmpty():
            break
        done, step = done + step, step * 2
    scratch.drop(clustered, catalog)
    ranked = kept.withColumn("place", F.row_number().over(best))
    return ranked.select(*[F.col(a).alias(g) for g, a in zip(groups, gcols)], "place", F.col("key").alias(key), F.col("score").alias(score))


def latest_per_item(rows: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str]) -> DataFrame:
    """Of each key's rows only the one latest by ``at``; a map-side combined aggregate, no window.

    A null time is earliest; of rows equal in time the greater payload stands,
    so the result does not depend on the order of the rows.
    """
    values = F.struct(*payload)
    top = F.max_by(values, F.struct(at, *payload)).alias("top")
    return rows.groupBy(*keys).agg(top).select(*keys, "top.*")
