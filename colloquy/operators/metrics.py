"""Classification and ranking metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import running

MISSING = "__missing__"


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def _f(beta2: float, p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise((1 + beta2) * p * r / (beta2 * p + r))


def confusion(rows: DataFrame, actual: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of (actual, guess) pairs; a null guess is ``__missing__``."""
    pair = rows.filter(F.col(actual).isNotNull()).select(*by, F.col(actual).alias("actual"), F.coalesce(F.col(guess), F.lit(MISSING)).alias("guess"))
    return pair.groupBy(*by, "actual", "guess").agg(F.count(F.lit(1)).alias("n"))


def per_class(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of every label that occurs on either side.

    Works on the confusion counts, whose size is that of the label domain squared.
    """
    hit = F.when(F.col("actual") == F.col("guess"), F.col("n")).otherwise(0)
    sides = matrix.select(*by, F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named"), hit.alias("tp"))
    sides = sides.unionByName(
        matrix.filter(F.col("guess") != MISSING).select(*by, F.col("guess").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named"), F.lit(0).cast("long").alias("tp"))
    )
    out = sides.groupBy(*by, "label").agg(F.sum("support").alias("support"), F.sum("named").alias("named"), F.sum("tp").alias("tp"))
    p, r = ratio(F.col("tp"), F.col("named")), ratio(F.col("tp"), F.col("support"))
    return out.select(*by, "label", "support", p.alias("precision"), r.alias("recall"), _f(1.0, p, r).alias("f1"))


def report(rows: DataFrame, actual: str, guess: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, accuracy, macro means and missing rate."""
    matrix = confusion(rows, actual, guess, by)
    total = matrix.groupBy(*by).agg(
        F.sum("n").alias("count"), F.sum(F.when(F.col("actual") == F.col("guess"), F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("guess") == MISSING, F.col("n")).otherwise(0)).alias("missing"),
    )
    macro = per_class(matrix, by).groupBy(*by).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1")
    )
    joined = total.join(macro, list(by)) if by else total.crossJoin(macro)  # one row by one row
    return joined.select(
        *by, "count", ratio(F.col("hits"), F.col("count")).alias("accuracy"), "macro_precision", "macro_recall", "macro_f1",
        ratio(F.col("missing"), F.col("count")).alias("missing_rate"),
    )


def multilabel(rows: DataFrame, actual: str, guess: str) -> DataFrame:
    """Exact matches and micro precision, recall, F1 of label sets; null sets are empty."""
    a, g = (F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in (actual, guess))
    sums = rows.select(
        F.size(F.array_intersect(a, g)).alias("tp"), F.size(F.array_except(g, a)).alias("fp"), F.size(F.array_except(a, g)).alias("fn")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("int")).alias("exact"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        ratio(F.col("exact"), F.col("n")).alias("exact_match"), p.alias("micro_precision"), r.alias("micro_recall"),
        _f(1.0, p, r).alias("micro_f1"), F.col("fp").alias("false_detections"), F.col("fn").alias("missed_detections"),
    )


def at_thresholds(rows: DataFrame, label: str, score: str, extra: Sequence[float] = (0.0, 1.0)) -> DataFrame:
    """Binary counts and metrics at every distinct score and the extra thresholds, ``score >= t`` being positive.

    Scores are counted per value first, so the distributed running sums go over distinct values; thresholds
    never meet all rows.
    """
    fine = rows.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    counted = fine.groupBy(F.col(score).cast("double").alias("t")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    spark = rows.sparkSession
    ends = spark.createDataFrame([(float(x), 0, 0) for x in extra], "t double, pos long, neg long")
    counted = counted.unionByName(ends).groupBy("t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    all_ = counted.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n")).first()
    c = running(counted, [], [F.desc("t")], ["pos", "neg"])
    c = c.select("t", F.col("pos_cum").alias("tp"), F.col("neg_cum").alias("fp"), F.lit(all_["p"]).alias("p"), F.lit(all_["n"]).alias("n"), F.col("pos").alias("at_pos"))
    tp, fp = F.col("tp"), F.col("fp")
    pr, rc = ratio(tp, tp + fp), ratio(tp, F.col("p"))
    return c.select(
        F.col("t").alias("threshold"), pr.alias("precision"), rc.alias("recall"), _f(1.0, pr, rc).alias("f1"), _f(0.25, pr, rc).alias("f05"),
        tp.alias("true_positive"), fp.alias("false_positive"), (F.col("p") - tp).alias("false_negative"), (F.col("n") - fp).alias("true_negative"), "at_pos",
    )


def calibrate(thresholds: DataFrame, least_precision: float = 0.95) -> DataFrame:
    """The threshold of greatest (recall, F0.5, threshold) among those precise enough, or among all if none is."""
    ok = F.col("precision") >= least_precision
    key = F.struct(ok.cast("int").alias("ok"), "recall", "f05", "threshold")
    columns = [c for c in thresholds.columns if c != "at_pos"]
    return thresholds.agg(F.max_by(F.struct(*columns), key).alias("b")).select("b.*")


def average_precision(thresholds: DataFrame) -> DataFrame:
    """Sum of precision at each score times the recall it adds."""
    return thresholds.agg(ratio(F.sum(F.col("precision") * F.col("at_pos")), F.max("true_positive")).alias("average_precision"))


def hash_split(rows: DataFrame, stratum: str, key: str, salt: str, holdout: int) -> DataFrame:
    """The first ``holdout`` rows of each stratum by salted sha256 are held out."""
    digest = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    w = Window.partitionBy(stratum).orderBy("digest", key)
    first = rows.withColumn("digest", digest).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= holdout).select(key)
    marked = rows.join(first.withColumn("held", F.lit(True)), key, "left")
    return marked.withColumn("split", F.when(F.col("held"), "holdout").otherwise("development")).drop("held")


def nearest_rank(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """sorted[ceil(p * n) - 1] for each share p."""
    return rows.groupBy(*by).agg(*[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{int(p * 100)}") for p in shares])


def tie_ranks(rows: DataFrame, group: Sequence[str], column: str, name: str) -> DataFrame:
    """Per group and value the mean rank of the rows that have it, from counts per value and their running sums."""
    counted = rows.groupBy(*group, column).agg(F.count(F.lit(1)).alias("n"))
    cum = running(counted, group, [F.col(column)], ["n"])
    return cum.select(*group, column, (F.col("n_cum") - (F.col("n") - 1) / 2.0).alias(name))


def spearman(rows: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson over mean ranks; 0 where one side does not vary or a group has one row."""
    pairs = rows.groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("w"))
    ranked = pairs.join(tie_ranks(rows, group, x, "rx"), [*group, x]).join(tie_ranks(rows, group, y, "ry"), [*group, y])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    m = ranked.groupBy(*group).agg(F.sum("w").alias("n"), *[F.sum(w * c).alias(k) for k, c in (("x", rx), ("y", ry), ("xx", rx * rx), ("yy", ry * ry), ("xy", rx * ry))])
    n = F.col("n")
    cov, vx, vy = n * F.col("xy") - F.col("x") * F.col("y"), n * F.col("xx") - F.col("x") ** 2, n * F.col("yy") - F.col("y") ** 2
    return m.select(*group, "n", ratio(cov, F.sqrt(F.greatest(vx * vy, F.lit(0.0)))).alias("spearman"))


def kendall(rows: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """(concordant - discordant) / both, pairs tied on a side left out; x holds integers from 0 to 2^31.

    No pairs are listed.  Two values of x differ first at one bit below a common prefix; so for
    each bit the rows are counted by (prefix, y) and each bit value, and running sums in y order tell how
    many of the other value come before.  That is rows times bits of work, spread by (group, bit, prefix).
    """
    top = rows.agg(F.max(x)).first()[0] or 0
    bits = F.explode(F.sequence(F.lit(0), F.lit(max(0, int(top).bit_length() - 1)))).alias("bit")
    spread = rows.select(*group, F.col(x).cast("long").alias("x"), F.col(y).alias("y"), bits)
    one = F.expr("shiftright(x, bit) & 1")
    counted = spread.groupBy(*group, "bit", F.expr("shiftright(x, bit + 1)").alias("prefix"), "y").agg(F.sum(one).alias("ones"), F.sum(1 - one).alias("zeros"))
    cum = running(counted, [*group, "bit", "prefix"], [F.col("y")], ["ones", "zeros"])
    c = F.sum(F.col("ones") * (F.col("zeros_cum") - F.col("zeros")))
    d = F.sum(F.col("zeros") * (F.col("ones_cum") - F.col("ones")))
    return cum.groupBy(*group).agg(c.alias("c"), d.alias("d")).select(*group, ratio(F.col("c") - F.col("d"), F.col("c") + F.col("d")).alias("kendall"))


def ranking_quality(rows: DataFrame, group: Sequence[str], expert: str, predicted: str) -> DataFrame:
    """NDCG (gain 2^rel - 1), reciprocal rank of the expert's first, top-1 and top-3 hits per group; both columns are ranks from 1.

    rel is n + 1 - expert; gains are scaled by 2^-(n + 1), so one aggregate does without a window and no group is too large for a double.
    """
    e, p = F.col(expert), F.col(predicted)

    def sums(at: Column) -> tuple[Column, Column]:
        return F.sum(F.pow(F.lit(2.0), -e) / F.log2(at + 1)), F.sum(1 / F.log2(at + 1))

    (a, b), (c, d) = sums(p), sums(e)
    agg = rows.groupBy(*group).agg(F.pow(F.lit(2.0), -F.count(F.lit(1)) - 1).alias("k"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), F.min(F.when(e == 1, p)).alias("first"))
    return agg.select(
        *group, ratio(F.col("a") - F.col("k") * F.col("b"), F.col("c") - F.col("k") * F.col("d")).alias("ndcg"), ratio(F.lit(1), F.col("first")).alias("mrr"),
        (F.col("first") == 1).cast("double").alias("top1"), (F.col("first") <= 3).cast("double").alias("top3"),
    )


def errors(rows: DataFrame, by: Sequence[str], expected: str, got: str) -> DataFrame:
    """Mean absolute and root mean square error over rows where both are numbers."""
    d = F.col(expected) - F.col(got)
    fine = rows.filter(d.isNotNull() & ~F.isnan(d))
    return fine.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


def evenly(rows: DataFrame, pos: str, total: Column, limit: int) -> DataFrame:
    """Rows at index i * n // limit for i < limit, or all if there are no more; a deterministic sample."""
    wanted = F.floor(F.floor((F.col(pos) * limit + total - 1) / total) * total / limit)
    return rows.filter((total <= limit) | (wanted == F.col(pos)))
