"""Classification metrics over scored rows, for many runs at once.

Input rows: ``<keys...>, label_id INT, l ARRAY<DOUBLE>`` (class scores / logits).
Every function takes ``keys`` (the run columns) and computes all runs in one job;
heavy passes are partial aggregations, and every window runs over pre-aggregated
tables, in balanced ranges of them or over one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmax(l: Column) -> Column:
    """Index of the largest score, first one on ties (0-based)."""
    return (F.array_position(l, F.array_max(l)) - 1).cast("int")


def softmax(l: Column) -> Column:
    """Row-wise stable softmax."""
    m = F.array_max(l)
    e = F.transform(l, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def class_probs(df: DataFrame, cols) -> DataFrame:
    """Long form ``cols.., label_id, cls, prob`` of the row-wise softmax.

    Staged through columns so that every exp and the row sum are computed once
    (a sum inside the element lambda would be re-evaluated for every element), and
    exploded with ``posexplode_outer`` (arrays are never empty) so that no inferred
    filter re-evaluates the chain.
    """
    cols = list(cols)
    d = df.select(*cols, "label_id", "l", F.array_max("l").alias("_m"))
    d = d.select(*cols, "label_id", F.transform("l", lambda x: F.exp(x - F.col("_m"))).alias("_e"))
    d = d.select(*cols, "label_id", "_e", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x).alias("_s"))
    d = d.select(*cols, "label_id", "_s", F.posexplode_outer("_e").alias("cls", "_x"))
    return d.select(*cols, "label_id", "cls", (F.col("_x") / F.col("_s")).alias("prob"))


def one_hot(label_id: Column, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                       lambda c: (c == label_id).cast("int"))


def with_pred(df: DataFrame) -> DataFrame:
    return df.withColumn("pred", argmax(F.col("l")))


def confusion(scored: DataFrame, keys) -> DataFrame:
    """Counts per (true, predicted) class; map-side combined, output is runs x C x C."""
    return with_pred(scored).groupBy(*keys, "label_id", "pred").agg(F.count(F.lit(1)).alias("n"))


def per_class(conf: DataFrame, keys, carry=()) -> DataFrame:
    """Precision, recall, F1 and support per class; classes = union of true and predicted.

    An undefined ratio (no predictions, no support) is 0. ``carry`` names additive
    columns of ``conf`` summed per true class and kept in the output.
    """
    sides = F.array(F.struct(F.col("label_id").alias("cls"), F.lit(True).alias("is_true")),
                    F.struct(F.col("pred").alias("cls"), F.lit(False).alias("is_true")))
    e = conf.select(*keys, "n", *carry, (F.col("label_id") == F.col("pred")).alias("hit"),
                    F.explode(sides).alias("s"))
    g = e.groupBy(*keys, F.col("s.cls").alias("cls")).agg(
        F.sum(F.when(F.col("s.is_true"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("s.is_true"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("s.is_true") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        *[F.sum(F.when(F.col("s.is_true"), F.col(c)).otherwise(0)).alias(c) for c in carry])

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return (g.withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
             .withColumn("recall", ratio(F.col("tp"), F.col("support")))
             .withColumn("f1", ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))
             .select(*keys, F.col("cls").cast("int").alias("cls"), "precision", "recall", "f1",
                     F.col("support").cast("bigint").alias("support"),
                     F.col("tp").cast("bigint").alias("tp"),
                     F.col("predicted").cast("bigint").alias("predicted"), *carry))


def macro(pc: DataFrame, keys) -> DataFrame:
    return pc.groupBy(*keys).agg(F.avg("precision").alias("macro_precision"),
                                 F.avg("recall").alias("macro_recall"),
                                 F.avg("f1").alias("macro_f1"))


def report(pc: DataFrame, keys) -> DataFrame:
    """Per-class rows plus accuracy, macro avg and weighted avg rows."""
    cls_rows = pc.select(*keys, F.col("cls").cast("string").alias("row"), "precision", "recall",
                         "f1", "support")
    tot = pc.groupBy(*keys).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    null = F.lit(None).cast("double")
    rows = F.array(
        F.struct(F.lit("accuracy").alias("row"), null.alias("precision"), null.alias("recall"),
                 (F.col("tp") / F.col("n")).alias("f1")),
        F.struct(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1")),
        F.struct(F.lit("weighted avg").alias("row"), (F.col("wp") / F.col("n")).alias("precision"),
                 (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1")))
    summ = tot.select(*keys, F.col("n").cast("bigint").alias("support"), F.explode(rows).alias("r")) \
              .select(*keys, "r.row", "r.precision", "r.recall", "r.f1", "support")
    return cls_rows.unionByName(summ)


def roc_auc_ovr(scored: DataFrame, keys) -> DataFrame:
    """Per-class one-vs-rest ROC AUC on softmax probabilities (ties count one half).

    U = sum over positives of (negatives below + negatives tied / 2):
    1. pre-aggregate to (keys, class, score) -> positives, negatives (map-side combined,
       so a score value held by a third of all rows is one row);
    2. range-partition on (keys, class, score): Spark samples the bounds, so every task
       gets a balanced, contiguous score range whatever the score distribution (many
       distinct scores in a narrow interval do not pile up in one task);
    3. a window inside each range gives the range's own negatives below a score, and so the
       part of U formed inside the range, with its positives and negatives: one row per
       class and range;
    4. a window over that small table adds the negatives of the class's lower ranges.
    AUC = U / (P * N); a class without positives or negatives gets NaN.
    """
    ck = [*keys, "cls"]
    p = class_probs(scored, keys)
    agg = p.groupBy(*ck, F.col("prob").alias("score")).agg(
        F.sum((F.col("label_id") == F.col("cls")).cast("long")).alias("pos"),
        F.sum((F.col("label_id") != F.col("cls")).cast("long")).alias("neg"))
    rows = agg.repartitionByRange(*ck, "score").withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy(*ck, "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    part = rows.groupBy(*ck, "_range").agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lower = Window.partitionBy(*ck).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("below", F.coalesce(F.sum("neg").over(lower), F.lit(0)))
    per = part.groupBy(*ck).agg(F.sum(F.col("u") + F.col("pos").cast("double") * F.col("below")).alias("u"),
                                F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return per.select(*ck, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                  F.col("u") / (F.col("P").cast("double") * F.col("N")))
                      .otherwise(F.lit(float("nan"))).alias("auc"))


def macro_auc(per_class_auc: DataFrame, keys) -> DataFrame:
    """Mean over classes; NaN if any class is undefined (as the one-vs-rest score fails)."""
    return per_class_auc.groupBy(*keys).agg(F.avg("auc").alias("macro_roc_auc_ovr"))


def cross_entropy(l: Column, label_id: Column, m: Column) -> Column:
    """logsumexp(l) - l[label] with the row maximum ``m`` staged as a column."""
    lse = m + F.log(F.aggregate(F.transform(l, lambda x: F.exp(x - m)), F.lit(0.0), lambda a, x: a + x))
    return lse - F.element_at(l, label_id + 1)


def loss_and_steps(scored: DataFrame, keys, batch: int) -> DataFrame:
    """Mean cross-entropy (logsumexp(l) - l[label]), rows and ceil(rows / batch) steps, one pass."""
    d = scored.select(*keys, "label_id", "l", F.array_max("l").alias("_m"))
    ce = cross_entropy(F.col("l"), F.col("label_id"), F.col("_m"))
    g = d.groupBy(*keys).agg(F.avg(ce).alias("loss"), F.count(F.lit(1)).alias("n_rows"))
    return g.withColumn("steps", F.ceil(F.col("n_rows") / batch).cast("bigint"))


def bundle(scored: DataFrame, keys, batch: int) -> DataFrame:
    """Macro P/R/F1, macro ROC AUC, loss, rows and steps per run: two passes over the rows.

    Pass 1 aggregates the confusion cells together with their cross-entropy sums; the
    sums ride along the per-class aggregation, so loss and row count come out of the
    same per-run aggregate as the macro metrics. Pass 2 is the ROC AUC.
    """
    keys = list(keys)
    d = scored.select(*keys, "label_id", "l", F.array_max("l").alias("_m"))
    ce = cross_entropy(F.col("l"), F.col("label_id"), F.col("_m"))
    cells = d.groupBy(*keys, "label_id", argmax(F.col("l")).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(ce).alias("ce_sum"), F.count(ce).alias("ce_n"))
    pc = per_class(cells, keys, carry=("ce_sum", "ce_n"))
    out = pc.groupBy(*keys).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), (F.sum("ce_sum") / F.sum("ce_n")).alias("loss"),
        F.sum("support").alias("n_rows"))
    out = out.withColumn("steps", F.ceil(F.col("n_rows") / batch).cast("bigint"))
    out = out.join(macro_auc(roc_auc_ovr(scored, keys), keys), keys)
    return out.select(*keys, "macro_precision", "macro_recall", "macro_f1", "macro_roc_auc_ovr",
                      "loss", "n_rows", "steps")
