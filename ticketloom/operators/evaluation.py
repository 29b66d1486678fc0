"""Accuracy of labelled samples. Rows: item_id, stratum, predicted, method, human_label, notes."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.clean import ratio, round_exact


def apply_labels(sample: DataFrame, corrections: DataFrame) -> DataFrame:
    """Reviewer corrections by item; an item without one agrees with the prediction."""
    given = corrections.select("item_id", F.col("human_label").alias("_label"), F.col("notes").alias("_notes"))
    kept = [c for c in sample.columns if c not in ("human_label", "notes")]
    old_notes = F.col("notes") if "notes" in sample.columns else F.lit("")
    return sample.join(given, "item_id", "left").select(
        *kept,
        F.coalesce("_label", "predicted").alias("human_label"),
        F.coalesce("_notes", old_notes).alias("notes"))


def _right():
    return F.coalesce(F.col("human_label") == F.col("predicted"), F.lit(False))


def accuracy(labelled: DataFrame) -> DataFrame:
    n, agree = F.count(F.lit(1)), F.count_if(_right())
    return labelled.where("stratum = 'theme'").agg(
        n.alias("n"), agree.alias("agree"), ratio(agree, n).alias("accuracy"))


def accuracy_by_method(labelled: DataFrame) -> DataFrame:
    n, agree = F.count(F.lit(1)), F.count_if(_right())
    return labelled.where("stratum = 'theme'").groupBy("method").agg(
        n.alias("n"), agree.alias("agree"), ratio(agree, n).alias("accuracy"))


def theme_errors(labelled: DataFrame) -> DataFrame:
    return labelled.where((F.col("stratum") == "theme") & ~_right()).select(
        "item_id", "predicted", "human_label", "notes")


def confusion(labelled: DataFrame, positive: str = "same-issue") -> DataFrame:
    """Confusion counts, precision, recall and F1; 0 where a denominator is empty."""
    said, true = F.col("predicted") == positive, F.col("human_label") == positive
    cells = labelled.where("stratum = 'repeat'").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))
    zero = F.lit(0.0)
    rates = cells.withColumn(
        "_p", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero)
    ).withColumn("_r", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero))
    f1 = F.coalesce(F.try_divide(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), zero)
    return rates.select("n", "tp", "fp", "fn", "tn", round_exact(F.col("_p"), 3).alias("precision"),
                        round_exact(F.col("_r"), 3).alias("recall"), round_exact(f1, 3).alias("f1"))


def confusion_errors(labelled: DataFrame, positive: str = "same-issue") -> DataFrame:
    """False positives and false negatives, one row each."""
    said, true = F.col("predicted") == positive, F.col("human_label") == positive
    return labelled.where((F.col("stratum") == "repeat") & (said != true)).select(
        "item_id", F.when(said, F.lit("fp")).otherwise(F.lit("fn")).alias("kind"))


def refund_review(labelled: DataFrame) -> DataFrame:
    return labelled.where("stratum = 'refund'").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("human_label") == "confirmed-violation").alias("same_ticket_confirmed"),
        F.count_if(F.col("human_label") == "violation").alias("same_order_violations"))
