"""Label tables, thresholds and network measures."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_weights(labels: DataFrame) -> DataFrame:
    """One label per content with the weight of its trust tier, shared over its versions.

    ``labels`` holds ``object_id, content, tier``. Versions are counted per content before the join back.
    """
    tier = F.when(F.col("tier") == "manual", 1.0).when(F.col("tier") == "rule", 0.5).otherwise(0.2)
    distinct = labels.groupBy("content", "object_id").agg(F.max(tier).alias("w"))
    versions = distinct.groupBy("content").agg(F.count("*").alias("versions"))
    return distinct.join(versions, "content").select("object_id", "content", (F.col("w") / F.col("versions")).alias("weight"))


def grouped_folds(cases: DataFrame, k: int) -> DataFrame:
    """Fold of every case by its id, so all rows of a case share one fold."""
    return cases.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.col("case_id").cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int"))


def confusion_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 per operation; ``rows`` holds ``truth, predicted``."""
    t = rows.groupBy(F.col("truth").alias("op")).agg(F.count("*").alias("support"), F.count_if(F.col("truth") == F.col("predicted")).alias("hits"))
    p = rows.groupBy(F.col("predicted").alias("op")).agg(F.count("*").alias("predicted"))
    joined = t.join(p, "op", "full_outer").fillna(0)
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return joined.select("op", "support", "predicted", "hits", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def zero_error_threshold(rows: DataFrame) -> DataFrame:
    """Smallest score among eligible unsafe rows, 0 when there is none: the acceptance limit."""
    return rows.agg(F.coalesce(F.min(F.when(F.col("eligible") & F.col("unsafe"), F.col("score"))), F.lit(0.0)).alias("threshold"))


def softmax_share(rows: DataFrame, key: str) -> DataFrame:
    """Softmax of scores per key; the sum is aggregated first and joined back."""
    top = rows.groupBy(key).agg(F.max("score").alias("_m"))
    shifted = rows.join(top, key).withColumn("_e", F.exp(F.col("score") - F.col("_m")))
    total = shifted.groupBy(key).agg(F.sum("_e").alias("_t"))
    return shifted.join(total, key).withColumn("confidence", F.col("_e") / F.col("_t")).drop("_m", "_e", "_t")


def graph_edit(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edit between two networks: COPY, UPDATE, SPLIT, CREATE or DROP.

    ``old`` holds ``id, value``; ``new`` holds ``id, parent_id, value``.
    """
    parts = new.groupBy("parent_id").agg(F.count("*").alias("n"))
    a = old.select("id", F.col("value").alias("_o"))
    b = new.select("parent_id", F.col("id").alias("new_id"), F.col("value").alias("_n")).join(parts, "parent_id", "left")
    joined = a.join(b, a.id == b.parent_id, "full_outer")
    op = (F.when(F.col("new_id").isNull(), "DROP").when(F.col("id").isNull(), "CREATE").when(F.col("n") > 1, "SPLIT").when(F.col("_o") == F.col("_n"), "COPY").otherwise("UPDATE"))
    return joined.select("id", "new_id", op.alias("op"))


def candidate_sets(rows: DataFrame) -> DataFrame:
    """Candidates of several sources, one per canonical content, with the sources they came from."""
    return rows.groupBy("content").agg(F.min("candidate_id").alias("candidate_id"), F.count("*").alias("copies"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))


def label_scope(rows: DataFrame, frozen: DataFrame) -> DataFrame:
    """Whether an object may be labelled or only serves as context."""
    joined = rows.join(frozen.select("object_id").distinct().withColumn("_f", F.lit(True)), "object_id", "left")
    return joined.select("object_id", F.when(F.col("_f") | ~F.col("in_scope"), "context_only").otherwise("eligible").alias("scope"))
