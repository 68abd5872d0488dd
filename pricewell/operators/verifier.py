"""A verifier of matches: what the fused score leaves out, judged by a cross-validated classifier, and a cut chosen for recall."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.models.quantiles import exact_quantile
from pricewell.operators.matching import tokens
from pricewell.operators.text import normalise
from pricewell.sources.scratch import stored

FOLDS, RECALL = 5, 0.95
FEATURES = ["lexical", "semantic", "fused", "margin", "query_token_coverage", "variant_token_coverage", "unmatched_query_tokens", "digits_agree", "digits_conflict", "length_ratio", "unmatched_vs_item", "unmatched_vs_catalogue"]


def _share(part: Column, whole: Column) -> Column:
    return F.when(F.size(whole) > 0, F.size(part) / F.size(whole)).otherwise(0.0)


def features(candidates: DataFrame, variants: DataFrame) -> DataFrame:
    """text, item and ``FEATURES`` of each text's best candidate.

    candidates: text (normalised), item, lexical, semantic, fused, rank; variants:
    item, variant. The best item's variant that shares most words with the text
    stands for it. A word of the text that no variant of the item has, or none of
    the catalogue, is what tells a neighbour from the product itself.
    """
    known = variants.select("item", normalise(F.col("variant")).alias("variant")).where("variant != ''").distinct()
    best = candidates.where("rank = 1").join(candidates.where("rank = 2").select("text", F.col("fused").alias("_next")), "text", "left")
    words = known.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list(tokens(F.col("variant"))))).alias("_own"))  # an item's variants
    rows = best.join(known, "item").withColumns({"_q": F.array_distinct(tokens(F.col("text"))), "_v": F.array_distinct(tokens(F.col("variant")))})
    closest = Window.partitionBy("text").orderBy(F.desc(F.size(F.array_intersect("_q", "_v"))), F.size("_v"), "variant")
    rows = rows.withColumn("_k", F.row_number().over(closest)).where("_k = 1").join(words, "item")
    everywhere = known.select(F.explode(tokens(F.col("variant"))).alias("_w")).distinct()
    unknown = rows.select("text", F.explode("_q").alias("_w")).join(everywhere, "_w", "left_anti").groupBy("text").agg(F.count("*").alias("_unknown"))
    rows = rows.join(unknown, "text", "left")
    both, digits = F.array_intersect("_q", "_v"), lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))))
    mine, theirs = digits(F.col("text")), digits(F.col("variant"))
    long = F.greatest(F.length("text"), F.length("variant"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    made = {
        "margin": F.col("fused") - F.coalesce("_next", F.lit(0.0)),
        "query_token_coverage": _share(both, F.col("_q")),
        "variant_token_coverage": _share(both, F.col("_v")),
        "unmatched_query_tokens": F.size(F.array_except("_q", "_v")).cast("double"),
        "digits_agree": flag(mine == theirs),
        "digits_conflict": flag((F.size(mine) > 0) & (F.size(theirs) > 0) & (mine != theirs)),
        "length_ratio": F.when(long > 0, F.least(F.length("text"), F.length("variant")) / long).otherwise(0.0),
        "unmatched_vs_item": _share(F.array_except("_q", "_own"), F.col("_q")),
        "unmatched_vs_catalogue": F.when(F.size("_q") > 0, F.coalesce("_unknown", F.lit(0)) / F.size("_q")).otherwise(0.0),
    }
    return rows.withColumns(made).select("text", "item", *FEATURES)


def cross_validated(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """rows with score: the probability of ``correct`` (0 or 1) by a logistic model of the other folds. A text's hash chooses its fold, so equal texts are never on both sides. A fold whose others have one class alone is scored by that class."""
    rows = stored(VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows).withColumns({"_fold": F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int"), "_y": F.col("correct").cast("double")}), "verifier-rows")
    out = None
    for fold in range(folds):
        others, own = rows.where(F.col("_fold") != fold), rows.where(F.col("_fold") == fold)
        low, high = others.agg(F.min("_y"), F.max("_y")).first()
        if low == high:
            judged = own.withColumn("score", F.lit(low).cast("double"))
        else:
            model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1e-3, maxIter=50).fit(others)
            judged = model.transform(own).withColumn("score", vector_to_array("probability")[1])
        judged = judged.drop("_x", "_y", "_fold", "rawPrediction", "probability", "prediction")
        out = judged if out is None else out.unionByName(judged)
    return out


def judged(scored: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row: n, auc, cut, recall and precision at it, kept. The cut is the highest score that keeps ``recall`` of the correct matches. No row without correct and wrong ones."""
    rows = stored(scored.select("score", F.col("correct").cast("double").alias("correct")), "verifier-scores")
    counts = rows.groupBy("correct").count().collect()  # two rows
    if len(counts) < 2:
        return rows.sparkSession.createDataFrame([], "n long, auc double, cut double, recall double, prec double, kept double")
    auc = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="correct").evaluate(rows)
    right = next(r["count"] for r in counts if r["correct"] == 1.0)
    lost = math.floor((1.0 - recall) * right)  # so many of the correct ones may go
    cut = exact_quantile(rows.where("correct = 1"), "score", lost / max(right - 1, 1))
    kept = F.col("score") >= F.lit(cut - 1e-12)
    hit = F.sum(F.when(kept, F.col("correct")).otherwise(0.0))
    return rows.agg(F.count("*").alias("n"), F.lit(auc).alias("auc"), F.lit(cut).alias("cut"), (hit / F.sum("correct")).alias("recall"), (hit / F.count_if(kept)).alias("prec"), F.avg(kept.cast("double")).alias("kept"))
