"""L2 — event classification: one lazy plan from raw events to scored rows.

kind filter (P6) -> physical range filter (P7) -> time parts (P10) ->
log1p features (P13) -> KNN imputation of gap and rms (P36) -> one-hot of
the network (P27) -> median imputation (P35) -> alignment (P28) ->
vector (P29) -> classifier scores (M4) -> labels and percentages
(P18, P19) -> summary counts (A8).  Identity columns stay on the row.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.bands import class_symbol, label_class
from tremor.functions.scalars import inf_to_null, log1p0, pct, time_parts
from tremor.operators.cleaning import only_kind, range_filter
from tremor.operators.encode import align, assemble, one_hot
from tremor.operators.impute import impute_knn_many, impute_median
from tremor.session import deal_evenly, materialize

# Numeric features of the classifier, in order.
FEATURES_NUM = ["latitude", "longitude", "gap", "rms", "tsunami", "depth_km_log", "nst_log",
                "dmin_log", "sig_log", "hour", "dayofweek", "month"]
# Our class cuts: <4, 4-<6, >=6.
CLASS_CUTS = (4.0, 6.0)


def mag_class(col: str = "mag"):
    """Class of a magnitude; NULL has none."""
    lo, hi = CLASS_CUTS
    return F.when(F.col(col) < lo, 0).when(F.col(col) < hi, 1).when(F.col(col) >= hi, 2)


def prepare(events: DataFrame, net_vocab: list[str], k: int = 5) -> DataFrame:
    """Feature rows for the classifier (serving preprocessing)."""
    rows = events.count()
    df = range_filter(only_kind(events))
    df = df.withColumns({c: inf_to_null(c) for c in ("gap", "rms", "dmin")})
    parts = time_parts("time_utc")
    df = df.withColumns({"hour": parts["hour"], "dayofweek": parts["dayofweek"], "month": parts["month"]})
    df = df.withColumns({f"{c}_log": log1p0(c) for c in ("depth_km", "nst", "dmin", "sig")})
    # written once: the medians, the fit and the scoring below all read it.  Dealt
    # evenly before and after: the filled rows come from a join, the others do not
    df = materialize(deal_evenly(df, rows))
    df = materialize(deal_evenly(impute_knn_many(df, ["gap", "rms"], ("latitude", "longitude", "hour"), k=k), rows))
    df = one_hot(df, "net", net_vocab)
    names = FEATURES_NUM + [f"net_{v}" for v in net_vocab]
    df = impute_median(df, FEATURES_NUM, exact=True)
    return align(df, names, keep=["id", "time_utc", "place", "mag", "depth_km"]), names


def train_classifier(train: DataFrame, names: list[str], num_trees: int = 50, max_depth: int = 8, seed: int = 42):
    """M5: random forest on the prepared features, label = magnitude class."""
    labelled = train.withColumn("label", mag_class().cast("double")).where(F.col("label").isNotNull())
    # written once: bins, bins' samples and bags each read all of it
    vec = materialize(assemble(labelled, names).select("features", "label"))
    rf = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                featuresCol="features", labelCol="label")
    return rf.fit(vec)


def score(model, rows: DataFrame, names: list[str]) -> DataFrame:
    """M4 + P18/P19: class, three probabilities in percent and confidence."""
    out = model.transform(assemble(rows, names))
    p = vector_to_array("probability")
    share = [pct(F.coalesce(F.get(p, i), F.lit(0.0))) for i in range(3)]      # 0 for a class the model never saw
    cls = F.col("prediction").cast("int")
    return out.select(
        "id", "time_utc", "place", "mag", "latitude", "longitude", "depth_km",
        cls.alias("mag_class_id"), class_symbol(cls).alias("emoji"), label_class(cls).alias("mag_class"),
        share[0].alias("prob_Faible"), share[1].alias("prob_Modere"), share[2].alias("prob_Strong"),
        pct(F.array_max(p)).alias("confiance"))
