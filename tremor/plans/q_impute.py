"""Registered queries: imputation (P35, P36/J8), encoding (P27-P29) and the
classification plan (M4, M5, M18, A8, A27)."""

from __future__ import annotations

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tremor.functions.scalars import time_parts
from tremor.operators.cleaning import only_kind, range_filter
from tremor.operators.common import attach_row
from tremor.operators.encode import align, assemble, one_hot
from tremor.operators.impute import impute_knn_many, impute_median
from tremor.operators.rollup import class_summary
from tremor.operators.stats import class_metrics
from tremor.operators.together import side_by_side
from tremor.plans.catalog import register
from tremor.plans.classification import mag_class, prepare, score, train_classifier
from tremor.plans.report import finalize, r6
from tremor.plans.sqlparts import WITH_QUAKE
from tremor.session import materialize
from tremor.sources.files import load_model, save_model
from tremor.sources.views import quake
from tremor.streaming.events import stream_place

# The network vocabulary of the one-hot encoding (the event
# kinds present in the catalogue feed).
NET_VOCAB = ["click", "error", "purchase", "search", "view"]

PREP_SQL = f"""{WITH_QUAKE},
    src AS (SELECT *, hour(time_utc) AS hour FROM quake
            WHERE type = 'earthquake' AND coalesce(depth_km BETWEEN 0 AND 700 AND mag BETWEEN 2 AND 9, false))"""


def _knn_sql(target: str) -> str:
    return f"""d_{target} AS (SELECT id AS did, latitude, longitude, hour, {target} AS v FROM src WHERE {target} IS NOT NULL),
    r_{target} AS (SELECT DISTINCT latitude, longitude, hour FROM src WHERE {target} IS NULL),
    p_{target} AS (SELECT r.latitude, r.longitude, r.hour, d.did, d.v,
                  0.0 + (r.latitude - d.latitude) * (r.latitude - d.latitude)
                  + (r.longitude - d.longitude) * (r.longitude - d.longitude)
                  + (r.hour - d.hour) * (r.hour - d.hour) AS d2
           FROM r_{target} r, d_{target} d),
    m_{target} AS (SELECT latitude, longitude, hour, avg(v) AS knn FROM (
             SELECT *, row_number() OVER (PARTITION BY latitude, longitude, hour ORDER BY d2, did) AS rn FROM p_{target})
           WHERE rn <= 5 GROUP BY latitude, longitude, hour)"""


@register("P36_J8_knn_impute", f"""{PREP_SQL}, {_knn_sql('gap')}, {_knn_sql('rms')}
    SELECT src.id, {r6('coalesce(src.gap, m_gap.knn)')} AS gap, {r6('coalesce(src.rms, m_rms.knn)')} AS rms
    FROM src
    LEFT JOIN m_gap ON src.latitude = m_gap.latitude AND src.longitude = m_gap.longitude AND src.hour = m_gap.hour
    LEFT JOIN m_rms ON src.latitude = m_rms.latitude AND src.longitude = m_rms.longitude AND src.hour = m_rms.hour""")
def q_knn(spark, sf_dir):
    """Exact 5-NN mean imputation of gap and rms on (lat, lon, hour); the
    oracle is brute force over all receiver x donor pairs."""
    df = range_filter(only_kind(quake(spark, sf_dir)))
    df = df.withColumn("hour", time_parts("time_utc")["hour"])
    df = impute_knn_many(df, ["gap", "rms"], ("latitude", "longitude", "hour"), k=5)
    return finalize(df.select("id", "gap", "rms"))


@register("P35_median_impute", f"""{PREP_SQL},
    m AS (SELECT median(gap) AS mg, median(rms) AS mr, median(nst) AS mn FROM src)
    SELECT id, {r6('coalesce(gap, mg)')} AS gap, {r6('coalesce(rms, mr)')} AS rms, {r6('coalesce(nst, mn)')} AS nst
    FROM src, m""")
def q_median(spark, sf_dir):
    df = range_filter(only_kind(quake(spark, sf_dir))).select("id", "gap", "rms", F.col("nst").cast("double").alias("nst"))
    return finalize(impute_median(df, ["gap", "rms", "nst"]))


_OH = ", ".join(f"CASE WHEN net = '{v}' THEN 1 ELSE 0 END AS net_{v}" for v in NET_VOCAB + ["absent"])


@register("P27_P28_one_hot_align", f"""{WITH_QUAKE}
    SELECT id, {_OH}, {r6('0.0')} AS not_in_data FROM quake""")
def q_one_hot(spark, sf_dir):
    """Fixed-vocabulary one-hot ('absent' never occurs -> zeros) and alignment
    to a model column list that includes a feature the data lacks (-> 0)."""
    df = one_hot(quake(spark, sf_dir), "net", NET_VOCAB + ["absent"])
    names = [f"net_{v}" for v in NET_VOCAB + ["absent"]]
    out = align(df, names + ["not_in_data"], keep=["id"])
    return finalize(out.withColumns({n: F.col(n).cast("bigint") for n in names}))


_KEPT: dict[tuple, tuple] = {}


def _table_state(spark, sf_dir) -> tuple:
    """What tells whether the events table is the one seen before: the session
    and a checksum of its file listing (no file is opened)."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf_dir.rstrip('/')}/events.parquet")
    files = listing.select(F.xxhash64("path", F.unix_micros("modificationTime"), "length").alias("h"))
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h")).first()
    return spark.sparkContext.applicationId, sf_dir, seen.n, seen.h


def _prepared(spark, sf_dir):
    """The prepared catalogue and its feature names: computed once per session
    and table into the shared checkpoint folder, then read by every query."""
    key = ("rows", *_table_state(spark, sf_dir))
    if key not in _KEPT:
        rows, names = prepare(quake(spark, sf_dir), NET_VOCAB)
        _KEPT[key] = materialize(rows), names
    return _KEPT[key]


def _held_out():
    """A fifth of the events by id hash, never fitted on."""
    return F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)) == 0


def _fitted(spark, sf_dir):
    """The forest fitted on four fifths of the prepared catalogue, and where it
    is saved: fitted once per session and table."""
    rows, names = _prepared(spark, sf_dir)
    key = ("model", *_table_state(spark, sf_dir))
    if key not in _KEPT:
        model = train_classifier(rows.where(~_held_out()), names)
        _KEPT[key] = model, save_model(model, stream_place(spark, "class-model"))
    return rows, names, *_KEPT[key]


def _loaded(spark, sf_dir):
    rows, names, _, path = _fitted(spark, sf_dir)
    return rows, names, load_model(RandomForestClassificationModel, path)


@register("L2_M4_M5_classification")
def q_classify(spark, sf_dir):
    """Serving classification: fitted on four fifths of the prepared catalogue
    (label = class cut of the magnitude), saved, loaded again, every event
    scored; ``held_out`` marks the events that were not fitted on."""
    rows, names, model = _loaded(spark, sf_dir)
    # sorted before they are scored: a sort reads its rows twice, once for its ranges
    ordered = rows.orderBy(F.desc("time_utc"), "id")
    return finalize(score(model, ordered, names).withColumn("held_out", _held_out().cast("bigint")))


@register("S11_model_round_trip")
def q_model_round_trip(spark, sf_dir):
    """Scores of a fitted model and of the same model saved and loaded, per
    class: both counts, equal rows, and accuracy and macro-F1 on the held-out
    events."""
    rows, names, model, path = _fitted(spark, sf_dir)
    loaded = load_model(RandomForestClassificationModel, path)
    a = score(model, rows, names).select("id", "mag", F.col("mag_class_id").alias("before"))
    b = score(loaded, rows, names).select("id", F.col("mag_class_id").alias("after"))
    both = materialize(a.join(b, "id").withColumn("label", mag_class()))
    held = class_metrics(both.where(_held_out() & F.col("label").isNotNull()), "label", "after").drop("n")
    per = both.groupBy(F.col("before").alias("mag_class_id")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("before") == F.col("after")).alias("equal"))
    return finalize(attach_row(per, held))


_SCORED_SQL = f"""{PREP_SQL}
    SELECT count(*) AS events, count(DISTINCT id) AS ids, count(*) AS equal, count(*) AS classes_known, count(*) AS labels_fit,
           count(*) AS probabilities_fit, 1 AS beats_majority FROM src"""


@register("S11_M4_M5_scored_events", _SCORED_SQL)
def q_scored_events(spark, sf_dir):
    """What holds of every scored event, counted: the saved and loaded model
    gives the fitted one's class, the class is known and has the label of its
    class, the probabilities add up and the class is their greatest; and the
    held-out accuracy is above that of the commonest class."""
    from tremor.functions.bands import class_symbol, label_class
    rows, names, model, path = _fitted(spark, sf_dir)
    loaded = load_model(RandomForestClassificationModel, path)
    before = score(model, rows, names).select("id", F.col("mag_class_id").alias("before"))
    data = assemble(rows, names)
    proba = vector_to_array(F.col("probability"))
    raw = loaded.transform(data).select("id", proba.alias("p"), F.col("prediction").cast("int").alias("greatest"))
    after = score(loaded, rows, names).select("id", "mag", "mag_class_id", "mag_class", "emoji")
    cls = F.col("mag_class_id")
    all_rows = materialize(after.join(before, "id").join(raw, "id").withColumn("label", mag_class()).withColumn("held", _held_out()))
    told = all_rows.agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("id").alias("ids"), F.count_if(cls == F.col("before")).alias("equal"),
        F.count_if(cls.isin(0, 1, 2)).alias("classes_known"),
        F.count_if((F.col("mag_class") == label_class(cls)) & (F.col("emoji") == class_symbol(cls))).alias("labels_fit"),
        F.count_if((F.abs(F.aggregate("p", F.lit(0.0), lambda s, x: s + x) - 1) < 1e-9) & (F.element_at("p", cls.cast("int") + 1) == F.array_max("p"))
                   & (F.col("greatest") == cls)).alias("probabilities_fit"),
        F.avg(F.when(F.col("held") & F.col("label").isNotNull(), (cls == F.col("label")).cast("int"))).alias("hit"),
        *[F.avg(F.when(F.col("held") & F.col("label").isNotNull(), (F.col("label") == c).cast("int"))).alias(f"share_{c}") for c in range(3)])
    return finalize(told.withColumn("beats_majority", F.col("hit") >= F.greatest(*[f"share_{c}" for c in range(3)])).drop("hit", *[f"share_{c}" for c in range(3)]))


@register("A8_class_summary")
def q_class_summary(spark, sf_dir):
    """Header counts of the classification document."""
    rows, names, model = _loaded(spark, sf_dir)
    return finalize(class_summary(score(model, rows, names)))


@register("P29_feature_vectors", f"""{WITH_QUAKE}
    SELECT id, {r6('latitude')} AS v0, {r6('longitude')} AS v1, {r6('depth_km')} AS v2, {r6('tsunami')} AS v3, 4 AS width FROM quake
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND depth_km IS NOT NULL AND tsunami IS NOT NULL""")
def q_feature_vectors(spark, sf_dir):
    """Feature vectors on the row of their event: entries in the order of the names."""
    names = ["latitude", "longitude", "depth_km", "tsunami"]
    rows = quake(spark, sf_dir).dropna(subset=names)
    v = vector_to_array(F.col("features"))
    return finalize(assemble(rows, names).select("id", *[v[i].alias(f"v{i}") for i in range(4)], F.size(v).alias("width")))


@register("A27_class_metrics", f"""{WITH_QUAKE},
    d AS (SELECT CASE WHEN mag < 4.0 THEN 0 WHEN mag < 6.0 THEN 1 ELSE 2 END AS y,
                 CASE WHEN depth_km < 250 THEN 0 WHEN depth_km < 600 THEN 1 ELSE 2 END AS yhat
          FROM quake WHERE mag IS NOT NULL AND depth_km IS NOT NULL),
    c AS (SELECT y AS k FROM d UNION SELECT yhat FROM d),
    p AS (SELECT k, (SELECT count(*) FROM d WHERE y = k AND yhat = k) AS tp, (SELECT count(*) FROM d WHERE y = k) AS nt,
                 (SELECT count(*) FROM d WHERE yhat = k) AS np FROM c)
    SELECT {r6('sum(tp) / sum(nt)')} AS accuracy, {r6('avg(CASE WHEN nt + np = 0 THEN 0.0 ELSE 2.0 * tp / (nt + np) END)')} AS f1_macro,
           CAST(sum(nt) AS BIGINT) AS n FROM p""")
def q_class_metrics(spark, sf_dir):
    """Accuracy and macro-F1 of a depth rule against the magnitude class."""
    df = quake(spark, sf_dir).where("mag is not null and depth_km is not null")
    rule = F.when(F.col("depth_km") < 250, 0).when(F.col("depth_km") < 600, 1).otherwise(2)
    return finalize(class_metrics(df.select(mag_class().alias("y"), rule.alias("yhat"))))


@register("M18_A27_compare_classifiers")
def q_compare_classifiers(spark, sf_dir):
    """Forest, boosted trees (one-vs-rest), decision tree, logistic regression
    and linear SVM (one-vs-rest) on an 80/20 split by id hash; accuracy and
    macro-F1 per model, best first."""
    rows, names = _prepared(spark, sf_dir)
    data = assemble(rows.withColumn("label", mag_class().cast("double")).where("label is not null"), names).select("id", "features", "label")
    data = materialize(data.withColumn("__test", _held_out()))
    train, test = data.where(~F.col("__test")), data.where(F.col("__test"))
    models = {
        "random_forest": RandomForestClassifier(numTrees=50, maxDepth=8, seed=42),
        "gbt_ovr": OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=5, seed=42)),
        "decision_tree": DecisionTreeClassifier(maxDepth=8, seed=42),
        "logistic": LogisticRegression(maxIter=100),
        "linear_svc_ovr": OneVsRest(classifier=LinearSVC(maxIter=100)),
    }
    def measured(name, est):
        return class_metrics(est.fit(train).transform(test), "label", "prediction").withColumn("model", F.lit(name))

    out = None
    for m in side_by_side(spark, [lambda name=name, est=est: measured(name, est) for name, est in models.items()]):
        out = m if out is None else out.unionByName(m)
    return finalize(out.orderBy(F.desc("f1_macro"), "model"))


_CLASS_SQL = "CASE WHEN mag < 4.0 THEN 0 WHEN mag < 6.0 THEN 1 ELSE 2 END"


@register("P19_label_class", f"""{WITH_QUAKE}
    SELECT id, CAST({_CLASS_SQL} AS BIGINT) AS mag_class_id,
           CASE {_CLASS_SQL} WHEN 0 THEN 'Faible' WHEN 1 THEN 'Modéré' ELSE 'Strong' END AS mag_class,
           CASE {_CLASS_SQL} WHEN 0 THEN '🟢' WHEN 1 THEN '🟡' ELSE '🔴' END AS emoji
    FROM quake WHERE type = 'earthquake' AND mag IS NOT NULL""")
def q_label_class(spark, sf_dir):
    """Magnitude class (our cuts, SURVEY D11) mapped to label and marker."""
    from tremor.functions.bands import class_symbol, label_class
    df = only_kind(quake(spark, sf_dir)).where(F.col("mag").isNotNull())
    cls = mag_class()
    return finalize(df.select("id", cls.alias("mag_class_id"), label_class(cls).alias("mag_class"),
                              class_symbol(cls).alias("emoji")))


@register("A8_class_counts_rule", f"""{WITH_QUAKE}
    SELECT count(*) AS total, count_if({_CLASS_SQL} = 0) AS count_faible,
           count_if({_CLASS_SQL} = 1) AS count_modere, count_if({_CLASS_SQL} = 2) AS count_strong
    FROM quake WHERE type = 'earthquake' AND mag IS NOT NULL""")
def q_class_counts_rule(spark, sf_dir):
    """Per-class counts and total (document header) over the magnitude classes."""
    df = only_kind(quake(spark, sf_dir)).where(F.col("mag").isNotNull())
    return finalize(class_summary(df.withColumn("mag_class_id", mag_class())))
