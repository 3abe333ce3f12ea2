"""Queries of features, scores, metrics, splits and drift."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import fixed
from ..operators import learn, windows
from ..registry import query, table

FEATURES = """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 120)::DOUBLE END AS days, (c_custkey % 9)::DOUBLE AS commits, (c_custkey % 101) / 100.0::DOUBLE AS timeline, (c_custkey % 2)::DOUBLE AS scope_private,
  (c_custkey % 4)::DOUBLE AS patterns, (c_nationkey % 5) / 4.0::DOUBLE AS commit_pattern, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey % 11) / 10.0::DOUBLE END AS nlp, (c_custkey % 13) / 12.0::DOUBLE AS cross_package, (c_custkey % 17) / 16.0::DOUBLE AS behavioral,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 6) / 5.0::DOUBLE END AS review_ok, (c_nationkey % 3) / 2.0::DOUBLE AS popular, (c_custkey % 8) / 7.0::DOUBLE AS trusted FROM customer"""
VECTOR = f"""SELECT id, coalesce(days, 365.0) AS days, commits, timeline, scope_private, patterns, commit_pattern, coalesce(nlp, 0.0) AS nlp, cross_package, behavioral, 1 - coalesce(review_ok, 1.0) AS review, 1 - popular AS popularity, 1 - trusted AS trust FROM ({FEATURES})"""
NAMES = ["days", "commits", "timeline", "scope_private", "patterns", "commit_pattern", "nlp", "cross_package", "behavioral", "review", "popularity", "trust"]
W_ = fixed.ML_WEIGHTS
SCORE = (
    "least(1.0, " + " + ".join(f"{k} * {W_[k]}" for k in ("timeline", "commit_pattern", "nlp", "cross_package", "behavioral", "review", "popularity", "trust"))
    + f" + CASE WHEN scope_private = 1 THEN {W_['scope']} ELSE 0.0 END + CASE WHEN patterns > 0 THEN least({W_['patterns']}, 0.1 * patterns * {W_['patterns'] / 0.2}) ELSE 0.0 END + CASE WHEN commits < 5 AND days < 30 THEN {W_['low_activity']} ELSE 0.0 END)::DOUBLE"
)
P_ = fixed.PREDICTIVE_WEIGHTS
PREDICT = "least(1.0, CASE WHEN commits < 5 AND days < 90 THEN " + str(P_["low_activity"]) + " ELSE 0.0 END + " + " + ".join(f"{k} * {P_[k]}" for k in ("timeline", "commit_pattern", "nlp", "cross_package", "review", "popularity")) + ")::DOUBLE"


def vectors(spark, d):
    rows = table(spark, d, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    part = lambda c, m, s: ((c % m) / float(s))
    raw = rows.select(
        k.alias("id"), F.when(k % 7 != 0, (k % 120).cast("double")).alias("days"), (k % 9).cast("double").alias("commits"), part(k, 101, 100).alias("timeline"), (k % 2).cast("double").alias("scope_private"), (k % 4).cast("double").alias("patterns"),
        part(n, 5, 4).alias("commit_pattern"), F.when(k % 3 != 0, part(k, 11, 10)).alias("nlp"), part(k, 13, 12).alias("cross_package"), part(k, 17, 16).alias("behavioral"), F.when(k % 5 != 0, part(k, 6, 5)).alias("review_ok"),
        part(n, 3, 2).alias("popular"), part(k, 8, 7).alias("trusted"),
    )
    return learn.feature_vectors(raw)


@query("feature_vectors", f"SELECT id, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in NAMES)} FROM ({VECTOR})")
def feature_vectors(spark, d):
    return vectors(spark, d).select("id", *[F.round(c, 6).alias(c) for c in NAMES])


@query("threat_score", f"SELECT id, round({SCORE}, 6) AS threat_score FROM ({VECTOR})")
def threat_score(spark, d):
    return vectors(spark, d).select("id", F.round(learn.threat_score(), 6).alias("threat_score"))


@query("predictive_score", f"SELECT id, round({PREDICT}, 6) AS predictive_score FROM ({VECTOR})")
def predictive_score(spark, d):
    return vectors(spark, d).select("id", F.round(learn.predictive_score(), 6).alias("predictive_score"))


@query("ml_decision", f"""
SELECT id, above, NOT above AND p >= 0.4 AS at_risk FROM (SELECT id, p, s >= 0.7 OR timeline >= 0.7 AS above FROM (SELECT id, timeline, round({SCORE}, 9) AS s, round({PREDICT}, 9) AS p FROM ({VECTOR})))""")
def ml_decision(spark, d):
    scored = vectors(spark, d).withColumn("threat_score", F.round(learn.threat_score(), 9)).withColumn("predictive_score", F.round(learn.predictive_score(), 9))
    return learn.decide(scored).select("id", "above", "at_risk")


LABELLED = "(SELECT doc_id, toxic::INTEGER AS y, (doc_id % 97) / 96.0::DOUBLE AS p FROM labels WHERE toxic IS NOT NULL)"


def labelled(spark, d):
    return table(spark, d, "labels").where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("y"), ((F.col("doc_id") % 97) / 96.0).alias("p"))


@query("metrics_confusion", f"""
SELECT n, tp, fp, fn, tn, round(CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn) / n END, 4) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 4) AS recall
FROM (SELECT count(*)::BIGINT AS n, count(CASE WHEN y = 1 AND p >= 0.5 THEN 1 END)::BIGINT AS tp, count(CASE WHEN y = 0 AND p >= 0.5 THEN 1 END)::BIGINT AS fp, count(CASE WHEN y = 1 AND p < 0.5 THEN 1 END)::BIGINT AS fn, count(CASE WHEN y = 0 AND p < 0.5 THEN 1 END)::BIGINT AS tn FROM {LABELLED})""")
def metrics_confusion(spark, d):
    return learn.confusion(labelled(spark, d).withColumn("predicted", (F.col("p") >= 0.5).cast("int")), "y", "predicted")


@query("roc_auc", f"""
SELECT round((sum(CASE WHEN y = 1 THEN r END) - max(np) * (max(np) + 1) / 2) / (max(np) * max(nn)), 6)::DOUBLE AS auc FROM (
  SELECT y, avg(rn) OVER (PARTITION BY p) AS r, sum(y) OVER () AS np, sum(1 - y) OVER () AS nn FROM (SELECT y, p, row_number() OVER (ORDER BY p) AS rn FROM {LABELLED}))""")
def roc_auc(spark, d):
    return learn.roc_auc(labelled(spark, d), "y", "p")


@query("brier", f"SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM {LABELLED}")
def brier(spark, d):
    return learn.brier(labelled(spark, d), "y", "p")


@query("class_balance", f"SELECT count(CASE WHEN y = 0 THEN 1 END)::BIGINT AS negatives, count(CASE WHEN y = 1 THEN 1 END)::BIGINT AS positives, round(count(CASE WHEN y = 0 THEN 1 END) / count(CASE WHEN y = 1 THEN 1 END), 6)::DOUBLE AS positive_weight FROM {LABELLED}")
def class_balance(spark, d):
    return learn.class_balance(labelled(spark, d), "y")


@query("ks_drift", """
WITH v AS (SELECT round(value, 3) AS value, ts >= (SELECT min(ts) + INTERVAL 15 DAY FROM events) AS b FROM events), t AS (SELECT count(CASE WHEN NOT b THEN 1 END) AS na, count(CASE WHEN b THEN 1 END) AS nb FROM v),
c AS (SELECT DISTINCT value, count(CASE WHEN NOT b THEN 1 END) OVER (ORDER BY value) AS ca, count(CASE WHEN b THEN 1 END) OVER (ORDER BY value) AS cb FROM v)
SELECT round(max(abs(ca / na - cb / nb)), 6)::DOUBLE AS ks, max(abs(ca / na - cb / nb)) > 0.2 AS drifted FROM c, t""")
def ks_drift(spark, d):
    """Scores of the second half of the month against the first."""
    rows = table(spark, d, "events").select("ts", F.round("value", 3).alias("value"))
    border = rows.agg((F.min("ts") + F.expr("INTERVAL 15 DAYS")).alias("border"))
    return learn.ks_statistic(rows.crossJoin(F.broadcast(border)).select("value", (F.col("ts") >= F.col("border")).alias("current")), "value", "current")


@query("time_split", """
SELECT event_id, rn <= greatest(1, least(n - 1, round_even(n * 0.2, 0)))::BIGINT AS validation FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER () AS n FROM events)""")
def time_split(spark, d):
    return windows.time_split(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", 0.2).select("event_id", "validation")


@query("stratified_split", """
SELECT doc_id, y, rn <= floor(n * 0.2) AS validation FROM (
  SELECT doc_id, toxic::INTEGER AS y, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM labels WHERE toxic IS NOT NULL)""")
def stratified_split(spark, d):
    return learn.stratified_split(labelled(spark, d).select("doc_id", "y"), "y", "doc_id", 0.2)


@query("oversampled_balance", f"SELECT y, max(count(*)) OVER ()::BIGINT AS n FROM {LABELLED} GROUP BY y")
def oversampled_balance(spark, d):
    """Class counts after repeating the rarer class."""
    return learn.oversample(labelled(spark, d), "y", "doc_id").groupBy("y").agg(F.count("*").alias("n"))


@query("ks_stepped", """
WITH v AS (SELECT round(value, 1) AS value, event_type = 'click' AS b FROM events), g AS (SELECT value, count(*) FILTER (NOT b) AS a, count(*) FILTER (b) AS b FROM v GROUP BY value),
c AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, b, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM g WINDOW w AS (ORDER BY value))
SELECT round(max(greatest(abs(ca / na - cb / nb), abs(ca / na - (cb - b) / nb))), 6)::DOUBLE AS ks, max(greatest(abs(ca / na - cb / nb), abs(ca / na - (cb - b) / nb))) > 0.2 AS drifted FROM c""")
def ks_stepped(spark, d):
    """Values of clicks against all other events', the latter moving first on ties."""
    rows = table(spark, d, "events").select(F.round("value", 1).alias("value"), (F.col("event_type") == "click").alias("current"))
    return learn.ks_statistic(rows, "value", "current", stepped=True)


@query("newest_split", """
WITH e AS (SELECT event_id, event_type = 'error' AS y, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER () AS n FROM events)
SELECT event_id, y, rn <= greatest(1, least(n - 1, round_even(n * 0.2, 0)))::BIGINT AS validation FROM e""")
def newest_split(spark, d):
    """The newest fifth as validation, as both sides have both labels."""
    rows = table(spark, d, "events").select("event_id", "ts", (F.col("event_type") == "error").alias("y"))
    return learn.newest_or_stratified(rows, "ts", "y", "event_id", 0.2).select("event_id", "y", "validation")


#: A linear model's weights by feature, for batches and for SQL.
LINEAR = {"timeline": 2.0, "nlp": 1.5, "behavioral": -1.0, "patterns": 0.25, "trust": 0.5}


def linear_model():
    """What a worker loads once: a logistic model over the features in order."""
    import numpy as np

    weights = np.array(list(LINEAR.values()))

    def predict(batch: np.ndarray) -> np.ndarray:
        assert len(batch) <= 512
        return 1 / (1 + np.exp(-(batch.astype(np.float64) @ weights - 1.0)))

    return predict


@query("batch_scores", f"SELECT id, round(1 / (1 + exp(-({' + '.join(f'{k} * {w}' for k, w in LINEAR.items())} - 1.0))), 5)::DOUBLE AS score FROM ({VECTOR})")
def batch_scores(spark, d):
    """A model's scores, at most 512 rows at a time (M9)."""
    return vectors(spark, d).select("id", F.round(learn.batch_scores(linear_model, list(LINEAR)), 5).alias("score"))


@query("contribution_rows", f"""
WITH v AS ({VECTOR}), c AS ({' UNION ALL '.join(f"SELECT id, '{k}' AS feature, round({k}, 9)::DOUBLE * {fixed.ML_WEIGHTS.get(k, 0.0)}::DOUBLE AS value FROM v" for k in NAMES[2:])}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, feature) AS place FROM c WHERE value <> 0)
SELECT id, place, feature, round(value, 6) AS value FROM r WHERE place <= 3""")
def contribution_rows(spark, d):
    """The three features that move each score most, a row each."""
    rounded = vectors(spark, d).select("id", *[F.round(c, 9).alias(c) for c in NAMES])
    found = rounded.select("id", F.posexplode(learn.contributions(NAMES[2:], fixed.ML_WEIGHTS, 3)).alias("at", "c"))
    return found.select("id", (F.col("at") + 1).cast("long").alias("place"), "c.feature", F.round("c.value", 6).alias("value"))


@query("top_contributions")
def top_contributions(spark, d):
    """The features that drive each score most."""
    found = learn.contributions(NAMES[2:], fixed.ML_WEIGHTS, 3)
    return vectors(spark, d).select("id", found.alias("found")).select("id", F.to_json("found").alias("contributions"))


@query("gbt_train_eval")
def gbt_train_eval(spark, d):
    """Boosted trees trained on four fifths of the rows and scored on the rest (M5, M8, M9)."""
    rows = vectors(spark, d).withColumn("label", (F.round(learn.threat_score(), 9) >= 0.45).cast("double"))
    split = learn.stratified_split(rows, "label", "id", 0.2)
    model = learn.train_trees(split.where("NOT validation"), NAMES, "label", trees=5)
    scored = model.transform(split.where("validation").fillna(0.0, NAMES))
    return learn.confusion(scored.withColumn("y", F.col("label").cast("int")).withColumn("predicted", F.col("prediction").cast("int")), "y", "predicted")


@query("stacker")
def stacker(spark, d):
    """Two scores joined by a logistic model."""
    rows = vectors(spark, d).select("id", learn.threat_score().alias("a"), learn.predictive_score().alias("b"))
    rows = rows.withColumn("label", ((F.col("a") + F.col("b")) / 2 >= 0.35).cast("double"))
    model = learn.train_stacker(rows, "a", "b", "label")
    return model.transform(rows).select("id", F.round(vector_to_array("stacked_")[1], 4).alias("score"))
