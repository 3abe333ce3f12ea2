"""Feature vectors, rule-based scores, metrics, splits and drift, as aggregations and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import fixed
from .windows import running_sums, time_split


def feature_vectors(rows: DataFrame) -> DataFrame:
    """Measures with their defaults (M1): unknown days are a year, community and trust scores turn round, the rest is 0."""
    zero = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0))
    return rows.select(
        "id", F.coalesce("days", F.lit(365.0)).alias("days"), zero("commits").alias("commits"), zero("timeline").alias("timeline"), zero("scope_private").alias("scope_private"),
        zero("patterns").alias("patterns"), zero("commit_pattern").alias("commit_pattern"), zero("nlp").alias("nlp"), zero("cross_package").alias("cross_package"), zero("behavioral").alias("behavioral"),
        (1 - F.coalesce("review_ok", F.lit(1.0))).alias("review"), (1 - F.coalesce("popular", F.lit(1.0))).alias("popularity"), (1 - F.coalesce("trusted", F.lit(1.0))).alias("trust"),
    )


def threat_score() -> Column:
    """Weighted sum of eleven terms, capped at 1 (M2)."""
    w = fixed.ML_WEIGHTS
    linear = [F.col(k) * w[k] for k in ("timeline", "commit_pattern", "nlp", "cross_package", "behavioral", "review", "popularity", "trust")]
    steps = [
        F.when(F.col("scope_private") == 1, w["scope"]).otherwise(0.0),
        F.when(F.col("patterns") > 0, F.least(F.lit(w["patterns"]), 0.1 * F.col("patterns") * (w["patterns"] / 0.2))).otherwise(0.0),
        F.when((F.col("commits") < 5) & (F.col("days") < 30), w["low_activity"]).otherwise(0.0),
    ]
    total = F.lit(0.0)
    for x in linear + steps:
        total = total + x
    return F.least(F.lit(1.0), total)


def predictive_score() -> Column:
    """Weighted early signs, capped at 1 (M3)."""
    w = fixed.PREDICTIVE_WEIGHTS
    total = F.when((F.col("commits") < 5) & (F.col("days") < 90), w["low_activity"]).otherwise(0.0)
    for k in ("timeline", "commit_pattern", "nlp", "cross_package", "review", "popularity"):
        total = total + F.col(k) * w[k]
    return F.least(F.lit(1.0), total)


def decide(scored: DataFrame, score: str = "threat_score", anomaly: str = "timeline", predictive: str = "predictive_score", model: str | None = None) -> DataFrame:
    """Above the threshold by score or anomaly; else at predictive risk (M4).  A model's score goes before the rules' where there is one."""
    s = F.coalesce(F.col(model), F.col(score)) if model else F.col(score)
    above = (s >= fixed.DECISION_THRESHOLD) | (F.col(anomaly) >= fixed.DECISION_THRESHOLD)
    return scored.withColumn("above", above).withColumn("at_risk", ~above & (F.col(predictive) >= fixed.PREDICTIVE_THRESHOLD))


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, precision and recall to four decimals; 0 where nothing is to be divided by."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    sums = rows.agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 4)
    c = F.col
    return sums.select("n", "tp", "fp", "fn", "tn", ratio(c("tp") + c("tn"), c("n")).alias("accuracy"), ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"))


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve with average ranks for ties (A27); rows are counted per score first, so only distinct scores are ranked, range by range."""
    per = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p_"), F.count_if(F.col(label) == 0).alias("n_"))
    area = running_sums(per, score, ["n_"]).select("p_", "n_", (F.col("p_") * (F.col("n__before_") + F.col("n_") / 2)).alias("u_"))
    return area.agg(F.round(F.try_divide(F.sum("u_"), F.sum("p_") * F.sum("n_")), 6).alias("auc"))


def brier(rows: DataFrame, label: str, probability: str) -> DataFrame:
    return rows.agg(F.round(F.avg((F.col(probability) - F.col(label)) * (F.col(probability) - F.col(label))), 6).alias("brier"))


def class_balance(rows: DataFrame, label: str) -> DataFrame:
    """Counts and the weight of positives."""
    good, bad = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return rows.agg(good.alias("negatives"), bad.alias("positives"), F.round(F.when(bad > 0, good / bad).otherwise(1.0), 6).alias("positive_weight"))


def ks_statistic(rows: DataFrame, value: str, current: str, stepped: bool = False) -> DataFrame:
    """Largest distance of two samples' distributions (A30), from counts per distinct value.

    Equal values move both distributions at once; with ``stepped`` those of the first sample move first, as in a merge
    of two sorted lists that takes from the first on ties.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(current)).alias("b_"), F.count_if(~F.col(current)).alias("a_"))
    total = per.agg(F.sum("a_").alias("na_"), F.sum("b_").alias("nb_"))
    steps = running_sums(per, value, ["a_", "b_"]).crossJoin(F.broadcast(total))
    share = lambda x, n: x / F.nullif(n, F.lit(0))
    first = share(F.col("a__before_") + F.col("a_"), "na_")
    gap = F.abs(first - share(F.col("b__before_") + F.col("b_"), "nb_"))
    if stepped:
        gap = F.greatest(gap, F.abs(first - share(F.col("b__before_"), "nb_")))
    return steps.agg(F.round(F.max(gap), 6).alias("ks"), F.coalesce(F.max(gap) > 0.2, F.lit(False)).alias("drifted"))


def first_by_hash(rows: DataFrame, label: str, key: str, wanted: DataFrame, seed: str) -> DataFrame:
    """``rows`` with ``first_``: whether a row is among the first of its label in hashed order, as many as ``wanted`` (l_, want_) says.

    Leading hex digits bucket the rows, so that only rows of one bucket are ranked together.
    """
    keyed = rows.withColumn("h_", F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")))).withColumn("bucket_", F.conv(F.substring("h_", 1, 3), 16, 10).cast("int"))
    rooms = keyed.groupBy(label, "bucket_").agg(F.count("*").alias("c_"))
    rooms = rooms.withColumn("before_", F.coalesce(F.sum("c_").over(W.partitionBy(label).orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rooms = rooms.join(F.broadcast(wanted), F.col(label) == F.col("l_")).select(F.col(label).alias("l2_"), F.col("bucket_").alias("b2_"), (F.col("want_") - F.col("before_")).alias("room_"))
    joined = keyed.join(rooms, (F.col(label) == F.col("l2_")) & (F.col("bucket_") == F.col("b2_")))
    place = F.row_number().over(W.partitionBy(label, "bucket_").orderBy("h_", key))
    return joined.withColumn("first_", place <= F.col("room_")).select(*rows.columns, "first_")


def stratified_split(rows: DataFrame, label: str, key: str, share: float, seed: str = "42") -> DataFrame:
    """Every label's rows in hashed order; the first ``share`` of them are validation (M7)."""
    wanted = rows.groupBy(F.col(label).alias("l_")).agg(F.floor(F.count("*") * share).alias("want_"))
    return first_by_hash(rows, label, key, wanted, seed).withColumnRenamed("first_", "validation")


def oversample(rows: DataFrame, label: str, key: str, seed: str = "42") -> DataFrame:
    """Rows of the rarer labels repeated until all labels have as many (M6): whole copies, and one more of the first rows in hashed order."""
    counts = rows.groupBy(F.col(label).alias("l_")).agg(F.count("*").alias("n_"))
    plan = counts.crossJoin(F.broadcast(counts.agg(F.max("n_").alias("top_"))))
    marked = first_by_hash(rows, label, key, plan.select("l_", (F.col("top_") % F.col("n_")).alias("want_")), seed)
    copies = F.floor(F.col("top_") / F.col("n_")).cast("int") + F.col("first_").cast("int")
    return marked.join(F.broadcast(plan), F.col(label) == F.col("l_")).withColumn("copy_", F.explode(F.sequence(F.lit(1), copies))).select(*rows.columns)


def newest_or_stratified(rows: DataFrame, ts: str, label: str, key: str, share: float) -> DataFrame:
    """The newest ``share`` as validation (W8), or a stratified split where that leaves either side with one label, or where a time is missing."""
    split = time_split(rows, ts, key, share)
    kinds = split.agg(F.count_distinct(F.when(F.col("validation"), F.col(label))).alias("v"), F.count_distinct(F.when(~F.col("validation"), F.col(label))).alias("t"), F.count("*").alias("n")).first()
    whole = rows.agg(F.count(ts).alias("known"), F.count("*").alias("n")).first()
    if kinds["v"] > 1 and kinds["t"] > 1 and whole["known"] == whole["n"]:
        return split
    return stratified_split(rows, label, key, share)


def batch_scores(make_predict: Callable, features: list[str], batch: int = 512) -> Column:
    """A model's scores for batches of at most ``batch`` rows (M9), clamped to 0..1; ``make_predict`` loads it once a worker.

    It returns a function from an array of rows by features, in the order given, to scores.  Null features are 0.
    """
    score = predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch, input_tensor_shapes=[[len(features)]])
    vector = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score(vector)))


def train_trees(rows: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 42, weight: str | None = None):
    """Gradient-boosted trees over columns (M5); missing values count as 0, and ``weight`` names the rows' weights."""
    boosted = GBTClassifier(featuresCol="features_", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    if weight:
        boosted = boosted.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features_"), boosted]).fit(rows.fillna(0.0, features))


def class_weights(rows: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Rows with a weight (M5): negatives to positives for label 1, else 1; all 1 where a class is missing."""
    counts = rows.agg(F.count_if(F.col(label) == 0).alias("neg_"), F.count_if(F.col(label) == 1).alias("pos_"))
    ratio = F.when((F.col(label) == 1) & (F.col("neg_") > 0) & (F.col("pos_") > 0), F.col("neg_") / F.col("pos_")).otherwise(1.0)
    return rows.crossJoin(F.broadcast(counts)).withColumn(name, ratio).drop("neg_", "pos_")


def search_trees(rows: DataFrame, features: list[str], label: str, depths: list[int], trees: list[int], folds: int = 3, seed: int = 42):
    """The best of a grid of boosted trees by cross-validated area under the curve (M5)."""
    boosted = GBTClassifier(featuresCol="features_", labelCol=label, seed=seed)
    grid = ParamGridBuilder().addGrid(boosted.maxDepth, depths).addGrid(boosted.maxIter, trees).build()
    ready = VectorAssembler(inputCols=features, outputCol="features_").transform(rows.fillna(0.0, features))
    return CrossValidator(estimator=boosted, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=seed).fit(ready)


def train_calibration(scored: DataFrame, label: str, raw: str = "rawPrediction"):
    """A sigmoid over a model's margin (M5), fitted on rows that the model hasn't seen; gives the column ``calibrated_``."""
    sigmoid = LogisticRegression(featuresCol="margin_", labelCol=label, probabilityCol="calibrated_", rawPredictionCol="calibrated_raw_", predictionCol="calibrated_prediction_")
    return sigmoid.fit(with_margin(scored, raw))


def with_margin(scored: DataFrame, raw: str = "rawPrediction") -> DataFrame:
    return scored.withColumn("margin_", array_to_vector(F.slice(vector_to_array(raw), 2, 1)))


def gates(measured: DataFrame, least: dict[str, float], positives: str = "positives") -> DataFrame:
    """Metrics with ``failed``, the names of the gates that they miss (M8), and ``skipped``.

    Precision and recall have no meaning without a positive row, so their gates are then skipped; a metric that is null misses none.
    """
    some = F.col(positives) > 0
    checks = [F.when((F.col(k) < v) & (some if k in ("precision", "recall") else F.lit(True)), k) for k, v in sorted(least.items())]
    skipped = [F.when(~some, k) for k in sorted(least) if k in ("precision", "recall")]
    none = F.array().cast("array<string>")
    kept = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull()) if xs else none
    return measured.withColumn("failed", kept(checks)).withColumn("skipped", kept(skipped))


def importances(model, features: list[str]) -> dict[str, float]:
    """Each feature's importance in a fitted model of trees, or in the last stage of a pipeline (M11); one number a feature."""
    return dict(zip(features, map(float, getattr(model, "stages", [model])[-1].featureImportances.toArray()), strict=True))


def reasons(importance: dict[str, float], said: dict[str, str], n: int = 5) -> Column:
    """The features of most importance with a row's values in words, ``name=0.00: reason`` (M11); features without importance give none."""
    top = [k for k in sorted(importance, key=lambda k: -importance[k])[:n] if importance[k] > 0]
    line = lambda k: F.concat(F.format_string(f"{k}=%.2f", F.coalesce(F.col(k).cast("double"), F.lit(0.0))), F.lit(f": {said[k]}" if k in said else ""))
    return F.array(*[line(k) for k in top]) if top else F.array().cast("array<string>")


def other_schemas(models: DataFrame, version: str, expected: int) -> DataFrame:
    """Models built for another version of the features (M13); those that name none pass."""
    return models.where(F.col(version).isNotNull() & (F.col(version) != expected))


def train_stacker(rows: DataFrame, first: str, second: str, label: str):
    """A logistic model over two probabilities."""
    return Pipeline(stages=[VectorAssembler(inputCols=[first, second], outputCol="pair_"), LogisticRegression(featuresCol="pair_", labelCol=label, probabilityCol="stacked_")]).fit(rows)


def contributions(features: list[str], importance: dict[str, float], n: int = 10) -> Column:
    """The ``n`` features with the largest absolute importance times value, largest first."""
    rows = F.array(*[F.struct((-F.abs(F.col(f) * importance.get(f, 0.0))).alias("order"), F.lit(f).alias("feature"), (F.col(f) * importance.get(f, 0.0)).alias("value")) for f in features])
    return F.transform(F.slice(F.array_sort(F.filter(rows, lambda r: r["order"] < 0)), 1, n), lambda r: F.struct(r["feature"], r["value"]))
