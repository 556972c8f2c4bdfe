"""Model jobs by the ML library (M7, M8)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.operators import ranks


def yield_regressor(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """M7: impute medians, boost trees on seasons whose hash isn't held out; one row of errors on the held-out ones."""
    flat = rows.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(target).cast("double").alias("y"), (F.pmod(F.xxhash64(*features, target), F.lit(5)) == 0).alias("held")).where("y is not null")
    stages = [Imputer(strategy="median", inputCols=features, outputCols=[f"_{f}" for f in features]), VectorAssembler(inputCols=[f"_{f}" for f in features], outputCol="x"), GBTRegressor(featuresCol="x", labelCol="y", maxIter=10, maxDepth=4, seed=1)]
    made = Pipeline(stages=stages).fit(flat.where("not held")).transform(flat.where("held"))
    scores = {m: RegressionEvaluator(labelCol="y", metricName=m).evaluate(made) for m in ("mae", "rmse", "r2")}
    width = ranks.quantiles(made.select(F.abs(F.col("y") - F.col("prediction")).alias("e")), [], "e", {"p90_width": ranks.linear(0.9)})
    return width.select(*(F.lit(v).alias(k) for k, v in scores.items()), "p90_width")


def object_classifier(rows: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """M8: probability of the target class for every segment, by boosted trees on rows that aren't held out."""
    flat = rows.dropna(subset=features).withColumn("held", F.pmod(F.xxhash64(*keys), F.lit(5)) == 0)
    stages = [VectorAssembler(inputCols=features, outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=target, maxIter=5, maxDepth=3, seed=1)]
    made = Pipeline(stages=stages).fit(flat.where("not held")).transform(flat)
    return made.select(*keys, "held", vector_to_array("probability")[1].alias("probability"))


def imputed(rows: DataFrame, numeric: list[str], categories: list[str], held: str) -> DataFrame:
    """M7: rows with nulls (and NaNs) of ``numeric`` at the median, of ``categories`` at the mode, of rows that aren't held out.

    Of equally frequent values the least is the mode.  A column without any
    value to learn from gets 0 or an empty text.
    """
    clean = rows.select("*", *(F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double")).alias(f"_{x}") for x in numeric)).drop(*numeric).withColumnsRenamed({f"_{x}": x for x in numeric})
    train = clean.where(~F.col(held))
    middles = {}
    for x in numeric:
        found = ranks.quantiles(train.where(F.col(x).isNotNull()).select(x), [], x, {"median": ranks.linear(0.5)}).first()
        middles[x] = float(found["median"]) if found and found["median"] is not None else 0.0
    modes = {}
    for x in categories:
        found = train.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").first()  # one row
        modes[x] = found["v"] if found else ""
    return clean.select(*(F.col(x) for x in rows.columns if x not in {*numeric, *categories}), *(F.coalesce(x, F.lit(middles[x])).alias(x) for x in numeric), *(F.coalesce(F.col(x).cast("string"), F.lit(modes[x])).alias(x) for x in categories))


def one_hot(categories: list[str]) -> list:
    """Pipeline stages that give ``{x}_hot`` for each category; values not met in training are all zeros."""
    index = StringIndexer(inputCols=categories, outputCols=[f"{x}_no" for x in categories], handleInvalid="keep", stringOrderType="alphabetAsc")
    return [index, OneHotEncoder(inputCols=[f"{x}_no" for x in categories], outputCols=[f"{x}_hot" for x in categories], dropLast=True)]  # the last is for unknown ones


def yield_pipeline(rows: DataFrame, numeric: list[str], categories: list[str], target: str, held: str, rounds: int = 20) -> tuple[PipelineModel, DataFrame]:
    """M7: the fitted pipeline and one row of errors on held-out rows, with the error of a mean predictor beside.

    Medians and modes are imputed, categories are one-hot, trees are boosted.
    """
    ready = imputed(rows.where(F.col(target).isNotNull()), numeric, categories, held).withColumn("y", F.col(target).cast("double"))
    stages = [*one_hot(categories), VectorAssembler(inputCols=[*numeric, *(f"{x}_hot" for x in categories)], outputCol="_features"), GBTRegressor(featuresCol="_features", labelCol="y", maxIter=rounds, maxDepth=4, stepSize=0.2, seed=42)]
    model = Pipeline(stages=stages).fit(ready.where(~F.col(held)))
    mean = ready.where(~F.col(held)).agg(F.avg("y").alias("mean"))  # one row
    made = model.transform(ready.where(held)).crossJoin(F.broadcast(mean)).withColumn("e", F.abs(F.col("y") - F.col("prediction")))
    width = ranks.quantiles(made.select("e"), [], "e", {"p90_width": ranks.linear(0.9)})
    middle = made.select("y", "prediction", "mean", "e")
    spread = middle.agg(F.avg("y").alias("_y"))
    sums = middle.crossJoin(F.broadcast(spread)).agg(
        F.count("*").alias("samples_test"), F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        (1 - F.try_divide(F.sum(F.col("e") * F.col("e")), F.sum((F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))))).alias("r2"), F.avg(F.abs(F.col("y") - F.col("mean"))).alias("mean_mae"),
    )
    return model, sums.crossJoin(F.broadcast(width))  # one row each
