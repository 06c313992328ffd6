"""Model preprocessing, fitting and scoring with MLlib.

The feature vector follows the fitted ``Design`` of the explanation operators:
standardised numerics (population std, as the reference's scaler) and one-hot
indicators of the levels seen in training (null is a level; unseen levels are
all-zero).  ``design_vectors`` looks the levels' positions up in the design's
table and writes sparse vectors, so no vocabulary is held by the driver or by a
stage, however many levels a column has.  Fitting is MLlib's distributed
training; class counts and one number a vector entry (coefficients,
importances) are what reaches the driver.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.functions.features import TARGET
from churnscope.operators.explain import Design, feature_table, join_levels, scaled
from churnscope.session import spread, write_stash

# The reference's model settings.
LOGREG = dict(C=1.0, max_iter=1000)
FOREST = dict(num_trees=600, max_depth=10, min_leaf=20)
BOOSTING = dict(rounds=800, learning_rate=0.05, max_depth=5, subsample=0.8, colsample=0.8,
                patience_tol=1e-4)
SEED = 42
#: Training rows from which vectors are dealt to every core; fewer stay in the files they come from.
DEAL_ROWS = 50_000


def design_vectors(df: DataFrame, d: Design, *keep: str) -> DataFrame:
    """columns ``keep`` (all, if none is named) of every row and its sparse vector ``features``.

    Entries are the scaled numerics, then the position of the row's own level of each
    categorical column; a null numeric is NaN, an unseen level has no entry.  Rows are written
    in the stored form of a vector (kind 0 is sparse), dealt evenly where there are many, and
    read back as vectors: every pass of a fit and every score would else wait for the fullest file.
    """
    keep = keep or tuple(df.columns)
    own = join_levels(df, d, d.levels, "position")
    at = F.array_compact(F.array(*[F.col(f"_l_{c}.position").cast("int") for c in d.categorical]))
    numbers = F.array(*[F.coalesce(scaled(d, c), F.lit(float("nan"))) for c in d.numeric])
    stored = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(d.width).alias("size"),
        F.concat(F.array(*[F.lit(i) for i in range(len(d.numeric))]).cast("array<int>"), "_at").alias("indices"),
        F.concat(numbers.cast("array<double>"), F.array_repeat(F.lit(1.0), F.size("_at"))).alias("values"))
    rows = own.withColumn("_at", at.cast("array<int>")).select(*keep, stored.alias("features"))
    if d.n >= DEAL_ROWS:
        rows = spread(rows)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("features", VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(write_stash(rows, "vectors"))


def _estimator(kind: str, n_train: int):
    if kind == "logreg":
        # sklearn's C * sum(w * loss) + |b|^2 / 2 divided by C * sum(w):
        # MLlib's mean weighted loss + regParam / 2 |b|^2 with regParam = 1 / (C * sum(w));
        # balanced weights sum to n.
        return LogisticRegression(featuresCol="features", labelCol=TARGET, weightCol="weight",
                                  maxIter=LOGREG["max_iter"], regParam=1.0 / (LOGREG["C"] * n_train),
                                  elasticNetParam=0.0, standardization=False, tol=1e-6)
    if kind == "rf":
        return RandomForestClassifier(featuresCol="features", labelCol=TARGET, weightCol="weight",
                                      numTrees=FOREST["num_trees"], maxDepth=FOREST["max_depth"],
                                      minInstancesPerNode=FOREST["min_leaf"],
                                      featureSubsetStrategy="sqrt", seed=SEED)
    if kind == "xgb":
        return GBTClassifier(featuresCol="features", labelCol=TARGET, weightCol="weight",
                             maxIter=BOOSTING["rounds"], stepSize=BOOSTING["learning_rate"],
                             maxDepth=BOOSTING["max_depth"],
                             subsamplingRate=BOOSTING["subsample"],
                             featureSubsetStrategy=str(BOOSTING["colsample"]),
                             validationIndicatorCol="is_val",
                             validationTol=BOOSTING["patience_tol"], seed=SEED)
    raise ValueError(kind)


def class_weights(kind: str, d: Design) -> tuple[float, float]:
    """(weight of a churner, weight of the rest): balanced n / (2 n_class) for the linear model and
    the forest; for boosting churners get neg / max(1, pos)."""
    pos, neg = d.n1, d.n - d.n1
    if kind == "xgb":
        return neg / max(1, pos), 1.0
    return d.n / (2.0 * max(pos, 1)), d.n / (2.0 * max(neg, 1))


def fit_model(kind: str, train: DataFrame, d: Design, val: DataFrame | None = None) -> PipelineModel:
    """F5/F6/F7 (+F8 early stop on the validation rows for boosting)."""
    data = train.withColumn("is_val", F.lit(False))
    if kind == "xgb" and val is not None:
        data = data.unionByName(val.withColumn("is_val", F.lit(True)))
    heavy, light = class_weights(kind, d)
    data = data.withColumn("weight", F.when(F.col(TARGET) == 1, F.lit(heavy)).otherwise(F.lit(light)))
    data = data.withColumn(TARGET, F.col(TARGET).cast("double"))
    return Pipeline(stages=[_estimator(kind, d.n)]).fit(design_vectors(data, d, TARGET, "weight", "is_val"))


def score(model: PipelineModel, df: DataFrame, d: Design, name: str) -> DataFrame:
    """long scored rows ``(model, split, customerID, y, prob)``; ``df`` may be the output of
    ``design_vectors``."""
    data = df if "features" in df.columns else design_vectors(df, d, "split", "customerID", TARGET)
    return model.transform(data).select(F.lit(name).alias("model"), "split", "customerID",
                                        F.col(TARGET).cast("int").alias("y"),
                                        vector_to_array("probability")[1].alias("prob"))


def coefficients(model: PipelineModel, d: Design) -> DataFrame:
    """Linear coefficients as a (feature, coef) table."""
    return _table(model.stages[-1].coefficients.toArray(), d, "coef")


def importances(model: PipelineModel, d: Design) -> DataFrame:
    """H2 input: tree feature importances as a (feature, coef) table."""
    return _table(model.stages[-1].featureImportances.toArray(), d, "coef")


def _table(weights, d: Design, name: str) -> DataFrame:
    """(feature, ``name``) of one number for each vector entry, by position."""
    if len(weights) != d.width:
        raise ValueError(f"Mismatch: {len(weights)} weights vs {d.width} features")
    numbers = d.levels.sparkSession.createDataFrame(
        [(i, float(w)) for i, w in enumerate(weights)], f"position bigint, {name} double")
    return feature_table(d).join(numbers, "position").select("feature", name)


def gradient_table(model: PipelineModel, train: DataFrame, d: Design) -> DataFrame:
    """F5 certificate: per design column the gradient of the penalised objective at the fitted
    coefficients, divided by the rows (0 at the optimum)."""
    lr = model.stages[-1]
    heavy, light = class_weights("logreg", d)
    y = F.col(TARGET).cast("double")
    slope = (F.when(y == 1, F.lit(heavy)).otherwise(F.lit(light))
             * (vector_to_array("probability")[1] - y))
    rows = model.transform(design_vectors(train, d, TARGET)).select("features", slope.alias("r"))
    signs = {"up": F.greatest(F.col("r"), F.lit(0.0)), "down": F.greatest(-F.col("r"), F.lit(0.0))}
    parts = rows.select(  # weights are not negative: each sign of the slope on its own
        *[Summarizer.mean(F.col("features"), w).alias(n) for n, w in signs.items()],
        *[F.sum(w).alias(f"w_{n}") for n, w in signs.items()]).first()
    up, down = (parts[n].toArray() * parts[f"w_{n}"] for n in signs)
    grad = (up - down + lr.coefficients.toArray() / LOGREG["C"]) / d.n
    return _table(grad, d, "gradient")
