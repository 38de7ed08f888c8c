"""Track and pixel classifiers on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.session import cut_lineage

TRACK_FEATURES = ["net_displacement", "straightness", "asymmetry", "radius_gyration", "kurtosis", "fractal_dimension"]
# Motion classes of the track classifier.
LABELS = {1: "Mobile", 2: "Confined", 3: "Trapped"}
LAMBDAS = [round(-2 + 0.25 * i, 2) for i in range(17)]


def box_cox(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam


def fit_box_cox(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(shift, lambda) per column by maximum likelihood over a lambda grid.

    The shift makes the smallest value 1; all candidates share one aggregate.
    """
    low = df.agg(*[F.min(c).alias(c) for c in columns]).first()
    shift = {c: (1.0 - low[c]) if low[c] <= 0 else 0.0 for c in columns}
    scores = []
    for c in columns:
        x = F.col(c) + shift[c]
        for i, lam in enumerate(LAMBDAS):
            ll = -F.count(x) / 2 * F.ln(F.greatest(F.var_pop(box_cox(x, lam)), F.lit(1e-300))) + (lam - 1) * F.sum(F.ln(x))
            scores.append(ll.alias(f"{c}__{i}"))
    row = df.agg(*scores).first()
    return {c: (shift[c], LAMBDAS[max(range(len(LAMBDAS)), key=lambda i: row[f"{c}__{i}"])]) for c in columns}


def apply_box_cox(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """Unseen values below the fitted range are held at its smallest argument."""
    return df.withColumns({c: box_cox(F.greatest(F.col(c) + s, F.lit(1e-6)), lam) for c, (s, lam) in params.items()})


def stratified_split(df: DataFrame, label: str, key: str, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A fixed share of every label by hash of the row key; no sort, no collect."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    marked = df.withColumn("_u", u)
    return marked.where(F.col("_u") < train).drop("_u"), marked.where(F.col("_u") >= train).drop("_u")


class TrackClassifier:
    """Median impute, shifted Box-Cox, standardise, PCA(3), classify.

    Spark ML has no RBF kernel: the classifier is one-vs-rest linear SVM
    ("svm") or a random forest ("forest"), tuned by cross-validation.
    """

    def __init__(self, features: list[str] | None = None, method: str = "forest", folds: int = 3):
        self.features, self.method, self.folds = features or TRACK_FEATURES, method, folds

    def _prepared(self, df: DataFrame) -> DataFrame:
        return apply_box_cox(self.imputer.transform(df), self.box)

    def train(self, df: DataFrame, label: str = "label", key: str = "track_id") -> dict:
        train, test = stratified_split(df, label, key)
        train, test = cut_lineage(train), cut_lineage(test)
        self.imputer = Imputer(inputCols=self.features, outputCols=self.features, strategy="median").fit(train)
        self.box = fit_box_cox(self.imputer.transform(train), self.features)
        if self.method == "svm":
            base = LinearSVC(maxIter=50)
            model = OneVsRest(classifier=base, featuresCol="pcs", labelCol=label)
            grid = ParamGridBuilder().addGrid(base.regParam, [0.001, 0.1]).build()
        else:
            model = RandomForestClassifier(featuresCol="pcs", labelCol=label, seed=42, numTrees=30)
            grid = ParamGridBuilder().addGrid(model.maxDepth, [4, 8]).build()
        steps = [VectorAssembler(inputCols=self.features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
                 PCA(k=min(3, len(self.features)), inputCol="scaled", outputCol="pcs"), model]
        evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
        cv = CrossValidator(estimator=Pipeline(stages=steps), estimatorParamMaps=grid, evaluator=evaluator, numFolds=self.folds, seed=42, parallelism=2)
        self.model = cv.fit(self._prepared(train)).bestModel
        predicted = cut_lineage(self.model.transform(self._prepared(test)).select(F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")))
        self.confusion = predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
        hit = (F.col("label") == F.col("prediction")).cast("double")
        self.per_class = predicted.groupBy("label").agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))
        return {"accuracy": predicted.agg(F.avg(hit)).first()[0], "n_train": train.count(), "n_test": test.count()}

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._prepared(df))
        return out.select(*df.columns, F.col("prediction").cast("int").alias("predicted_class"))


class PixelClassifier:
    """Random forest on pixel feature columns; class and probabilities per pixel."""

    def __init__(self, trees: int = 20, depth: int = 8):
        self.trees, self.depth = trees, depth

    def train(self, features: DataFrame, label: str = "label") -> "PixelClassifier":
        self.columns = [c for c in features.columns if c.startswith("f") and c[1:].isdigit()]
        steps = [VectorAssembler(inputCols=self.columns, outputCol="features"),
                 RandomForestClassifier(labelCol=label, numTrees=self.trees, maxDepth=self.depth, seed=42)]
        self.model = Pipeline(stages=steps).fit(features)
        return self

    def predict(self, features: DataFrame) -> DataFrame:
        keep = [c for c in features.columns if c not in self.columns]
        return self.model.transform(features).select(*keep, F.col("prediction").cast("int").alias("predicted_class"), vector_to_array("probability").alias("probabilities"))
