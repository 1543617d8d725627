"""One recipe for all text classifiers: hash embeddings, scaled by population deviation, balanced logistic regression."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaling(rows: DataFrame, vector: str, width: int) -> tuple[list[float], list[float]]:
    """Means and population deviations of the components; 1 where a deviation is below 1e-6."""
    found = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()  # a row for each component
    mean, dev = [0.0] * width, [1.0] * width
    for r in found:
        mean[r.i], dev[r.i] = r.m, r.s if r.s and r.s >= 1e-6 else 1.0
    return mean, dev


class TextClassifier:
    """Fit on ``rows(vector, label)``; ``predict`` adds ``predicted`` and ``probability``. Labels are strings."""

    def __init__(self, vector: str = "vector", label: str = "label", iterations: int = 200) -> None:
        self.vector, self.label, self.iterations = vector, label, iterations
        self.names: list[str] = []
        self.model: LogisticRegressionModel | None = None

    def _scaled(self, rows: DataFrame) -> DataFrame:
        mean, dev = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (self.mean, self.dev))
        centred = F.zip_with(F.zip_with(F.col(self.vector), mean, lambda x, m: x - m), dev, lambda x, d: x / d)
        return rows.withColumn("__features", array_to_vector(centred))

    def fit(self, rows: DataFrame) -> TextClassifier:
        rows = rows.where(F.col(self.label).isNotNull()).select(self.vector, self.label).persist()  # read once for each pass
        try:
            counts = {r[0]: r[1] for r in rows.groupBy(self.label).count().collect()}  # a row for each class
            self.names, n = sorted(counts), sum(counts.values())
            if len(self.names) < 2:
                raise ValueError("two classes at least are needed")
            width = rows.select(F.size(self.vector)).first()[0]
            self.mean, self.dev = scaling(rows, self.vector, width)
            place = F.create_map(*[x for i, name in enumerate(self.names) for x in (F.lit(name), F.lit(float(i)))])
            weight = F.create_map(*[x for name in self.names for x in (F.lit(name), F.lit(n / (len(self.names) * counts[name])))])
            ready = self._scaled(rows).select("__features", place[F.col(self.label)].alias("__y"), weight[F.col(self.label)].alias("__w"))
            estimator = LogisticRegression(featuresCol="__features", labelCol="__y", weightCol="__w", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=self.iterations, tol=1e-9)
            self.model = estimator.fit(ready)
        finally:
            rows.unpersist()
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``predicted``, ``probability`` and ``probabilities`` (in the order of ``names``)."""
        scored = self.model.transform(self._scaled(rows))
        p = vector_to_array("probability")
        out = scored.withColumn("__p", p)
        names = F.array(*[F.lit(x) for x in self.names])
        return out.select(*rows.columns, F.element_at(names, F.array_position("__p", F.array_max("__p")).cast("int")).alias("predicted"), F.array_max("__p").alias("probability"), F.col("__p").alias("probabilities"))
