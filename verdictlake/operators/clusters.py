"""User clusters over profiles: standardised features, principal components, k-means (planned capability)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["unique_problems_attempted", "unique_problems_solved", "total_raw_submissions", "problem_win_rate", "submissions_per_problem"]


def user_clusters(profiles: DataFrame, k: int = 6, components: int = 2, seed: int = 1) -> DataFrame:
    """(user_id, cluster, pc1, pc2): distributed fits, one row a profile."""
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="raw", handleInvalid="skip"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        PCA(k=components, inputCol="scaled", outputCol="pcs"),
        KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster"),
    ]
    out = Pipeline(stages=stages).fit(profiles).transform(profiles)
    pcs = vector_to_array("pcs")
    return out.select("user_id", "cluster", *(F.element_at(pcs, i + 1).alias(f"pc{i + 1}") for i in range(components)))
