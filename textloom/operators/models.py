"""Learned classifiers on Spark ML: features, models, cross-validated search, benchmark."""

from __future__ import annotations

import itertools
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, PCAModel, SQLTransformer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.scalars import decode_label, encode_label
from textloom.functions.tokens import tokenize
from textloom.functions.clean import serving_clean
from textloom.operators import evaluate, sampling
from textloom.sources.shared import written


def labelled(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """df with clean, tokens, y (0, 1, 2) and a balanced class weight."""
    out = df.withColumn("clean", serving_clean(F.col(text))).withColumns({"tokens": F.filter(tokenize(F.col("clean")), lambda t: F.length(t) > 1), "y": encode_label(F.col(label)).cast("double")})
    sizes = out.groupBy("y").agg(F.count("*").alias("__n"))  # three rows at most
    total = out.agg(F.count("*").alias("__all"), F.countDistinct("y").alias("__k"))
    weights = sizes.join(F.broadcast(total)).select("y", (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return out.join(F.broadcast(weights), "y")


def fit_tfidf(train: DataFrame, ngrams: int = 1, min_df: int = 1, max_features: int = 1 << 16) -> PipelineModel:
    """Unigrams (and bigrams), counts times ln((1 + n) / (1 + df)) + 1, L2 norm; all stages
    run in the JVM.  Spark's own IDF lacks the + 1, so its weights are raised by one."""
    grams = [] if ngrams == 1 else [NGram(n=2, inputCol="tokens", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(tokens, pairs) AS terms FROM __THIS__")]
    counts = CountVectorizer(inputCol="tokens" if ngrams == 1 else "terms", outputCol="counts", minDF=min_df, vocabSize=max_features)
    base = Pipeline(stages=[*grams, counts]).fit(train)
    idf = IDF(inputCol="counts").fit(base.transform(train)).idf
    scale = ElementwiseProduct(inputCol="counts", outputCol="raw", scalingVec=Vectors.dense(idf.toArray() + 1.0))
    return PipelineModel(stages=[*base.stages, scale, Normalizer(inputCol="raw", outputCol="features", p=2.0)])


def projection(spark, matrix: np.ndarray, source: str, target: str) -> PCAModel:
    """A JVM transformer that multiplies a (sparse) vector by matrix (features x k)."""
    sc, (n, k) = spark.sparkContext, matrix.shape
    java = [_py2java(sc, x) for x in (DenseMatrix(n, k, np.asarray(matrix, float).ravel(order="F")), Vectors.dense(np.zeros(k)))]
    model = PCAModel(sc._jvm.org.apache.spark.ml.feature.PCAModel(f"projection_{uuid.uuid4().hex[:12]}", *java))
    return model._set(k=k, inputCol=source, outputCol=target)


class Cosines(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """sqrt(2 / n) cos(z + b): the last step of random Fourier features (Rahimi and Recht 2007)."""

    shift = Param(Params._dummy(), "shift", "b", typeConverter=TypeConverters.toListFloat)

    def __init__(self, inputCol=None, outputCol=None, shift=None):
        super().__init__()
        for name, value in (("inputCol", inputCol), ("outputCol", outputCol), ("shift", shift)):
            if value is not None:
                self._set(**{name: value})

    def _transform(self, df: DataFrame) -> DataFrame:
        b = self.getOrDefault(self.shift)
        z = F.zip_with(vector_to_array(self.getInputCol()), F.from_json(F.lit(str(b)), "array<double>"), lambda x, y: F.cos(x + y) * float(np.sqrt(2 / len(b))))
        return df.withColumn(self.getOutputCol(), array_to_vector(z))


def fourier(spark, k: int, gamma: float, source: str, target: str, width: int = 256, seed: int = 42) -> list:
    """Stages that map k numbers to width Fourier features of an RBF kernel with this gamma."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (k, width)), rng.uniform(0, 2 * np.pi, width)
    return [projection(spark, w, source, target + "_z"), Cosines(target + "_z", target, b.tolist())]


_ARPACK = threading.Lock()  # the eigenvalue solver keeps state between its calls


def svd_components(df: DataFrame, features: str = "features", k: int = 30) -> np.ndarray:
    """Right singular vectors (features x k) of the uncentred matrix; fewer than k where its rank is lower.
    The solver passes over the rows some 200 times: they are kept, in memory as far as it goes, not read and decoded again."""
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(df.select(features), features))
    rows = matrix._java_matrix_wrapper._java_model.rows()  # Spark's own reference to the rows that its passes read
    rows.persist(df.sparkSession.sparkContext._getJavaStorageLevel(StorageLevel.MEMORY_AND_DISK))
    try:
        with _ARPACK:
            return matrix.computeSVD(min(k, int(matrix.numCols()) - 1), computeU=False).V.toArray()
    finally:
        rows.unpersist(False)


def logistic(c: float = 1.0, n: float = 1.0) -> LogisticRegression:
    """L2 logistic regression; regParam = 1 / (C * sum of weights)."""
    return LogisticRegression(labelCol="y", weightCol="weight", regParam=1.0 / (c * n), standardization=False, maxIter=100)


class Features:
    """TF-IDF rows and right singular vectors of training rows, made once for all candidates that
    share them.  k is the largest number of components; smaller ones are the first of these."""

    def __init__(self, train: DataFrame, k: int):
        self.train, self.k, self._made, self._lock = train, k, {}, threading.Lock()

    def _once(self, at: tuple, make):
        with self._lock:
            lock, box = self._made.setdefault(at, (threading.Lock(), []))
        with lock:
            if not box:
                box.append(make())
        return box[0]

    def sparse(self, ngrams: int, min_df: int) -> tuple[PipelineModel, DataFrame]:
        def make():
            base = fit_tfidf(self.train, ngrams, min_df)
            return base, written(base.transform(self.train).select("features", "y", "weight"))

        return self._once(("sparse", ngrams, min_df), make)

    def components(self, ngrams: int, min_df: int, k: int) -> np.ndarray:
        return self._once(("svd", ngrams, min_df), lambda: svd_components(self.sparse(ngrams, min_df)[1], k=self.k))[:, :k]


def fit_logistic(train: DataFrame | Features, c: float = 1.0, ngrams: int = 1, min_df: int = 1) -> PipelineModel:
    base, ready = (train if isinstance(train, Features) else Features(train, 1)).sparse(ngrams, min_df)
    model = logistic(c, max(1, ready.count())).fit(ready)
    return PipelineModel(stages=[*base.stages, model])


def fit_reduced(train: DataFrame | Features, estimator, k: int = 30, gamma: float | str | None = None, scale: bool = False, ngrams: int = 1, min_df: int = 1) -> PipelineModel:
    """TF-IDF, SVD, optional scaling and Fourier features, then estimator.  gamma "auto" is one
    over the number of components, "scale" the same over their variance as well."""
    made = train if isinstance(train, Features) else Features(train, k)
    spark = made.train.sparkSession
    base, sparse = made.sparse(ngrams, min_df)
    m = made.components(ngrams, min_df, k)
    if scale:  # scaling without centring folds into the projection
        std = np.array(StandardScaler(inputCol="reduced", withMean=False).fit(projection(spark, m, "features", "reduced").transform(sparse)).std)
        m = m / np.where(std > 0, std, 1.0)
    stages = [projection(spark, m, "features", "reduced")]
    ready = stages[0].transform(sparse)
    if gamma is not None:
        n = m.shape[1]
        if gamma == "scale":
            x = vector_to_array("reduced")
            var = ready.select(F.explode(x).alias("x")).agg(F.var_pop("x")).first()[0]
            gamma = 1.0 / (n * var) if var else 1.0 / n
        more = fourier(spark, n, 1.0 / n if gamma == "auto" else float(gamma), "reduced", "mapped")
        for s in more:
            ready = s.transform(ready)
        stages += more
    column = "reduced" if gamma is None else "mapped"
    # Dealt evenly: a forest or an SVM passes over these short rows hundreds of times with all cores, however few files they came from.
    dense = written(ready.select(column, "y", "weight").repartition(2 * spark.sparkContext.defaultParallelism))
    model = estimator.setFeaturesCol(column).fit(dense)
    return PipelineModel(stages=[*base.stages, *stages, model])


def fit_svm(train: DataFrame | Features, k: int = 30, c: float = 1.0, gamma: float | str = "scale", ngrams: int = 1, min_df: int = 1) -> PipelineModel:
    """An RBF support vector machine by random Fourier features and one-vs-rest linear SVMs."""
    svm = OneVsRest(classifier=LinearSVC(regParam=1.0 / c / 100, maxIter=50), labelCol="y", weightCol="weight")
    return fit_reduced(train, svm, k, gamma, True, ngrams, min_df)


def fit_forest(train: DataFrame | Features, k: int = 30, trees: int = 200, depth: int | None = 12, min_split: int = 2, seed: int = 42, ngrams: int = 1, min_df: int = 1) -> PipelineModel:
    """depth None is Spark's largest, 30; a split of min_split rows leaves half of them a side at least."""
    forest = RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=trees, maxDepth=min(depth or 30, 30), minInstancesPerNode=max(1, min_split // 2), seed=seed)
    return fit_reduced(train, forest, k, ngrams=ngrams, min_df=min_df)


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """df with pred_label and confidence (largest probability, or softmax of raw scores)."""
    out = model.transform(df)
    keep = [*df.columns, decode_label(F.col("prediction")).alias("pred_label")]
    if "probability" in out.columns:
        return out.select(*keep, F.array_max(vector_to_array("probability")).alias("confidence"))
    raw = vector_to_array("rawPrediction")
    return out.select(*keep, (1 / F.aggregate(raw, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(raw)))).alias("confidence"))


def macro_f1(df: DataFrame, label: str = "label", pred: str = "pred_label") -> float:
    return evaluate.metrics(evaluate.confusion(df, label, pred)).first().macro_f1


_TERMS = {"ngrams": [1, 2], "min_df": [1, 2]}


def _grid(ks: list[int]) -> list:
    return [
        ("logreg", "fit_logistic", {**_TERMS, "c": [0.2, 1.0, 5.0]}),
        ("svm", "fit_svm", {**_TERMS, "k": ks, "c": [1.0, 5.0, 10.0], "gamma": ["scale", "auto"]}),
        ("forest", "fit_forest", {**_TERMS, "k": ks, "trees": [200], "depth": [None, 8, 12], "min_split": [2, 5]}),
    ]


#: Search grids by size: (family, name of fit, parameter lists); 2, 156 and 252 settings.
GRIDS = {
    "tiny": [("logreg", "fit_logistic", {"c": [1.0]}), ("forest", "fit_forest", {"trees": [20], "k": [10]})],
    "small": _grid([10, 20, 30]),
    "big": _grid([10, 20, 30, 40, 50]),
}


def settings(grid: str | list) -> list[tuple[str, str, dict]]:
    """(family, name of fit, parameters) of each candidate of a grid, in order."""
    return [(family, fit, dict(zip(space, values))) for family, fit, space in (GRIDS[grid] if isinstance(grid, str) else grid) for values in itertools.product(*space.values())]


def grid_search(df: DataFrame, grid: str | list = "small", label: str = "label", key: str = "doc_id", seed: int = 42, parallel: int = 4) -> dict:
    """Cross-validated search over families; a later candidate must be strictly better.
    Candidates run parallel at a time on the same written rows; those of a fold share its features."""
    k = sampling.fold_count(df, label)
    every = settings(grid)
    ready = written(sampling.stratified_folds(df, label, k, key, seed))

    most = max((params.get("k", 30) for _, fit, params in every if fit != "fit_logistic"), default=1)
    folds = [Features(ready.where(F.col("fold") != i).drop("fold"), most) for i in range(k)]

    def score(job: tuple[int, int]) -> float:
        (_, fit, params), i = every[job[0]], job[1]
        model = globals()[fit](folds[i], **params)
        return macro_f1(predict(ready.where(F.col("fold") == i).drop("fold"), model), label)

    jobs = [(c, i) for c in range(len(every)) for i in range(k)]
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        scores = list(pool.map(score, jobs))
    tried = [(family, str(params), float(np.mean(scores[c * k : (c + 1) * k]))) for c, (family, _, params) in enumerate(every)]
    best = max(range(len(every)), key=lambda c: (tried[c][2], -c))
    return {"family": every[best][0], "params": every[best][2], "cv_macro_f1": tried[best][2], "fit": every[best][1], "tried": tried, "folds": k}


def dummy_scores(df: DataFrame, label: str = "label", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """One row: macro F1 of random labels over the test rows, and its mean over folds of the others.
    df has a split column of stratified_split."""
    rows = sampling.random_labels(df, key, seed)
    train = rows.where("split = 'train'")
    folds = sampling.stratified_folds(train, label, sampling.fold_count(train, label), key, seed)
    f1 = lambda d, by=None: evaluate.metrics(evaluate.confusion(d, label, "pred", by), by)
    cv = f1(folds, ["fold"]).agg(F.avg("macro_f1").alias("dummy_cv_macro_f1"))
    test = f1(rows.where("split = 'test'")).select(F.col("macro_f1").alias("dummy_test_macro_f1"))
    return test.join(F.broadcast(cv))  # one row each


def optimise(df: DataFrame, grid: str | list = "small", label: str = "label", key: str = "doc_id", seed: int = 42) -> dict:
    """Split, search, refit the best, score it on the test rows; accepted on the test rows and
    by cross-validation where it reaches 1.2 times the random labels scored the same way.
    The headline is the cross-validated check."""
    split = written(sampling.stratified_split(df, label, key, seed=seed))
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    found = grid_search(train, grid, label, key, seed)
    model = globals()[found["fit"]](train, **found["params"])
    scored = predict(test, model)
    test_f1, dummy = macro_f1(scored, label), dummy_scores(split, label, key, seed).first()
    gates = {"accepted_test": evaluate.accepted(test_f1, dummy.dummy_test_macro_f1), "accepted_cv": evaluate.accepted(found["cv_macro_f1"], dummy.dummy_cv_macro_f1)}
    return found | gates | {"model": model, "test": scored, "test_macro_f1": test_f1, "dummy_macro_f1": dummy.dummy_cv_macro_f1, "dummy_test_macro_f1": dummy.dummy_test_macro_f1, "accepted": gates["accepted_cv"]}
