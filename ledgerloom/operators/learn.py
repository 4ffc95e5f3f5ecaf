"""Supervised and unsupervised scoring on wide tables: imputation, selection, a stacked ensemble, calibration, isolation forest.

Learners are Spark ML's; a second tree learner (random forest) stands where a second boosting library would, for
variety. Folds are exact and deterministic (metrics.folds). Attributions are those of the linear model.
"""

import json
import pickle
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import finite, quantiles
from ledgerloom.operators.metrics import folds
from ledgerloom.sources.io import written
from ledgerloom.shipping import ship

#: FITS: models fitted side by side.
ISOTONIC_FROM, ROWS_A_TASK, FITS = 100, 20_000, 8
#: Tree counts: base learners, isolation forest, feature ranker, integrity audit.
TREES, ISOLATION_TREES, GAIN_TREES, AUDIT_TREES = 400, 300, 150, 200


def medians(df: DataFrame, names: list[str]) -> dict[str, float]:
    """The median of each column's finite values, 0 without any."""
    found = {r.column: r.value for r in quantiles(df, names, [0.5]).collect()}
    return {c: float(found.get(c, 0.0)) for c in names}


def impute(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(v)) for c, v in fill.items()})


def _vector(df: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="keep").transform(df)


def weighted(df: DataFrame, target: str = "y") -> DataFrame:
    """df with _w: negatives over positives for a positive, 1 for a negative."""
    c = df.agg(F.sum(target).alias("p"), F.count("*").alias("n")).first()
    return df.withColumn("_w", F.when(F.col(target) == 1, F.lit(max(1.0, (c["n"] - (c["p"] or 0)) / max(1, c["p"] or 0)))).otherwise(F.lit(1.0)))


def _packed(df: DataFrame) -> DataFrame:
    """df in as many partitions as its rows fill: a learner runs a job a tree or level, and small tables need no more tasks."""
    rows = written(df, "training")
    return rows.coalesce(max(1, -(-rows.count() // ROWS_A_TASK)))


def _fit(kind: str, df: DataFrame, names: list[str], target: str, trees: int):
    df = _packed(df)
    common = {"featuresCol": "_x", "labelCol": target, "weightCol": "_w", "seed": 42}
    if kind == "gbt":
        model = GBTClassifier(maxIter=trees, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, **common)
    else:
        model = RandomForestClassifier(numTrees=trees, maxDepth=7, subsamplingRate=0.8, **common)
    return model.fit(_vector(weighted(df, target), names))


def _score(model, df: DataFrame, names: list[str], out: str) -> DataFrame:
    # a model of rows of one class has one probability
    x = model.transform(_vector(df, names)).withColumn(out, F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)))
    return x.select(*df.columns, out)


def _together(jobs: list) -> list:
    """The results of functions without arguments, run side by side: a learner waits for one small job after another most of the time."""
    with ThreadPoolExecutor(max(1, min(FITS, len(jobs)))) as pool:
        return list(pool.map(lambda f: f(), jobs))


def feature_gain(df: DataFrame, names: list[str], target: str = "y", k: int = 250, trees: int = GAIN_TREES) -> DataFrame:
    """feature, gain, place: the k features with the largest gain in a boosted model."""
    gain = _fit("gbt", impute(df, medians(df, names)), names, target, trees).featureImportances.toArray()
    rows = sorted(zip(names, map(float, gain), strict=True), key=lambda x: (-x[1], x[0]))[:k]
    return df.sparkSession.createDataFrame([(n, g, i + 1) for i, (n, g) in enumerate(rows)], "feature string, gain double, place int")


class IsolationForest:
    """Trees on small samples, each drawn by hash from all rows and grown on the executors; scoring runs map-side on Arrow batches."""

    def __init__(self, trees: int = ISOLATION_TREES, sample: int = 256, seed: int = 42):
        self.trees, self.sample, self.seed, self.forest = trees, sample, seed, []

    def fit(self, df: DataFrame, names: list[str], key: str) -> "IsolationForest":
        self.names, self.fill = names, medians(df, names)
        rows = impute(df, self.fill)
        total = rows.count()
        self.n = min(self.sample, total)
        # each tree takes the n smallest of its own hashes; rows above a share that holds them all but surely are not sent
        share = min(1.0, (self.n + 8 * np.sqrt(self.n) + 16) / max(1, total))
        while total:
            found = self._trees(rows, key, share).collect()
            if share == 1.0 or len(found) == self.trees and all(r.n >= self.n for r in found):
                break
            share = min(1.0, share * 4)
        self.forest = [pickle.loads(r.nodes) for r in sorted(found, key=lambda r: r.tree)] if total else []
        self.lo, self.hi = self._range(rows)
        return self

    def _trees(self, rows: DataFrame, key: str, share: float) -> DataFrame:
        """tree, n (rows it could draw from), nodes."""
        names, trees, n, seed = self.names, self.trees, self.n, self.seed
        depth = max(1, int(np.ceil(np.log2(max(2, n)))))
        below = np.uint64(min(2**64 - 1, int(share * 2**64)))
        salts = np.random.default_rng(seed).integers(0, 2**64, trees, dtype=np.uint64)
        ship(rows.sparkSession)

        def deal(batches):
            for b in batches:
                h = b["_h"].to_numpy().view(np.uint64)[:, None] ^ salts[None, :]
                for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
                h ^= h >> np.uint64(31)
                at, tree = np.nonzero(h <= below)
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(h[at, tree].view(np.int64)), *[b[c].take(pa.array(at)) for c in names]], ["tree", "_h", *names])

        def grow(table):
            order = np.argsort(table["_h"].to_numpy().view(np.uint64), kind="stable")[:n]
            x, tree = np.column_stack([table[c].to_numpy()[order] for c in names]), table["tree"][0].as_py()
            nodes = self._grow(x, depth, np.random.default_rng([seed, tree]))
            return pa.table({"tree": pa.array([tree], pa.int32()), "n": pa.array([table.num_rows], pa.int64()), "nodes": pa.array([pickle.dumps(nodes)], pa.binary())})

        dealt = rows.select(F.xxhash64(F.col(key), *names, F.lit(seed)).alias("_h"), *names).mapInArrow(deal, ", ".join(["tree int", "_h long", *[f"`{c}` double" for c in names]]))
        return dealt.groupBy("tree").applyInArrow(grow, "tree int, n long, nodes binary")

    def _range(self, rows: DataFrame) -> tuple[float, float]:
        """The least and the largest raw score of all rows."""
        names = self.names

        def run(batches):
            for b in batches:
                if b.num_rows:
                    raw = self.raw(np.column_stack([b[c].to_numpy(zero_copy_only=False) for c in names]))
                    yield pa.RecordBatch.from_arrays([pa.array([raw.min()]), pa.array([raw.max()])], ["lo", "hi"])

        r = rows.select(*names).mapInArrow(run, "lo double, hi double").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
        return (r.lo, r.hi) if r.lo is not None else (0.0, 0.0)

    def _grow(self, x, depth, rng):
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(x.shape[1])
        live = np.flatnonzero(spread > 0)
        if depth == 0 or len(x) <= 1 or not len(live):
            return self._path(len(x))
        j = int(rng.choice(live))
        cut = float(rng.uniform(x[:, j].min(), x[:, j].max()))
        left = x[:, j] < cut
        return j, cut, self._grow(x[left], depth - 1, rng), self._grow(x[~left], depth - 1, rng)

    @staticmethod
    def _path(n: int) -> float:
        """Mean depth of an unsuccessful search among n rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.forest:
            stack = [(tree, np.arange(len(x)), 0)]
            while stack:
                node, at, depth = stack.pop()
                if not isinstance(node, tuple):
                    total[at] += depth + node
                elif len(at):
                    left = x[at, node[0]] < node[1]
                    stack += [(node[2], at[left], depth + 1), (node[3], at[~left], depth + 1)]
        return 2.0 ** (-(total / max(1, len(self.forest))) / max(self._path(self.n), 1e-9))

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """key, p_iso: the score scaled by the range over all training rows, 0..1."""
        names = self.names

        ship(df.sparkSession)

        def run(batches):
            for b in batches:
                x = np.column_stack([b[c].to_numpy(zero_copy_only=False) for c in names]) if b.num_rows else np.zeros((0, len(names)))
                p = np.clip((self.raw(x) - self.lo) / max(self.hi - self.lo, 1e-12), 0, 1)
                yield pa.RecordBatch.from_arrays([b[key], pa.array(p)], [key, "p_iso"])

        kind = dict(df.dtypes)[key]
        return impute(df, self.fill).select(key, *names).mapInArrow(run, f"{key} {kind}, p_iso double")


class Calibration:
    """Points (score, p) of a monotone map: Platt's curve on the log odds, from 100 positives on isotonic steps with lines between them."""

    def __init__(self, points: dict):
        self.points = points

    @classmethod
    def fit(cls, scored: DataFrame, score: str, target: str = "y") -> "Calibration":
        pos = scored.agg(F.sum(target)).first()[0] or 0
        if pos >= ISOTONIC_FROM:
            iso = IsotonicRegression(featuresCol=score, labelCol=target).fit(scored.withColumn(target, F.col(target).cast("double")))
            return cls({"at": iso.boundaries.toArray().tolist(), "p": iso.predictions.toArray().tolist()})
        platt = LogisticRegression(featuresCol="_x", labelCol=target, maxIter=50).fit(_vector(scored.withColumn("_l", cls._logit(score)), ["_l"]))
        return cls({"slope": float(platt.coefficients[0]), "shift": float(platt.intercept)})

    @staticmethod
    def _logit(score: str):
        x = F.least(F.greatest(F.col(score), F.lit(1e-9)), F.lit(1 - 1e-9))
        return F.ln(x / (1 - x))

    def apply(self, df: DataFrame, score: str) -> DataFrame:
        """df with p."""
        if "slope" in self.points:
            return df.withColumn("p", 1 / (1 + F.exp(-(F.lit(self.points["slope"]) * self._logit(score) + F.lit(self.points["shift"])))))
        at, p, x = F.lit(self.points["at"]), F.lit(self.points["p"]), F.col(score)
        n = len(self.points["at"])
        d = df.withColumn("_i", F.size(F.filter(at, lambda b: b <= x)))
        lo, hi = F.get(at, F.col("_i") - 1), F.get(at, F.col("_i"))
        line = F.get(p, F.col("_i") - 1) + (F.get(p, F.col("_i")) - F.get(p, F.col("_i") - 1)) * (x - lo) / F.nullif(hi - lo, F.lit(0.0))
        value = F.when(F.col("_i") == 0, F.lit(self.points["p"][0])).when(F.col("_i") == n, F.lit(self.points["p"][-1])).otherwise(line)
        return d.withColumn("p", value).drop("_i")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _base_scores(rows: DataFrame, names: list[str], target: str, k: int, trees: int, seed: int = 42) -> DataFrame:
    """id, target, fold and the base learners' scores of rows (with fold) that each of them was not fitted on."""

    def one(i: int):
        train, test = rows.filter(F.col("fold") != i), rows.filter(F.col("fold") == i)
        fill = medians(train, names)
        train, test = impute(train, fill), impute(test, fill)
        gbt, rf, iso = _together([lambda: _fit("gbt", train, names, target, trees), lambda: _fit("rf", train, names, target, trees), lambda: IsolationForest(seed=seed).fit(train, names, "id")])
        test = _score(rf, _score(gbt, test, names, "p_gbt"), names, "p_rf")
        return test.join(iso.transform(test, "id"), "id").select("id", target, "fold", *META)

    return written(_union(_together([lambda i=i: one(i) for i in range(k)])), "oof")


META = ["p_gbt", "p_rf", "p_iso"]


def _meta(base: DataFrame, target: str):
    return LogisticRegression(featuresCol="_x", labelCol=target, weightCol="_w", maxIter=50).fit(_vector(weighted(base, target), META))


def _stacked(base: DataFrame, target: str, k: int) -> DataFrame:
    """base with p_stack: the balanced logistic stack fitted on the other folds."""
    return written(_union([_score(_meta(base.filter(F.col("fold") != i), target), base.filter(F.col("fold") == i), META, "p_stack") for i in range(k)]), "stack")


class Ensemble:
    """The stack as one model: base learners on all rows, a logistic stack and a calibrator fitted on their inner out-of-fold scores.

    thresholds: of precision-first and high-recall operation, also from inner scores. fill: the training medians.
    """

    def __init__(self, names: list[str], trees: int = TREES, k: int = 3, seed: int = 42):
        self.names, self.trees, self.k, self.seed = list(names), trees, k, seed

    def fit(self, df: DataFrame, key: str, target: str = "y", precision: float = 0.90) -> "Ensemble":
        from ledgerloom.operators.metrics import pick_threshold

        rows = df.select(F.col(key).alias("id"), F.col(target).cast("int").alias("y"), *self.names)
        rows = written(folds(rows, self.k, self.seed).select("id", "y", "fold", *self.names), "folds")
        base = _base_scores(rows, self.names, "y", self.k, self.trees, self.seed)
        stack = _stacked(base, "y", self.k)
        self.calibration = Calibration.fit(stack, "p_stack", "y")
        picked = {n: pick_threshold(self.calibration.apply(stack, "p_stack").select("id", "y", "p"), t).first() for n, t in (("precision", precision), ("recall", precision / 2))}
        self.thresholds = {n: float(r.threshold) for n, r in picked.items()}
        self.target_met = bool(picked["precision"].reached)
        self.meta = _meta(base, "y")
        self.fill = medians(rows, self.names)
        whole = impute(rows, self.fill)
        gbt, rf, self.forest = _together([lambda: _fit("gbt", whole, self.names, "y", self.trees), lambda: _fit("rf", whole, self.names, "y", self.trees), lambda: IsolationForest(seed=self.seed).fit(whole, self.names, "id")])
        self.base = {"gbt": gbt, "rf": rf}
        return self

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """key, the base learners' scores, p (calibrated)."""
        x = impute(df.select(key, *self.names), self.fill)
        for kind, model in self.base.items():
            x = _score(model, x, self.names, f"p_{kind}")
        x = x.join(self.forest.transform(x, key), key)
        return self.calibration.apply(_score(self.meta, x, META, "p_stack"), "p_stack").select(key, *META, "p")

    def save(self, path: str, spark) -> None:
        """Spark models beside one table of settings, all by Spark's own writers."""
        for kind, model in self.base.items():
            model.write().overwrite().save(f"{path}/{kind}")
        self.meta.write().overwrite().save(f"{path}/meta")
        settings = {"names": self.names, "trees": self.trees, "k": self.k, "seed": self.seed, "fill": self.fill, "thresholds": self.thresholds, "target_met": self.target_met, "calibration": self.calibration.points, "forest": {"n": self.forest.n, "lo": self.forest.lo, "hi": self.forest.hi, "trees": self.forest.forest}}
        spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, path: str, spark) -> "Ensemble":
        from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel

        got = json.loads(spark.read.parquet(f"{path}/settings").first().settings)
        out = cls(got["names"], got["trees"], got["k"], got["seed"])
        out.fill, out.thresholds, out.target_met = got["fill"], got["thresholds"], got["target_met"]
        out.calibration = Calibration(got["calibration"])
        out.base = {"gbt": GBTClassificationModel.load(f"{path}/gbt"), "rf": RandomForestClassificationModel.load(f"{path}/rf")}
        out.meta = LogisticRegressionModel.load(f"{path}/meta")
        out.forest = IsolationForest(len(got["forest"]["trees"]))
        out.forest.names, out.forest.fill, out.forest.n = out.names, out.fill, got["forest"]["n"]
        out.forest.lo, out.forest.hi = got["forest"]["lo"], got["forest"]["hi"]
        node = lambda x: (x[0], x[1], node(x[2]), node(x[3])) if isinstance(x, list) else x
        out.forest.forest = [node(t) for t in got["forest"]["trees"]]
        return out


def cross_scores(rows: DataFrame, names: list[str], k: int = 5, trees: int = TREES) -> DataFrame:
    """id, y, fold, p of a boosted model on rows (id, y, names) that it was not fitted on."""
    rows = written(folds(rows, k).select("id", "y", "fold", *names), "folds")

    def one(i: int):
        train = rows.filter(F.col("fold") != i)
        fill = medians(train, names)
        return _score(_fit("gbt", impute(train, fill), names, "y", trees), impute(rows.filter(F.col("fold") == i), fill), names, "p").select("id", "y", "fold", "p")

    return written(_union(_together([lambda i=i: one(i) for i in range(k)])), "scores")


def nested_cv(df: DataFrame, names: list[str], key: str = "id", target: str = "y", repeats: int = 1, k: int = 5, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """(metrics by repeat and fold, pooled p by row): every fold is scored by an ensemble whose stack, calibrator and thresholds come
    from inner folds of the other rows. pooled: id, y, p averaged over repeats."""
    from ledgerloom.operators.metrics import auroc, average_precision, confusion

    rows = df.select(F.col(key).alias("id"), F.col(target).cast("int").alias("y"), *names)
    dealt = [written(folds(rows, k, 42 + r).select("id", "y", "fold", *names), "folds") for r in range(repeats)]

    def one(r: int, i: int):
        model = Ensemble(names, trees, seed=42 + r).fit(dealt[r].filter(F.col("fold") != i), "id", "y")
        test = dealt[r].filter(F.col("fold") == i)
        p = written(model.predict(test, "id").join(test.select("id", "y"), "id").select("id", "y", "p"), "scores")
        row = average_precision(p).crossJoin(auroc(p)).crossJoin(confusion(p, model.thresholds["precision"]).select("precision", "recall", "f1"))
        return row.select(F.lit(r + 1).alias("repeat"), F.lit(i).alias("fold"), F.round("auprc", 4).alias("auprc"), F.round("auroc", 4).alias("auroc"), "precision", "recall", "f1", F.lit(model.thresholds["precision"]).alias("threshold_high"), F.lit(model.thresholds["recall"]).alias("threshold_medium"), F.lit(model.target_met).alias("target_met")), p

    done = _together([lambda r=r, i=i: one(r, i) for r in range(repeats) for i in range(k)])
    found, pooled = [row for row, _ in done], [p for _, p in done]
    return written(_union(found), "cv"), _union(pooled).groupBy("id", "y").agg(F.avg("p").alias("p"))


def out_of_fold(df: DataFrame, names: list[str], key: str = "id", target: str = "y", k: int = 3, trees: int = TREES) -> DataFrame:
    """key, y, fold, p_gbt, p_rf, p_iso, p: base learners and their balanced logistic stack, all scored on rows not fitted on."""
    rows = written(folds(df.withColumnRenamed(key, "id"), k).select("id", target, "fold", *names), "folds")
    stack = _stacked(_base_scores(rows, names, target, k, trees), target, k)
    # a fold's calibrator is fitted on the other folds
    parts = [Calibration.fit(stack.filter(F.col("fold") != i), "p_stack", target).apply(stack.filter(F.col("fold") == i), "p_stack") for i in range(k)]
    return _union(parts).withColumnRenamed("id", key)


def gbt_scores(df: DataFrame, names: list[str], key: str, target: str = "y", trees: int = TREES) -> DataFrame:
    filled = impute(df, medians(df, names))
    return _score(_fit("gbt", filled, names, target, trees), filled, names, "p_gbt").select(key, target, "p_gbt")


def attributions(df: DataFrame, names: list[str], key: str, target: str = "y", k: int = 3) -> DataFrame:
    """id, feature, value out of fold: w_j (x_j - mean_j) of a standardised balanced logistic model of the other folds; they add up
    to the margin less the mean margin."""
    rows = written(folds(df.select(F.col(key).alias("id"), F.col(target).cast("int").alias("y"), *names), k).select("id", "y", "fold", *names), "folds")
    parts = []
    for i in range(k):
        train = rows.filter(F.col("fold") != i)
        fill = medians(train, names)
        train, test = impute(train, fill), impute(rows.filter(F.col("fold") == i), fill)
        model = LogisticRegression(featuresCol="_x", labelCol="y", weightCol="_w", maxIter=50, regParam=0.01).fit(_vector(weighted(train, "y"), names))
        mean = train.agg(*[F.avg(c).alias(c) for c in names]).first()
        cells = [F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.lit(float(mean[c] or 0.0))) * F.lit(float(w))).alias("value")) for c, w in zip(names, model.coefficients.toArray(), strict=True)]
        parts.append(test.select("id", F.explode(F.array(*cells)).alias("a")).select("id", "a.*"))
    return _union(parts)


def missingness_audit(df: DataFrame, names: list[str], key: str, target: str = "y", k: int = 3, trees: int = AUDIT_TREES) -> DataFrame:
    """test, auprc, prevalence: what blanks alone, weak columns, and shuffled labels can predict out of fold."""
    from ledgerloom.operators.metrics import average_precision
    from ledgerloom.operators.quality import target_correlation

    weak = [r.column for r in target_correlation(df, target, names).filter(F.abs("corr") < 0.05).collect()] or names[:1]
    blanks = df.select(key, target, *[F.col(c).isNull().cast("double").alias(c) for c in names])
    share = int((df.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0) * 1_000_000)
    # labels drawn by hash at the same rate: no relation to the rows, and no shuffle of all rows
    shuffled = df.withColumn(target, (F.pmod(F.xxhash64(F.col(key), F.lit("shuffled")), F.lit(1_000_000)) < share).cast("int"))

    def one(test: str, frame: DataFrame, cols: list[str]):
        scores = cross_scores(frame.select(F.col(key).alias("id"), F.col(target).cast("int").alias("y"), *cols), cols, k, trees)
        return average_precision(scores).select(F.lit(test).alias("test"), F.round("auprc", 4).alias("auprc")).crossJoin(scores.agg(F.round(F.avg(F.col("y").cast("double")), 4).alias("prevalence")))

    tests = (("missingness", blanks, names), ("weak_columns", df, weak), ("shuffled_labels", shuffled, names))
    return _union(_together([lambda t=t: one(*t) for t in tests]))


def degradation(df: DataFrame, names: list[str], key: str, target: str = "y", rates: tuple[float, ...] = (0.0, 0.25, 0.5), trees: int = TREES, k: int = 2) -> DataFrame:
    """rate, auprc out of fold of models fitted on rows with hashed column dropout, when that share of cells is missing."""
    from ledgerloom.operators.metrics import average_precision

    def masked(frame, rate, seed):
        return frame.withColumns({c: F.when(F.pmod(F.xxhash64(F.col("id"), F.lit(c), F.lit(seed)), F.lit(1000)) >= int(rate * 1000), F.col(c)) for c in names})

    rows = written(folds(df.select(F.col(key).alias("id"), F.col(target).cast("int").alias("y"), *names), k).select("id", "y", "fold", *names), "folds")

    def one(i: int):
        train, test = rows.filter(F.col("fold") != i), rows.filter(F.col("fold") == i)
        fill = medians(train, names)
        model = _fit("gbt", impute(_union([train, *[masked(train, r, j) for j, r in enumerate(rates[1:], 1)]]), fill), names, "y", trees)
        return {r: _score(model, impute(masked(test, r, 99), fill), names, "p").select("y", "p") for r in rates}

    done = _together([lambda i=i: one(i) for i in range(k)])
    return _union([average_precision(_union([d[r] for d in done])).select(F.lit(r).alias("rate"), F.round("auprc", 4).alias("auprc")) for r in rates])


#: Prefixes of encoded categories and row statistics, which are no behaviour although they begin with mg_.
NOT_BEHAVIOUR = ("mg_product_name", "mg_area_category", "mg_gender", "mg_segmentation", "mg_cust_occp", "mg_row_")


def ablation(df: DataFrame, names: list[str], key: str = "id", target: str = "y", k: int = 5, trees: int = TREES) -> DataFrame:
    """condition, n_features, mean and deviation of AUPRC and AUROC over the same folds: all columns, without the typology, typology alone."""
    from ledgerloom.operators.metrics import auroc, average_precision

    typology = [c for c in names if c.startswith("mg_") and not c.startswith(NOT_BEHAVIOUR)]
    parts = []
    for condition, use in (("FULL", names), ("RAW ONLY (typology removed)", [c for c in names if c not in typology]), ("TYPOLOGY ONLY", typology)):
        if not use:
            continue
        rows = df.select(F.col(key).alias("id"), F.col(target).cast("int").alias("y"), *use)
        scores = cross_scores(rows, use, k, trees)
        each = _union([average_precision(scores.filter(F.col("fold") == i)).crossJoin(auroc(scores.filter(F.col("fold") == i))) for i in range(k)])
        four = lambda c: F.round(c, 4)
        parts.append(each.agg(four(F.avg("auprc")).alias("auprc"), four(F.stddev_samp("auprc")).alias("auprc_std"), four(F.avg("auroc")).alias("auroc"), four(F.stddev_samp("auroc")).alias("auroc_std")).select(F.lit(condition).alias("condition"), F.lit(len(use)).alias("n_features"), "*"))
    return _union(parts)


def blind_holdout(df: DataFrame, key: str, target: str, month: str | None = None, positives: int = 13, negatives: int = 200) -> DataFrame:
    """df with held_out: positives spread over the extract months in proportion (each month at least one), negatives at random, by hash."""
    from pyspark.sql.window import Window

    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(":holdout")))
    group = F.coalesce(F.col(month).cast("string"), F.lit("")) if month else F.lit("")
    few = df.filter(F.col(target) == 1).select(F.col(key).alias("_k"), group.alias("_m"), h.alias("_h"))
    sizes = few.groupBy("_m").agg(F.count("*").alias("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    quota = F.greatest(F.lit(1), F.bround(F.lit(positives) * F.col("_n") / F.col("_all")))
    few = few.join(F.broadcast(sizes), "_m").withColumn("_r", F.row_number().over(Window.partitionBy("_m").orderBy("_h", "_k")))
    few = few.withColumn("_spare", F.col("_r") > quota)
    first = few.orderBy("_spare", F.when(F.col("_spare"), F.lit("")).otherwise(F.col("_m")), F.when(F.col("_spare"), F.lit(0)).otherwise(F.col("_r")), "_h", "_k").limit(positives)
    many = df.filter(F.col(target) == 0).select(F.col(key).alias("_k"), h.alias("_h")).orderBy("_h", "_k").limit(negatives)
    out = first.select("_k").unionByName(many.select("_k")).withColumn("held_out", F.lit(True))
    return df.join(F.broadcast(out), F.col(key) == F.col("_k"), "left").drop("_k").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def verdict(audit: DataFrame, sorted_by_label: bool, partition_purity: dict[str, float], prevalence: float) -> dict:
    """contaminated, grounds, unavailable: what says that a table gives its labels away by how it was put together.

    audit: rows of missingness_audit; a test without a score says nothing either way.
    """
    got = {r.test: r.auprc for r in audit.collect()}
    tests = {"missingness": "a model given only blank/not-blank patterns separates the classes far above the base rate", "weak_columns": "columns that are individually useless still separate the classes when combined"}
    known = {t: v for t, v in got.items() if v is not None and v == v}
    grounds = ["the file is ordered by label, so row position alone reproduces it and any unshuffled split is invalid"] if sorted_by_label else []
    grounds += [text for t, text in tests.items() if known.get(t, 0.0) > 10 * prevalence]
    if pure := [c for c, p in partition_purity.items() if p >= 0.999]:
        grounds.append(f"the classes fall into disjoint value sets of {', '.join(pure[:3])}, so that column alone reproduces the label")
    return {"contaminated": bool(grounds), "grounds": grounds, "unavailable": [t for t in tests if t not in known]}


def integrity_report(verdict_: dict, audit: DataFrame) -> str:
    """The audit as Markdown."""
    rows = "\n".join(f"| {r.test} | {'-' if r.auprc is None else r.auprc} | {r.prevalence} |" for r in audit.collect())
    head = "CONTAMINATED" if verdict_["contaminated"] else "No artefact detected"
    notes = "\n".join(f"- {g}" for g in verdict_["grounds"] + [f"{t} could not run on this table" for t in verdict_["unavailable"]])
    return f"# Integrity audit\n\n{head}\n\n{notes}\n\n| Test | AUPRC | Prevalence |\n|-|-|-|\n{rows}\n"
