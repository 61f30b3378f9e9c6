"""Classification: exact nearest neighbours, exact entropy trees, forests, evaluation, grid search."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics
from .resample import nearest, stratified_folds


class KNeighbours:
    """k nearest neighbours by Euclidean distance; a tied vote takes the smallest label."""

    def __init__(self, n_neighbors: int = 5, key: str = "id", label: str = "label", features: str = "features") -> None:
        self.n_neighbors, self.key, self.label, self.features = n_neighbors, key, label, features

    def get_params(self) -> dict:
        return dict(vars(self)) if not hasattr(self, "_train") else {k: v for k, v in vars(self).items() if k != "_train"}

    def set_params(self, **params) -> KNeighbours:
        for k, v in params.items():
            setattr(self, k, v)
        return self

    def fit(self, train: DataFrame) -> KNeighbours:
        self._train = train.select(self.key, self.label, self.features)
        return self

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        """(key, prediction, score): score is the share of votes for label 1."""
        near = nearest(rows, self._train, self.n_neighbors, self.key, self.features)
        votes = near.join(self._train.select(F.col(self.key).alias("_t"), F.col(self.label).alias("_y")), F.col("near") == F.col("_t")).groupBy(self.key, "_y").agg(F.count("*").alias("v"))
        w = Window.partitionBy(self.key)
        first = F.row_number().over(w.orderBy(F.desc("v"), "_y"))
        one = F.sum(F.when(F.col("_y") == 1, F.col("v")).otherwise(0)).over(w) / F.sum("v").over(w)
        return votes.withColumn("_n", first).withColumn("score", one).where("_n = 1").select(self.key, F.col("_y").alias("prediction"), "score")

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.predict_proba(rows).drop("score")

    decision_function = predict_proba


@dataclass
class Node:
    counts: dict
    feature: int | None = None
    threshold: float | None = None
    left: int | None = None
    right: int | None = None


def split_table(df: DataFrame, node: str, features: str, label: str, columns: list[int] | None = None) -> DataFrame:
    """Best entropy split of each (node): feature, threshold, gain.

    Values are first counted by (node, feature, value), so equal values weigh one row; running
    counts along the sorted values give every split's two sides.
    """
    tall = df.select(node, F.col(label).cast("int").alias("y"), F.posexplode(features).alias("f", "v"))
    if columns is not None:
        tall = tall.where(F.col("f").isin(columns))
    by = tall.groupBy(node, "f", "v").agg(F.sum(F.col("y")).cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    order = Window.partitionBy(node, "f").orderBy("v")
    whole = Window.partitionBy(node, "f")
    d = by.select(
        node, "f", "v", F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("lp"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("ln"),
        F.sum("p").over(whole).alias("tp"), F.sum("n").over(whole).alias("tn"), F.lead("v").over(order).alias("next"),
    ).where("next is not null")
    h = lambda p, n: f"(-({p}) / nullif({n}, 0) * log2(({p}) / nullif({n}, 0) + 1e-9) - (({n}) - ({p})) / nullif({n}, 0) * log2((({n}) - ({p})) / nullif({n}, 0) + 1e-9))"
    gain = F.expr(f"{h('tp', 'tn')} - ln / tn * {h('lp', 'ln')} - (tn - ln) / tn * {h('tp - lp', 'tn - ln')}")
    return d.select(node, F.col("f").alias("feature"), F.expr("(v + next) / 2").alias("threshold"), gain.alias("gain"), "ln", "tn")


class DecisionTree:
    """Exact binary entropy tree, grown level by level; thresholds are midpoints, `<=` goes left.

    Split search runs in Spark; only one row a node reaches the driver, so the number of rows is
    unbounded, the number of nodes is at most 2 ** max_depth.
    """

    def __init__(self, max_depth: int = 5, min_samples_split: int = 2, min_samples_leaf: int = 1, key: str = "id", label: str = "label", features: str = "features") -> None:
        self.max_depth, self.min_samples_split, self.min_samples_leaf = max_depth, min_samples_split, min_samples_leaf
        self.key, self.label, self.features = key, label, features

    def get_params(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "nodes"}

    def set_params(self, **params) -> DecisionTree:
        for k, v in params.items():
            setattr(self, k, v)
        return self

    def fit(self, train: DataFrame, columns: list[int] | None = None) -> DecisionTree:
        rows = train.select(self.key, F.col(self.label).cast("int").alias("y"), F.col(self.features).alias("x"))
        first = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        self.nodes = [Node(first)]
        open_ = [0] if len(first) > 1 else []
        for _ in range(self.max_depth):
            open_ = [i for i in open_ if sum(self.nodes[i].counts.values()) >= self.min_samples_split]
            if not open_:
                break
            at = rows.select(self.node_of("x").alias("node"), "y", "x").where(F.col("node").isin(open_))
            best = split_table(at, "node", "x", "y", columns).where(f"gain > 0 and ln >= {self.min_samples_leaf} and tn - ln >= {self.min_samples_leaf}")
            w = Window.partitionBy("node").orderBy(F.desc("gain"), "feature", "threshold")
            chosen = best.withColumn("n", F.row_number().over(w)).where("n = 1").collect()
            for r in chosen:
                node = self.nodes[r["node"]]
                node.feature, node.threshold, node.left, node.right = r["feature"], r["threshold"], len(self.nodes), len(self.nodes) + 1
                self.nodes += [Node({}), Node({})]
            made = [i for r in chosen for i in (self.nodes[r["node"]].left, self.nodes[r["node"]].right)]
            if not made:
                break
            for r in rows.select(self.node_of("x").alias("node"), "y").where(F.col("node").isin(made)).groupBy("node", "y").count().collect():
                self.nodes[r["node"]].counts[r["y"]] = r["count"]
            open_ = [i for i in made if len(self.nodes[i].counts) > 1]
        return self

    def node_of(self, features: str):
        """Column with the leaf that a row falls into: nested conditions, no UDF."""

        def walk(i: int):
            n = self.nodes[i]
            if n.feature is None:
                return F.lit(i)
            return F.when(F.col(features)[n.feature] <= n.threshold, walk(n.left)).otherwise(walk(n.right))

        return walk(0)

    def _leaf_map(self, of) -> dict:
        return {i: of(n.counts) for i, n in enumerate(self.nodes) if n.feature is None}

    def said(self):
        """Columns with the label and the score of the leaf that a row falls into."""
        label = self._leaf_map(lambda c: max(sorted(c), key=lambda y: c[y]) if c else 0)
        share = self._leaf_map(lambda c: c.get(1, 0) / sum(c.values()) if c else 0.0)
        look = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), self.node_of(self.features))
        return look(label), look(share)

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        label, share = self.said()
        return rows.select(self.key, label.alias("prediction"), share.alias("score"))

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.predict_proba(rows).drop("score")

    decision_function = predict_proba


@dataclass
class RandomForest:
    """Trees on exact bootstraps with a feature subset for each tree; the vote is by hard labels,
    the score the mean leaf share. Trees come from the seeded hash, so fits repeat."""

    n_estimators: int = 10
    max_depth: int = 5
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: str | int | None = "sqrt"
    bootstrap: bool = True
    random_state: int = 42
    key: str = "id"
    label: str = "label"
    features: str = "features"
    trees: list[DecisionTree] = field(default_factory=list)

    def _count(self, n: int) -> int:
        if self.max_features == "sqrt":
            return max(1, int(math.sqrt(n)))
        if self.max_features == "log2":
            return max(1, int(math.log2(n)))
        return min(int(self.max_features), n) if self.max_features else n

    def fit(self, train: DataFrame) -> RandomForest:
        from .resample import bootstrap

        width = len(train.select(self.features).first()[0])
        rng = np.random.default_rng(self.random_state)
        self.trees = []
        for t in range(self.n_estimators):
            columns = sorted(rng.choice(width, self._count(width), replace=False).tolist())
            rows = bootstrap(train, train.count(), self.key, self.random_state + t) if self.bootstrap else train
            self.trees.append(DecisionTree(self.max_depth, self.min_samples_split, self.min_samples_leaf, self.key, self.label, self.features).fit(rows, columns))
        return self

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        said = [t.said() for t in self.trees]
        votes = F.array(*[label for label, _ in said])
        mean = sum((share for _, share in said), F.lit(0.0)) / len(said)
        ones = F.size(F.filter(votes, lambda v: v == 1))
        return rows.select(self.key, F.when(2 * ones > len(said), 1).otherwise(0).alias("prediction"), mean.alias("score"))

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.predict_proba(rows).drop("score")

    decision_function = predict_proba


def evaluate(predicted: DataFrame, truth: DataFrame, key: str = "id", label: str = "label") -> dict:
    """The nine metrics of a binary classifier; AUC is None without scores."""
    d = predicted.join(truth.select(F.col(key).alias("_k"), F.col(label).alias("_y")), F.col(key) == F.col("_k"))
    m = metrics.binary_metrics(d, "_y", "prediction").first().asDict()
    m["roc_auc"] = metrics.roc_auc(d, "_y", "score").first()[0] if "score" in d.columns else None
    return {k: m[k] for k in ("accuracy", "precision", "recall", "f1", "roc_auc", "tn", "fp", "fn", "tp")}


def train_and_evaluate(train: DataFrame, test: DataFrame, model, key: str = "id", label: str = "label") -> DataFrame:
    """(metric, train, test) of a fitted model."""
    model.fit(train)
    a, b = (evaluate(model.predict_proba(d), d, key, label) for d in (train, test))
    return train.sparkSession.createDataFrame([(k, float(a[k]) if a[k] is not None else None, float(b[k]) if b[k] is not None else None) for k in a], "metric string, train double, test double")


def grid_search(train: DataFrame, make, grid: dict[str, list], folds: int = 5, scoring: str = "recall", key: str = "id", label: str = "label", seed: int = 42):
    """Mean and deviation of each metric over stratified folds for each parameter set, and the best set.

    Each candidate is validated once; ties go to the first.
    """
    d = stratified_folds(train, label, key, folds, seed)
    rows, best = [], (-1.0, {})
    for values in product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        scores = []
        for f in range(folds):
            part, held = d.where(F.col("fold") != f), d.where(F.col("fold") == f)
            scores.append(evaluate(make(**params).fit(part).predict_proba(held), held, key, label))
        row = {m: np.array([s[m] if s[m] is not None else np.nan for s in scores], float) for m in ("accuracy", "precision", "recall", "f1", "roc_auc")}
        rows.append((str(params), *[float(x) for m in row for x in (np.nanmean(row[m]), np.nanstd(row[m]))]))
        if np.nanmean(row[scoring]) > best[0]:
            best = (float(np.nanmean(row[scoring])), params)
    names = ", ".join(f"{m} double, {m}_std double" for m in ("accuracy", "precision", "recall", "f1", "roc_auc"))
    return train.sparkSession.createDataFrame(rows, f"params string, {names}"), best[1]


def tune_and_evaluate(train: DataFrame, test: DataFrame, make, grid: dict[str, list], **options) -> tuple[DataFrame, dict, dict]:
    """Grid search, refit of the best set on all training rows, metrics on the test rows."""
    table, best = grid_search(train, make, grid, **options)
    model = make(**best).fit(train)
    return table, best, evaluate(model.predict_proba(test), test, options.get("key", "id"), options.get("label", "label"))


def library_tree(train: DataFrame, depth: int = 20, split: int = 5, leaf: int = 5, features: str = "features", label: str = "label"):
    """MLlib entropy tree (binned thresholds), the scalable option."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    d = train.select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"))
    return DecisionTreeClassifier(impurity="entropy", maxDepth=min(depth, 30), minInstancesPerNode=max(leaf, split // 2), seed=42).fit(d)


def library_forest(train: DataFrame, trees: int = 50, depth: int = 30, leaf: int = 2, features: str = "features", label: str = "label"):
    """MLlib random forest: argmax of the mean probability."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    d = train.select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=min(depth, 30), minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=42).fit(d)


def to_pandas_bounded(df: DataFrame, most: int) -> pd.DataFrame:
    """Rows on the driver, refused beyond a stated number."""
    got = df.limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    return got
