"""Data sets, models and metrics on top of pyspark.ml."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.information import coefficient
from roadloom.operators.grouped import map_groups

# Column names with any of these parts are no model features.
IRRELEVANT = ["dist_from_last_track", "end_count_", "rel_end_count_", "trips_per_day", "trips_odd", "rel_match_count_", "height", "day", "minute", "hour"]


def drop_irrelevant(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not any(x in c for x in IRRELEVANT)))


def plain_names(df: DataFrame) -> DataFrame:
    """Names that pyspark.ml takes: every other character becomes an underscore."""
    return df.toDF(*("".join(ch if ch.isalnum() else "_" for ch in c) for c in df.columns))


def dataset(features: DataFrame, tracks: DataFrame, positive: str = "Bus") -> DataFrame:
    """Features with a 0/1 label by the trip's origin."""
    y = tracks.select(F.col("IncomingTrackId"), (F.col("TrackOrigin") == positive).cast("int").alias("label"))
    return drop_irrelevant(features).join(y, "IncomingTrackId").where("label is not null")


def relabel(df: DataFrame, column: str, ids: DataFrame, key: str, value: str) -> DataFrame:
    """column set to value where the key is in the id list."""
    hit = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, key, "left").withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(column))).drop("__hit")


def codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Category codes in alphabetical order."""
    return StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc").fit(df).transform(df)


def stratified_split(df: DataFrame, label: str, key: str, share: float, seed: int = 223) -> tuple[DataFrame, DataFrame]:
    """Two parts with the same share of each class, rounded up to whole rows, by a hash of the key.

    Rows are counted by class and range of the hash; only those of the range that the cut falls in are
    numbered, so a class with most of the rows isn't sorted in one task. Rows of one key stay together.
    """
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    ranked = df.select(F.col(label).alias("__class"), F.col(key).alias("__key"), h.alias("__hash")).withColumn("__range", F.shiftright("__hash", 40 - 12))
    sizes = ranked.groupBy("__class", "__range").agg(F.count("*").alias("n"))
    w = Window.partitionBy("__class")
    upto = F.sum("n").over(w.orderBy("__range"))
    wanted = F.ceil(F.sum("n").over(w).cast("decimal(19,0)") * F.lit(Decimal(str(share)))).cast("long")
    sizes = sizes.select("__class", "__range", "n", upto.alias("upto"), wanted.alias("wanted"))
    cut = sizes.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted"))).select(F.col("__class").alias("__c"), F.col("__range").alias("__r"), (F.col("wanted") - F.col("upto") + F.col("n")).alias("__nth"))
    inside = ranked.join(F.broadcast(cut), F.col("__class").eqNullSafe(F.col("__c")) & (F.col("__range") == F.col("__r")))
    nth = F.row_number().over(Window.partitionBy("__class").orderBy("__hash", "__key"))
    bounds = inside.withColumn("__n", nth).where("__n = __nth").select("__class", F.struct("__hash", "__key").alias("__bound"))
    marked = df.join(F.broadcast(bounds), F.col(label).eqNullSafe(F.col("__class")), "left").drop("__class")
    first = F.coalesce(F.struct(h.alias("__hash"), F.col(key).alias("__key")) <= F.col("__bound"), F.lit(False))
    return marked.where(first).drop("__bound"), marked.where(~first).drop("__bound")


def _features_of(df: DataFrame, label: str, drop: tuple[str, ...]) -> list[str]:
    return [c for c, t in df.dtypes if c not in (label, *drop) and t in ("double", "float", "int", "bigint", "boolean", "smallint")]


def booster(df: DataFrame, label: str = "label", drop: tuple[str, ...] = (), rounds: int = 60, depth: int = 5, rate: float = 0.1, validation: str | None = None) -> PipelineModel:
    """Gradient-boosted trees over all numeric columns; stops early on a validation mark if there is one."""
    cols = _features_of(df, label, (*drop, validation or ""))
    gbt = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=0)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"), gbt]).fit(df)


def forest(df: DataFrame, label: str = "label", drop: tuple[str, ...] = (), trees: int = 150) -> PipelineModel:
    rf = RandomForestClassifier(labelCol=label, numTrees=trees, seed=0)
    return Pipeline(stages=[VectorAssembler(inputCols=_features_of(df, label, drop), outputCol="features", handleInvalid="keep"), rf]).fit(df)


def cross_validate(df: DataFrame, grid: dict[str, list] | None = None, label: str = "label", drop: tuple[str, ...] = (), folds: int = 5, fold_col: str | None = None) -> tuple[PipelineModel, list[float], list[dict]]:
    """Best model, mean AUC of each parameter set, and the sets."""
    gbt = GBTClassifier(labelCol=label, maxIter=20, maxDepth=3, seed=0)
    b = ParamGridBuilder()
    for name, values in (grid or {}).items():
        b = b.addGrid(getattr(gbt, name), values)
    sets = b.build()
    cols = _features_of(df, label, (*drop, fold_col or ""))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"), gbt])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=sets, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=0, parallelism=2)
    if fold_col:
        cv = cv.setFoldCol(fold_col)
    fitted = cv.fit(df)
    return fitted.bestModel, list(fitted.avgMetrics), [{p.name: v for p, v in s.items()} for s in sets]


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds proba, the probability of class 1."""
    out = model.transform(df).withColumn("proba", vector_to_array("probability")[1])
    return out.select(*(F.col(f"`{c}`") for c in df.columns), "proba")


def learning_curve(df: DataFrame, key: str, shares: list[float], label: str = "label", trees: int = 150) -> list[tuple[float, float]]:
    """(share, AUC on a fixed fifth) of forests trained on growing shares of the other rows."""
    train, test = stratified_split(df, label, key, 0.8)
    out = []
    for share in shares:
        part = stratified_split(train, label, key, share, seed=7)[0] if share < 1 else train
        scored = score(test, forest(part, label, (key,), trees))
        out.append((share, auc(scored, label, "proba").first().auc))
    return out


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """Features by falling importance."""
    names = model.stages[0].getInputCols()
    weight = model.stages[-1].featureImportances
    return sorted(((n, float(weight[i])) for i, n in enumerate(names)), key=lambda x: (-x[1], x[0]))


def select_important(df: DataFrame, model: PipelineModel, least: float = 0.021, keep: tuple[str, ...] = ("label",)) -> DataFrame:
    return df.select(*[n for n, w in importances(model) if w > least], *keep)


def auc(df: DataFrame, label: str, value: str, parts: int = 200) -> DataFrame:
    """Area under the curve from the rank sums of distinct scores; 0 where there is one class only.

    Scores are counted first, then cut into ranges at approximate quantiles: the running sums are
    taken within each range and over the ranges' totals, so no task orders all scores.
    """
    y = F.col(label).cast("long")
    g = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"))
    cuts = sorted(set(g.approxQuantile("s", [i / parts for i in range(1, parts)], 0.002)))
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("s"))) if cuts else F.lit(0)
    g = g.withColumn("part", at)
    whole = g.groupBy("part").agg(F.sum("q").alias("q"))
    whole = whole.select("part", F.coalesce(F.sum("q").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("q").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.withColumn("inner", inner).join(F.broadcast(whole), "part")
    wins = F.sum(F.col("p") * (F.col("before") + F.col("inner") + F.col("q") / 2))
    return g.agg(F.coalesce(F.try_divide(wins, F.sum("p") * F.sum("q")), F.lit(0.0)).alias("auc"))


def confusion(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    return df.select(F.col(label).alias("label"), predicted.cast("int").alias("predicted")).groupBy("label", "predicted").agg(F.count("*").alias("n"))


def threshold_sweep(df: DataFrame, label: str, value: str, thresholds: list[float]) -> DataFrame:
    """Accuracy, F1 and the recall of each class at each threshold, in one aggregation."""
    marks = df.select(F.col(label).alias("y"), F.col(value).alias("s"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    yes = F.col("s") >= F.col("threshold")
    n = lambda c: F.sum(c.cast("int"))
    tp, fp, fn, tn = n(yes & (F.col("y") == 1)), n(yes & (F.col("y") == 0)), n(~yes & (F.col("y") == 1)), n(~yes & (F.col("y") == 0))
    zero = F.lit(0.0)
    return marks.groupBy("threshold").agg(
        ((tp + tn) / F.count("*")).alias("accuracy"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
        F.coalesce(F.try_divide(tp, tp + fn), zero).alias("recall_1"),
        F.coalesce(F.try_divide(tn, tn + fp), zero).alias("recall_0"),
    )


def mutual_information(df: DataFrame, label: str, columns: list[str], bins: int = 10) -> DataFrame:
    """(name, rank): mutual information of the label and each column in equal-width bins, in bits.

    A quick look; ``information_coefficients`` searches over all grids.
    """
    ends = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    parts = []
    for i, c in enumerate(columns):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        span = (hi - lo) if lo is not None and hi > lo else None
        b = F.least(F.lit(bins - 1), F.floor((F.col(c) - F.lit(lo)) * bins / F.lit(span)).cast("int")) if span else F.lit(0)
        parts.append(F.struct(F.lit(c).alias("name"), b.alias("b")))
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*parts)).alias("x")).select("y", "x.name", "x.b")
    joint = long.groupBy("name", "b", "y").agg(F.count("*").alias("n"))
    total, by_b, by_y = (F.sum("n").over(Window.partitionBy(*k)) for k in (["name"], ["name", "b"], ["name", "y"]))
    joint = joint.withColumn("t", total).withColumn("nb", by_b).withColumn("ny", by_y)
    return joint.groupBy("name").agg(F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("rank"))


def information_coefficients(df: DataFrame, label: str, columns: list[str], alpha: float = 0.6, finer: int = 15, most_cells: int = 200, values: int = 1000) -> DataFrame:
    """(name, rank): the maximal information coefficient of the label and each column.

    Each axis has a place for each value, or for each of ``values`` quantiles where it has more; points are
    counted by cell in one pass, so a column's cells are bounded whatever the rows, and each column's grids
    are searched in a task of their own. Grids beyond ``most_cells`` (of the 0.6th power of some 6 800
    rows) are not searched. Rows without the column or the label don't count.
    """
    names = [label, *columns]
    one = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names))))
    long = df.select(one.alias("x")).select("x.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    kinds = long.groupBy("i", "v").agg(F.count("*").alias("n"))
    many = {r["i"] for r in kinds.groupBy("i").count().where(F.col("count") > values).collect()}  # columns
    cuts: dict[int, list[float]] = {i: [] for i in range(len(names))}
    few = [i for i in cuts if i not in many]
    for r in kinds.where(F.col("i").isin(few)).select("i", "v").collect():  # at most ``values`` for each column
        cuts[r["i"]].append(r["v"])
    if many:
        shares = [k / values for k in range(values)]
        for r in long.where(F.col("i").isin(list(many))).groupBy("i").agg(F.percentile_approx("v", shares, 20 * values).alias("q")).collect():
            cuts[r["i"]] = list(set(r["q"]))
    edges = {i: np.sort(np.array(x, float)) for i, x in cuts.items()}
    shared = df.sparkSession.sparkContext.broadcast(edges)

    def count(batches):
        found: dict[tuple[int, int, int], int] = {}
        for b in batches:
            v = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            at = [np.where(np.isnan(x), -1, np.searchsorted(shared.value[i], np.nan_to_num(x), "right") - 1) for i, x in enumerate(v)]
            at = [np.where(np.isnan(x), -1, np.maximum(p, 0)) for x, p in zip(v, at, strict=True)]
            for i in range(1, len(v)):
                ok = (at[0] >= 0) & (at[i] >= 0)
                pairs, n = np.unique(np.column_stack([at[0][ok], at[i][ok]]), axis=0, return_counts=True)
                for (y, x), k in zip(pairs.tolist(), n.tolist(), strict=True):
                    found[i, x, y] = found.get((i, x, y), 0) + k
        for lo in range(0, len(found), 10_000):
            part = list(found.items())[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k, _ in part], pa.int32()) for j in range(3)] + [pa.array([n for _, n in part], pa.int64())], names=["i", "x", "y", "n"])

    cells = df.select(*(F.col(c).cast("double") for c in names)).mapInArrow(count, "i int, x int, y int, n bigint").groupBy("i", "x", "y").agg(F.sum("n").alias("n"))

    def search(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        i, x, y, n = (c.to_numpy() for c in rows.columns)
        ends = np.append(starts[1:], rows.num_rows)
        mic = [coefficient(x[a:b], y[a:b], n[a:b].astype(float), alpha, finer, most_cells) for a, b in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in i[starts]]), pa.array(mic)], names=["name", "rank"])

    return map_groups(cells, ["i"], ["x", "y"], ["x", "y", "n"], "name string, rank double", search)
