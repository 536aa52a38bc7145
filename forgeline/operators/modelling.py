"""Imputation benchmark, feature preparation, classifiers and their evaluation, drift and cost."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.operators.profile import correlations, long_form
from forgeline.operators.quantiles import quantiles, running_sums, with_order_key
from forgeline.operators.windows import interpolate

#: Unit costs of a missed failure and a false alarm.
MISSED, FALSE_ALARM = 10_000.0, 500.0


def masked(c: str, key: str = "line_id", every: int = 10) -> Column:
    """A deterministic sample of known values: those whose key's MD5 (its first seven digits) is divisible by ``every``."""
    return F.col(c).isNotNull() & (F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % every == 0)


def moments(df: DataFrame, targets: dict[str, tuple[Column, Column, list[Column]]]) -> dict[str, np.ndarray]:
    """For each target (rows to use, value, inputs) the matrix of summed products of (1, inputs, value), all in one aggregate."""
    sums, shape = {}, {}
    for name, (use, value, inputs) in targets.items():
        vector = [F.lit(1.0), *inputs, value]
        shape[name] = len(vector)
        sums |= {f"{name}|{i}|{j}": F.sum(F.when(use, vector[i] * vector[j])) for i in range(len(vector)) for j in range(i, len(vector))}
    one = df.agg(*[c.alias(k) for k, c in sums.items()]).first()
    out = {name: np.zeros((n, n)) for name, n in shape.items()}
    for k in sums:
        name, i, j = k.rsplit("|", 2)
        out[name][int(i), int(j)] = out[name][int(j), int(i)] = one[k] or 0.0
    return out


def least_squares(products: np.ndarray) -> np.ndarray:
    """Intercept and coefficients from a moment matrix whose last row and column are the target's; the shortest ones if there are several."""
    return np.linalg.lstsq(products[:-1, :-1], products[:-1, -1], rcond=None)[0]


def imputation_errors(df: DataFrame, columns: list[str], split: str = "split_set", key: str = "line_id") -> DataFrame:
    """(column_name, method, rmse) of median, interpolation and regression on masked values; all are fitted on train rows only.

    Regressions take the other columns, missing ones at their train mean, and are solved from one moment matrix; one pass fills all
    columns, one scores all methods.
    """
    train = F.coalesce(F.col(split) == "train", F.lit(False))
    as_double = df.withColumns({c: F.col(c).cast("double") for c in columns})
    rows = as_double.withColumns({f"_hidden_{c}": masked(c, key) for c in columns}).withColumns({f"_seen_{c}": F.when(~masked(c, key), F.col(c)) for c in columns})
    means = rows.filter(train).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]).first()
    centred = {c: F.coalesce(F.col(c) - means[c], F.lit(0.0)) for c in columns}
    others = {c: [centred[o] for o in columns if o != c] for c in columns}
    found = moments(rows, {c: (train & F.col(f"_seen_{c}").isNotNull(), F.col(c), others[c]) for c in columns})
    guesses = {}
    for c in columns:
        intercept, *slopes = (float(x) for x in least_squares(found[c]))
        guesses[c] = sum((x * b for x, b in zip(others[c], slopes)), F.lit(intercept))
    seen = long_form(rows.filter(train), [f"_seen_{c}" for c in columns])
    medians = quantiles(seen, ["column_name"], (0.5,), few=True).agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.get("q", F.lit(0))))).alias("_medians"))
    linear = {f"_linear_{c}": F.col(f"_seen_{c}") for c in columns}
    filled = interpolate(rows.withColumns(linear), list(linear)).join(F.broadcast(medians), F.lit(True))  # one row
    of = lambda c: {"median": F.element_at("_medians", F.lit(f"_seen_{c}")), "interpolation": F.col(f"_linear_{c}"), "regression": guesses[c]}
    errors = {f"{c}|{m}": F.sqrt(F.avg(F.when(F.col(f"_hidden_{c}"), (guess - F.col(c)) ** 2))) for c in columns for m, guess in of(c).items()}
    one = filled.agg(*[e.alias(k) for k, e in errors.items()]).unpivot([], list(errors), "_name", "rmse")
    return one.select(F.split_part("_name", F.lit("|"), F.lit(1)).alias("column_name"), F.split_part("_name", F.lit("|"), F.lit(2)).alias("method"), "rmse")


def best_imputation(errors: DataFrame) -> DataFrame:
    """(column_name, method): the one with the smallest error, ties by name."""
    return errors.filter("rmse IS NOT NULL").groupBy("column_name").agg(F.min_by("method", F.struct("rmse", "method")).alias("method"))


def prepared(columns: list[str], components: int | None = None) -> list:
    """Stages: train means for missing values, scaling to unit deviation, and optionally principal components."""
    stages = [Imputer(inputCols=columns, outputCols=[f"_i_{c}" for c in columns]), VectorAssembler(inputCols=[f"_i_{c}" for c in columns], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features" if not components else "_scaled", withMean=True)]
    return stages + ([PCA(k=components, inputCol="_scaled", outputCol="features")] if components else [])


def explained_variance(train: DataFrame, columns: list[str], components: int) -> list[float]:
    model = Pipeline(stages=prepared(columns, components)).fit(train)
    return model.stages[-1].explainedVariance.toArray().tolist()


def correlated(df: DataFrame, columns: list[str], limit: float = 0.95) -> list[str]:
    """Columns to leave out: the later one of each pair whose correlation is beyond ``limit``."""
    gone: set[str] = set()
    for r in correlations(df, columns).filter(F.abs("r") > limit).collect():  # columns squared at most
        if r["a"] not in gone:
            gone.add(r["b"])
    return [c for c in columns if c in gone]


def class_weights(label: str, weight: float) -> Column:
    return F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0))


def classifier(kind: str, train: DataFrame, columns: list[str] | None, label: str = "label", weight: float = 1.0, seed: int = 7) -> PipelineModel:
    """`logistic`, `forest` or `boosted`, fitted on train rows with positives weighted; without ``columns`` the rows have ``features`` already."""
    common = {"featuresCol": "features", "labelCol": label, "weightCol": "_weight"}
    made = {
        "logistic": lambda: LogisticRegression(maxIter=20, regParam=0.01, **common),
        "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **common),
        "boosted": lambda: GBTClassifier(maxIter=5, maxDepth=3, seed=seed, **common),
    }[kind]()
    return Pipeline(stages=[*(prepared(columns) if columns else []), made]).fit(train.withColumn("_weight", class_weights(label, weight)))


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with score, the probability of 1."""
    return model.transform(df).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; null where undefined."""
    y, p = F.col(label).cast("int") == 1, F.col(predicted).cast("int") == 1
    rows = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.withColumns({"precision": tp / F.nullif(tp + fp, F.lit(0)), "recall": tp / F.nullif(tp + fn, F.lit(0)), "f1": 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))})


def by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, p, q, _k): positives and others of each distinct score, and its order; null scores are left out."""
    per = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    return with_order_key(per, "threshold", "_k")


def thresholds(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, above, precision, recall): what each distinct score gives as a threshold, itself included; recall is null without positives.

    Sums run over scores in levels of bins, so no task holds all of them.
    """
    rows = by_score(df, label, score).withColumns({"_k": -F.col("_k"), "n": F.col("p") + F.col("q")})
    rows = running_sums(rows, "_k", {"_p": "p", "above": "n"})
    total = F.broadcast(df.filter(F.col(score).isNotNull()).agg(F.count_if(F.col(label) == 1).alias("_all")))  # one row
    return rows.join(total, F.lit(True)).select("threshold", "above", (F.col("_p") / F.col("above")).alias("precision"), (F.col("_p") / F.nullif("_all", F.lit(0))).alias("recall"))


def recall_at(df: DataFrame, precision: float = 0.8, **options) -> DataFrame:
    """(recall, threshold): the best recall at no less precision, over all distinct scores."""
    good = thresholds(df, **options).filter(F.col("precision") >= precision)
    return good.agg(F.max("recall").alias("recall"), F.max_by("threshold", F.struct("recall", "threshold")).alias("threshold"))


def area_under_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(auc): the share of pairs that are ordered rightly, ties counting half; from the ranks of distinct scores."""
    rows = running_sums(by_score(df, label, score), "_k", {"_q": "q"})
    right = F.sum(F.col("p") * (F.col("_q") - F.col("q") / 2))
    return rows.agg((right / F.nullif(F.sum("p").cast("double") * F.sum("q"), F.lit(0.0))).alias("auc"))


def drift(df: DataFrame, column: str, period: str, reference: str, bins: int = 10, alert: float = 0.2) -> DataFrame:
    """(period, psi, alert): stability index of each period against the reference one, by its deciles.

    Empty bins count as a share of 0.0001.
    """
    known = df.filter(F.col(column).isNotNull()).select(F.col(period).alias("period"), F.col(column).cast("double").alias("x"))
    first = known.filter(F.col("period") == reference).select(F.col("x").alias("value"))
    edges = quantiles(first, [], tuple(k / bins for k in range(1, bins)), few=True).select(F.col("q").alias("_edges"))
    placed = known.join(F.broadcast(edges), F.lit(True)).select("period", F.size(F.filter("_edges", lambda e: e <= F.col("x"))).alias("bin"))
    counted = placed.groupBy("period").pivot("bin", list(range(bins))).count().na.fill(0)
    total = sum((F.col(str(b)) for b in range(1, bins)), F.col("0"))
    shares = counted.select("period", F.array(*[F.greatest(F.col(str(b)) / total, F.lit(0.0001)) for b in range(bins)]).alias("s"))
    base = shares.filter(F.col("period") == reference).select(F.col("s").alias("r"))
    terms = F.zip_with("s", "r", lambda a, b: (a - b) * F.ln(a / b))
    return shares.join(F.broadcast(base), F.lit(True)).select("period", F.aggregate(terms, F.lit(0.0), lambda a, b: a + b).alias("psi")).withColumn("alert", F.col("psi") > alert)


def cost(confused: DataFrame, missed: float = MISSED, false_alarm: float = FALSE_ALARM) -> DataFrame:
    """``confused`` with cost_missed, cost_false_alarms and cost_total."""
    rows = confused.withColumns({"cost_missed": F.col("fn") * missed, "cost_false_alarms": F.col("fp") * false_alarm})
    return rows.withColumn("cost_total", F.col("cost_missed") + F.col("cost_false_alarms"))
