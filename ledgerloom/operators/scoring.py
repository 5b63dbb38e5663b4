"""Questionnaires and model rows: encoding, assembling, scaling, scores, factors and alerts."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .expenses import behaviour_band
from .industry import feature_sources


def checked(ok: Column, value: Column, message: str) -> Column:
    """value, or an error where ok does not hold."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def one_hot(answer: Column, group: str, options: dict[str, str], optional: bool = False) -> dict[str, Column]:
    """A 0/1 column for each option of a single choice; an answer that is no option is an error."""
    ok = answer.isin(list(options))
    if optional:
        ok = F.coalesce(ok, F.lit(False)) | answer.isNull() | (answer == "")
    flag = lambda label: F.coalesce(answer == label, F.lit(False)).cast("double")
    return {f: checked(ok, flag(label), f"Missing or invalid answer for '{group}'") for label, f in options.items()}


def multi_hot(answer: Column, group: str, options: dict[str, str]) -> dict[str, Column]:
    """A 0/1 column for each option of a ``;``-separated choice of one or more."""
    chosen = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    ok = (F.size(chosen) > 0) & (F.size(F.array_except(chosen, F.array(*map(F.lit, options)))) == 0)
    return {f: checked(ok, F.array_contains(chosen, label).cast("double"), f"Select valid options for '{group}'") for label, f in options.items()}


def ordinal(answer: Column, group: str, steps: dict[str, float]) -> Column:
    value = F.try_element_at(F.create_map(*[F.lit(x) for kv in steps.items() for x in kv]), answer)
    return checked(value.isNotNull(), value, f"Missing or invalid answer for '{group}'")


def numeric(answer: Column, name: str, lifetime: bool = False) -> Column:
    value = answer.try_cast("double")
    if lifetime:
        value = F.when(F.lower(F.trim(answer)).isin(R.NOT_PURCHASED), 0.0).otherwise(value)
    return checked(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != math.inf), value, f"Missing numeric value for '{name}'")


def encode_profiles(df: DataFrame, *keys: str) -> DataFrame:
    """keys and all profile features. df has a string column for each question, ordinal, multi-select and number."""
    out: dict[str, Column] = {}
    for group, options in R.QUESTIONS.items():
        out |= one_hot(F.col(f"`{group}`"), group, options, group in R.OPTIONAL_QUESTIONS)
    for group, options in R.MULTI_QUESTIONS.items():
        out |= multi_hot(F.col(f"`{group}`"), group, options)
    for group, (name, steps) in R.ORDINAL_QUESTIONS.items():
        out[name] = ordinal(F.col(f"`{group}`"), group, steps)
    for name in R.NUMERIC_FEATURES:
        out[name] = numeric(F.col(f"`{name}`").cast("string"), name, name in R.LIFETIMES)
    return df.select(*keys, *[c.alias(n) for n, c in out.items()])


def decode_choice(options: dict[str, str]) -> Column:
    """The label of the largest flag, if that is at least one half."""
    best = F.array_max(F.array(*[F.struct(F.col(f"`{f}`").cast("double").alias("v"), F.lit(-k).alias("k"), F.lit(label).alias("label")) for k, (label, f) in enumerate(options.items())]))
    return F.when(best["v"] >= 0.5, best["label"])


def decode_many(options: dict[str, str]) -> Column:
    return F.filter(F.array(*[F.when(F.col(f"`{f}`") >= 0.5, label) for label, f in options.items()]), lambda x: x.isNotNull())


def decode_ordinal(name: str, steps: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(F.abs(F.col(f"`{name}`") - v) <= 1e-6, label) for label, v in steps.items()])


def complete(columns: list[str]) -> Column:
    """Whether a row answers all: one option of each single choice (at most one of optional ones), one or more of the
    multiple ones, and finite numbers."""
    count = lambda fs: sum((F.when(F.col(f"`{f}`") >= 0.5, 1).otherwise(0) if f in columns else F.lit(0) for f in fs), F.lit(0))
    ok = F.lit(True)
    for group, options in R.QUESTIONS.items():
        n = count(options.values())
        ok = ok & ((n <= 1) if group in R.OPTIONAL_QUESTIONS else (n == 1))
    for options in R.MULTI_QUESTIONS.values():
        ok = ok & (count(options.values()) >= 1)
    for f in [*(name for name, _ in R.ORDINAL_QUESTIONS.values()), *R.NUMERIC_FEATURES]:
        ok = ok & (F.coalesce(~F.isnan(F.col(f"`{f}`").cast("double")) & (F.abs(F.col(f"`{f}`")) != math.inf), F.lit(False)) if f in columns else F.lit(False))
    return ok


def missing_features(columns: list[str]) -> dict[str, list[str]]:
    """Groups that a model has in part, with what it lacks of them."""
    have, out = set(columns), {}
    groups = {g: (list(o.values()), R.OPTIONAL_FEATURES.get(g, [])) for g, o in {**R.QUESTIONS, **R.MULTI_QUESTIONS}.items()}
    groups["Ordinal fields"] = ([f for f, _ in R.ORDINAL_QUESTIONS.values()], [])
    groups["Numeric fields"] = (R.NUMERIC_FEATURES, [])
    for group, (own, optional) in groups.items():
        lacking = [f for f in own if f not in have and f not in optional]
        if lacking and have.intersection(own):
            out[group] = lacking
    return out


def assemble(statement: DataFrame, profile: DataFrame, key: str, columns: list[str], sources: dict[str, str] | None = None, binarise: bool = True) -> DataFrame:
    """key and the model's columns in order, by where each comes from; a missing value is an error.

    Shares become flags at 5 %, and obstacles to saving are 0 for those who save.
    """
    sources = sources or feature_sources(columns)
    have_s, have_p = set(statement.columns), set(profile.columns)
    s = statement.select(key, *[F.col(f"`{c}`").cast("double").alias(f"s:{c}") for c in statement.columns if c != key])
    p = profile.select(key, *[F.col(f"`{c}`").cast("double").alias(f"p:{c}") for c in profile.columns if c != key])
    saves = F.coalesce(F.col("`s:Save_Money_Yes`"), F.lit(0.0)) >= 0.5 if "Save_Money_Yes" in have_s else F.lit(False)
    out = []
    for c in columns:
        own = lambda have, side: F.col(f"`{side}:{c}`") if c in have else F.lit(None).cast("double")
        if sources[c] == "program_2":
            value = own(have_s, "s")
            if binarise and c.startswith("Expense_Distribution_"):
                value = (value >= R.DISTRIBUTION_LEAST).cast("double")
        elif sources[c] == "questionnaire":
            value = own(have_p, "p")
            if c.startswith("Savings_Obstacle_"):
                value = F.when(saves, 0.0).otherwise(F.coalesce(value, F.lit(0.0)))
        else:
            value = F.lit(0.0)
        out.append(checked(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != math.inf), value, f"Missing required value for feature '{c}'").alias(c))
    return s.join(p, key).select(key, *out)


@dataclass
class Model:
    """Weights in plain lists: linear ones, or two dense layers with a risk head and a saving head."""

    columns: list[str]
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    weights: list[float] | None = None
    intercept: float = 0.0
    layers: list[tuple[list[list[float]], list[float]]] | None = None
    risk_head: tuple[list[float], float] | None = None
    saving_head: tuple[list[float], float] | None = None
    activation: str = "relu"
    #: ``probability``: the output is the chance of saving; ``score``: it is the risk itself.
    output: str = "probability"
    #: Any function of a row's list of numbers, in place of weights: a pair (risk, saving), a mapping of both, or a risk.
    function: Callable | None = None
    thresholds: dict = field(default_factory=dict)
    rules: list[dict] = field(default_factory=list)

    def gate(self, width: int) -> None:
        """Named checks before any scoring; a failed one is an error."""
        healthy, risky = self.thresholds.get("healthy", R.HEALTHY_BELOW), self.thresholds.get("risky", R.RISKY_FROM)
        checks = {
            "feature_count_matches_model": width == len(self.columns),
            "weights_match_features": self.weights is None or len(self.weights) == len(self.columns),
            "band_thresholds_in_order": 0.0 <= healthy < risky <= 1.0,
        }
        failed = [name for name, ok in checks.items() if not ok]
        if failed:
            raise ValueError(f"quality gate failed: {', '.join(failed)}")


def scaler_of(columns: list[str], mean: list[float], scale: list[float], width: int | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """Means and scales by name, of a scaler that has them by place; only SCALED_FEATURES among the columns are scaled.

    The scaler may have been fitted on all columns, on all but the income, on all but age and income, on the scaled columns, or on
    these without the income; what it has not seen stays as it is. width: how many columns it says it was fitted on; if it
    does not say, as many as it has numbers for, which may be all columns or the scaled ones.
    """
    scaled = [c for c in columns if c in R.SCALED_FEATURES]
    if not scaled:
        return {}, {}
    without = lambda own, *gone: [c for c in own if c not in gone]
    cases = [list(columns)]
    if width is not None and "Income_Category" in scaled:
        cases.append(without(columns, "Income_Category"))
        if "Age" in columns:
            cases.append(without(columns, "Age", "Income_Category"))
    cases.append(scaled)
    if width is not None and "Income_Category" in scaled:
        cases.append(without(scaled, "Income_Category"))
    size = len(mean) if width is None else width
    own = next((c for c in cases if len(c) == size), None)
    if own is None or not len(mean) == len(scale) == size:
        raise ValueError(f"a scaler of {size} columns fits neither a row of {len(columns)} nor its {len(scaled)} scaled columns")
    return {c: m for c, m in zip(own, mean) if c in scaled}, {c: x for c, x in zip(own, scale) if c in scaled}


def strict_rows(rows: DataFrame, columns: list[str], *keys: str, projected: bool = False) -> DataFrame:
    """keys and the model's columns as finite numbers. A column too few is an error, one too many too unless ``projected``;
    a value that is null or not finite fails the row."""
    lacking = [c for c in columns if c not in rows.columns]
    if lacking:
        raise ValueError(f"Missing required feature: {', '.join(lacking)}")
    more = sorted(set(rows.columns) - {*columns, *keys})
    if more and not projected:
        raise ValueError(f"Unexpected extra features: {more}")
    value = lambda c: F.col(f"`{c}`").cast("double")
    finite = lambda c: value(c).isNotNull() & ~F.isnan(value(c)) & (F.abs(value(c)) != math.inf)
    return rows.select(*keys, *[checked(finite(c), value(c), f"Null or non-finite value for feature: {c}").alias(c) for c in columns])


def scale(model: Model) -> list[Column]:
    """The model's columns in order: the scaled ones centred and divided, the others as they are."""
    return [((F.col(f"`{c}`") - model.mean[c]) / model.scale[c] if c in R.SCALED_FEATURES and c in model.mean else F.col(f"`{c}`")).cast("double").alias(c) for c in model.columns]


def dot(values: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def linear_scores(values: Column, model: Model) -> tuple[Column, Column]:
    """Risk and saving probability of a linear model, which predicts the saving, or the risk as a score."""
    if model.output == "score":
        risk = dot(values, model.weights) + model.intercept
        return risk, F.bround(1 - sigmoid(risk), 6)
    saving = sigmoid(dot(values, model.weights) + model.intercept)
    return F.bround(1 - saving, 6), saving


#: Numbers of a net's weights that the driver takes (400 MB of doubles).
MOST_WEIGHTS = 50_000_000
TRUNK, RISK_HEAD, SAVING_HEAD = "shared_trunk", "risk_head", "savings_head"


def net_from_weights(weights: DataFrame, columns: list[str] | None = None, activation: str = "relu", **fields) -> Model:
    """The two-headed net of a table of named weights: name, shape (array of int) and values (array of double, row by row).

    ``shared_trunk.<k>.weight`` are the layers in order of k, whatever lies between them; a layer or head without a bias has
    none. Sizes follow from the shapes and must fit each other. Without ``columns`` the inputs are called x0, x1, ...; an unknown
    activation is relu.
    """
    size = weights.agg(F.sum(F.size("values"))).first()[0] or 0
    if size > MOST_WEIGHTS:
        raise ValueError(f"{size} weights are more than {MOST_WEIGHTS}")
    table = {r["name"]: r for r in weights.select("name", "shape", F.col("values").cast("array<double>").alias("values")).collect()}

    def matrix(name: str) -> list[list[float]]:
        shape, values = list(table[name]["shape"]), table[name]["values"]
        if len(shape) != 2 or shape[0] * shape[1] != len(values):
            raise ValueError(f"{name} has {len(values)} values and the shape {shape}")
        return [values[k * shape[1] : (k + 1) * shape[1]] for k in range(shape[0])]

    def bias(name: str, wide: int) -> list[float]:
        values = list(table[name]["values"]) if name in table else [0.0] * wide
        if len(values) != wide:
            raise ValueError(f"{name} has {len(values)} values, not {wide}")
        return values

    numbers = sorted(int(n.split(".")[1]) for n in table if n.startswith(f"{TRUNK}.") and n.endswith(".weight"))
    lacking = [n for n in (f"{RISK_HEAD}.weight", f"{SAVING_HEAD}.weight") if n not in table] + ([] if numbers else [f"{TRUNK}.0.weight"])
    if lacking:
        raise ValueError(f"no weights called {', '.join(lacking)}")
    layers = []
    for k in numbers:
        layer = matrix(f"{TRUNK}.{k}.weight")
        if layers and len(layer[0]) != len(layers[-1][0]):
            raise ValueError(f"{TRUNK}.{k}.weight takes {len(layer[0])} numbers, but the layer before gives {len(layers[-1][0])}")
        layers.append((layer, bias(f"{TRUNK}.{k}.bias", len(layer))))
    heads = []
    for name in (RISK_HEAD, SAVING_HEAD):
        head = matrix(f"{name}.weight")
        if len(head) != 1 or len(head[0]) != len(layers[-1][0]):
            raise ValueError(f"{name}.weight is {len(head)} by {len(head[0])}, not 1 by {len(layers[-1][0])}")
        heads.append((head[0], bias(f"{name}.bias", 1)[0]))
    inputs = len(layers[0][0][0])
    if columns is not None and len(columns) != inputs:
        raise ValueError(f"{len(columns)} columns for a net of {inputs} inputs")
    known = activation.strip().lower() if activation.strip().lower() in ("relu", "gelu", "tanh", "sigmoid") else "relu"
    return Model(columns or [f"x{k}" for k in range(inputs)], layers=layers, risk_head=heads[0], saving_head=heads[1], activation=known, **fields)


def dense_scores_udf(model: Model):
    """The two-headed net over arrays of doubles, a batch of rows at a time."""

    def scores(values: pd.Series) -> pd.DataFrame:
        import numpy as np

        x = np.array(values.tolist(), dtype=np.float64).reshape(len(values), -1)
        act = {"relu": lambda z: np.maximum(z, 0), "tanh": np.tanh, "sigmoid": lambda z: 1 / (1 + np.exp(-z)), "gelu": lambda z: 0.5 * z * (1 + np.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z**3)))}[model.activation]
        for w, b in model.layers or []:
            x = act(x @ np.array(w).T + np.array(b))
        heads = [1 / (1 + np.exp(-(x @ np.array(w) + b))) for w, b in (model.risk_head, model.saving_head)]
        return pd.DataFrame({"risk": heads[0], "saving": heads[1]})

    return F.pandas_udf(scores, "risk double, saving double")


def called_scores_udf(model: Model):
    """A model that is any function, over arrays of doubles."""

    def scores(values: pd.Series) -> pd.DataFrame:
        rows = []
        for x in values:
            out = model.function([float(v) for v in x])
            if isinstance(out, Mapping):
                out = (out["risk_score"], out["saving_probability"])
            elif not isinstance(out, (list, tuple)):
                out = (out, round(1 - 1 / (1 + math.exp(-float(out))), 6))
            rows.append((float(out[0]), float(out[1])))
        return pd.DataFrame(rows, columns=["risk", "saving"])

    return F.pandas_udf(scores, "risk double, saving double")


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def risk_level(score: Column, healthy: float = R.HEALTHY_BELOW, risky: float = R.RISKY_FROM) -> Column:
    return F.when(score < healthy, "healthy").when(score < risky, "moderate").otherwise("risky")


def factors(values: Column, names: Column, weights: list[float] | None = None, k: int = R.TOP_FACTORS) -> dict[str, Column]:
    """The strongest, the raising and the lowering contributions, ``k`` of each, as structs of feature and contribution."""
    size = F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: a * b) if weights else values
    all_ = F.transform(F.arrays_zip(names.alias("f"), size.alias("v")), lambda x, i: F.struct(x["v"].alias("v"), i.alias("i"), x["f"].alias("f")))

    def first(keep, key) -> Column:
        ordered = F.array_sort(F.transform(F.filter(all_, keep), lambda x: F.struct(key(x).alias("key"), x["i"].alias("i"), x["f"].alias("f"), x["v"].alias("v"))))
        return F.transform(F.slice(ordered, 1, k), lambda x: F.struct(x["f"].alias("feature"), F.bround(x["v"], 6).alias("contribution")))

    return {"top_factors": first(lambda x: F.lit(True), lambda x: -F.abs(x["v"])), "risk_factors": first(lambda x: x["v"] > 0, lambda x: -x["v"]), "healthy_factors": first(lambda x: x["v"] < 0, lambda x: x["v"])}


OPERATORS = {">=": "__ge__", ">": "__gt__", "<=": "__le__", "<": "__lt__", "==": "__eq__"}


def alerts(risk: Column, saving: Column, rules: list[dict] | None = None, high: float = R.HIGH_RISK, least: float = R.SAVING_LEAST) -> Column:
    """The distinct messages whose rule holds, in order."""
    found = [F.when(risk >= high, "high_risk_score"), F.when(saving < least, "low_saving_probability")]
    for rule in rules or []:
        metric, sign = rule.get("metric"), OPERATORS.get(str(rule.get("operator")))
        if metric in ("risk_score", "saving_probability") and sign and rule.get("value") is not None:
            value = risk if metric == "risk_score" else saving
            found.append(F.when(getattr(value, sign)(float(rule["value"])), str(rule.get("message") or f"rule:{metric}")))
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def predict(rows: DataFrame, model: Model, *keys: str) -> DataFrame:
    """keys, scores, level, factors and alerts of model rows."""
    model.gate(len(rows.columns) - len(keys))
    scaled = strict_rows(rows, model.columns, *keys).select(*keys, F.array(*scale(model)).alias("x"))
    if model.function is not None:
        scaled = scaled.withColumn("s", called_scores_udf(model)("x")).withColumns({"risk_score": clamp(F.col("s.risk")), "saving_probability": clamp(F.col("s.saving"))})
    elif model.weights is not None:
        risk, saving = linear_scores(F.col("x"), model)
        scaled = scaled.withColumns({"risk_score": clamp(risk), "saving_probability": clamp(saving)})
    else:
        scaled = scaled.withColumn("s", dense_scores_udf(model)("x")).withColumns({"risk_score": clamp(F.col("s.risk")), "saving_probability": clamp(F.col("s.saving"))})
    risk, saving = F.col("risk_score"), F.col("saving_probability")
    t = model.thresholds
    made = factors(F.col("x"), F.array(*map(F.lit, model.columns)), model.weights, int(t.get("top_k_factors", R.TOP_FACTORS)))
    level = risk_level(risk, t.get("healthy", R.HEALTHY_BELOW), t.get("risky", R.RISKY_FROM))
    return scaled.select(*keys, "risk_score", "saving_probability", level.alias("risk_level"), *[c.alias(n) for n, c in made.items()], alerts(risk, saving, model.rules, t.get("high_risk", R.HIGH_RISK), t.get("saving", R.SAVING_LEAST)).alias("alerts"))


def average_predictions(predictions: DataFrame, *keys: str, factor: str = "top_factors", k: int = R.TOP_FACTORS) -> DataFrame:
    """keys, mean scores, and the mean contribution of each feature, the ``k`` strongest first."""
    scores = predictions.groupBy(*keys).agg(F.bround(F.avg("risk_score"), 6).alias("risk_score"), F.bround(F.avg("saving_probability"), 6).alias("saving_probability"), F.count(F.lit(1)).alias("months"))
    each = predictions.select(*keys, F.explode(factor).alias("x")).groupBy(*keys, F.col("x.feature").alias("feature")).agg(F.bround(F.avg("x.contribution"), 6).alias("contribution"))
    listed = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.abs("contribution")).alias("key"), "feature", "contribution"))).alias("f"))
    best = F.transform(F.slice("f", 1, k), lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution")))
    return scores.join(listed, list(keys), "left").select(*keys, "risk_score", "saving_probability", "months", best.alias("factors"))


def fill_back(final: DataFrame, inferred: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """The final dataset with its scores of the month, else of the fallback row, and the band that follows."""
    scores = inferred.select("statement_month", F.col("risk_score").alias("__r"))
    out = final.join(scores, "statement_month", "left")
    if fallback is not None:
        # Of several fallback rows the one whose key columns come last counts.
        order = F.struct(*[c for c in fallback.columns if c != "risk_score"], "risk_score")
        only = fallback.agg(F.max_by("risk_score", order).alias("__f"))
        out = out.join(F.broadcast(only), F.lit(True), "left").withColumn("__r", F.coalesce("__r", "__f")).drop("__f")
    score = F.coalesce("__r", "Risk_Score")
    return out.withColumns({"Risk_Score": score, "Behavior_Risk_Level": F.coalesce(behaviour_band(score), "Behavior_Risk_Level")}).drop("__r").select(final.columns)
