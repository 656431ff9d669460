"""Baseline forecasts with rolling-origin backtests, for every series of a table in one job.

Input points are ``series_id, ts TIMESTAMP, value DOUBLE``. The four methods look only at the first
value, the number of points and a bounded tail of each series, so a series of any length crosses the
shuffle as per-task top rows and partial aggregates and never as one whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalar import portable

METHODS = ("naive", "drift", "moving-average", "seasonal-naive")
COMPLETED, INSUFFICIENT, REJECTED = "completed", "insufficient-evidence", "rejected"
NO_METHOD = "No configured method has enough regular history and rolling-origin folds."
TOO_SHORT = "At least two regularly spaced observations are required to infer a horizon."


@dataclass(frozen=True)
class ForecastConfig:
    horizon: int = 7
    folds: int = 8
    min_folds: int = 3
    min_train: int = 14
    window: int = 7
    season: int = 7
    level: float = 0.90
    nonnegative: bool = True
    methods: Sequence[str] = METHODS

    def __post_init__(self):
        if not 1 <= self.horizon <= 366:
            raise ValueError("horizon must lie in 1..366")
        if not 1 <= self.min_folds <= self.folds <= 100:
            raise ValueError("folds must satisfy 1 <= min_folds <= folds <= 100")
        if self.min_train < 2 or not (2 <= self.window <= 366 and 2 <= self.season <= 366):
            raise ValueError("min_train, window and season are out of range")
        if not 0.5 < self.level < 1:
            raise ValueError("level must lie between 0.5 and 1")
        if not self.methods or len(set(self.methods)) != len(self.methods) or set(self.methods) - set(METHODS):
            raise ValueError("methods must be unique and known")

    @property
    def tail(self) -> int:
        """Points from the end of a series that any origin or method can reach."""
        return self.horizon + self.folds + max(self.window, self.season, 2)

    def required(self, method: str) -> int:
        """History a method needs before its first backtest origin."""
        need = {"naive": 1, "drift": 2, "moving-average": self.window, "seasonal-naive": self.season}
        return max(self.min_train, need[method])


def series_shape(points: DataFrame) -> DataFrame:
    """Count, bounds, first value and regularity of each series.

    A series is regular when its distinct timestamps number as many as its rows and every one sits on
    a multiple of ``(last - first) / (n - 1)``; that test needs no per-series sort.
    """
    micros = F.unix_micros("ts")
    stamped = points.groupBy("series_id", micros.alias("_us")).agg(
        F.count("*").alias("_copies"), F.min("value").alias("_value")
    )
    bounds = stamped.groupBy("series_id").agg(
        F.sum("_copies").alias("n"),
        F.count("*").alias("distinct_stamps"),
        F.min("_us").alias("first_us"),
        F.max("_us").alias("last_us"),
        F.min_by("_value", "_us").alias("first_value"),
    )
    gap = F.when(F.col("n") > 1, (F.col("last_us") - F.col("first_us")) / (F.col("n") - 1))
    bounds = bounds.withColumn("interval_us", gap)
    offgrid = (
        stamped.select("series_id", "_us")
        .join(bounds.select("series_id", "first_us", "interval_us"), "series_id")
        .filter(
            (F.col("interval_us") > 0)
            & (F.pmod(F.col("_us") - F.col("first_us"), F.col("interval_us")) != 0)
        )
        .groupBy("series_id")
        .agg(F.count("*").alias("offgrid"))
    )
    shaped = bounds.join(offgrid, "series_id", "left").withColumn(
        "offgrid", F.coalesce(F.col("offgrid"), F.lit(0)).cast("long")
    )
    problem = F.when(
        F.col("distinct_stamps") < F.col("n"), "forecast timestamps must be unique"
    ).when(F.col("offgrid") > 0, "forecast observations must use a positive regular interval")
    return shaped.withColumn("rejection", problem).withColumn(
        "interval_seconds", F.col("interval_us") / 1e6
    )


def _tails(points: DataFrame, config: ForecastConfig) -> DataFrame:
    """The last points of each series as one sorted array of bounded length."""
    newest = W.partitionBy("series_id").orderBy(F.desc("ts"))
    return (
        points.select("series_id", "ts", F.col("value").cast("double").alias("value"))
        .withColumn("_r", F.row_number().over(newest))
        .filter(F.col("_r") <= config.tail)
        .groupBy("series_id")
        .agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("_p"))
        .select("series_id", F.transform("_p", lambda p: p["value"]).alias("tail"))
    )


def _release(value: Column, config: ForecastConfig) -> Column:
    """Clamp and round one prediction, as every step of a recursion does."""
    if config.nonnegative:
        value = F.greatest(F.lit(0.0), value)
    return portable(value)


def _predict(method: str, origin: Column, config: ForecastConfig) -> Column:
    """Predictions for steps 1..horizon from a history of ``origin`` points, as an array."""
    tail, offset = F.col("tail"), F.col("n") - F.size("tail")

    def at(position: Column) -> Column:  # zero-based position in the whole series
        return F.get(tail, (position - offset).cast("int"))

    steps = F.sequence(F.lit(1), F.lit(config.horizon))
    last = at(origin - 1)
    if method == "naive":
        return F.transform(steps, lambda k: _release(last, config))
    if method == "drift":
        slope = (last - F.col("first_value")) / F.nullif(origin - 1, F.lit(0))
        return F.transform(steps, lambda k: _release(last + k * slope, config))
    if method == "seasonal-naive":
        return F.transform(
            steps,
            lambda k: _release(at(origin - config.season + F.pmod(k - 1, F.lit(config.season))), config),
        )
    width = config.window
    seen = F.slice(tail, (origin - offset - width + 1).cast("int"), width)
    start = F.struct(seen.alias("w"), F.array().cast("array<double>").alias("p"))

    def step(state: Column, _k: Column) -> Column:
        total = F.aggregate(state["w"], F.lit(0.0), lambda s, x: s + x)
        new = F.array(_release(total / width, config))
        return F.struct(
            F.concat(F.slice(state["w"], 2, width - 1), new).alias("w"),
            F.concat(state["p"], new).alias("p"),
        )

    return F.aggregate(steps, start, step, lambda state: state["p"])


def _fold_of(method: str, config: ForecastConfig):
    """Fold builder for one origin: predictions next to the values they aim at."""

    def fold(origin: Column) -> Column:
        start = (origin - (F.col("n") - F.size("tail")) + 1).cast("int")
        return F.struct(
            origin.alias("origin"),
            _predict(method, origin, config).alias("predicted"),
            F.slice("tail", start, config.horizon).alias("actual"),
        )

    return fold


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def candidates(points: DataFrame, config: ForecastConfig = ForecastConfig()) -> DataFrame:
    """One row per series and method: eligibility, folds, pooled error metrics, conformal radius.

    Rejected series yield no candidates. All work after the per-series tail is a projection: the
    folds of a method live in one bounded array (folds x horizon values).
    """
    rows = _candidates(_prepared(points, config), config)
    return rows.filter(F.col("rejection").isNull()).drop(*CARRIED)


def _prepared(points: DataFrame, config: ForecastConfig) -> DataFrame:
    return series_shape(points).join(_tails(points, config), "series_id")


# Series columns that travel with the candidates, so that a run needs no second look at the points.
CARRIED = ("n", "tail", "first_value", "last_us", "interval_us", "interval_seconds", "rejection")


def _candidates(series: DataFrame, config: ForecastConfig) -> DataFrame:
    sound = F.col("rejection").isNull()
    entries = []
    for method in config.methods:
        required = config.required(method)
        last_origin = F.col("n") - config.horizon
        first = F.greatest(F.lit(required), last_origin - config.folds + 1)
        count = F.greatest(F.lit(0), last_origin - first + 1)
        need = required + config.horizon + config.min_folds - 1
        folds = F.transform(
            F.sequence(first.cast("long"), last_origin.cast("long")), _fold_of(method, config)
        )
        eligible = sound & (count >= config.min_folds)
        entries.append(
            F.struct(
                F.lit(method).alias("method"),
                eligible.alias("eligible"),
                F.when(
                    ~eligible,
                    F.lit(
                        f"requires at least {need} regular observations for the configured "
                        "rolling-origin evidence"
                    ),
                ).alias("exclusion_reason"),
                F.when(eligible, folds).alias("folds"),
            )
        )
    rows = series.select(
        "series_id", *CARRIED, F.explode(F.array(*entries)).alias("c")
    ).select("series_id", *CARRIED, "c.*")
    pairs = F.flatten(
        F.transform("folds", lambda f: F.arrays_zip(f["predicted"].alias("p"), f["actual"].alias("a")))
    )
    rows = rows.withColumn("_pairs", pairs).withColumn(
        "_errors", F.transform("_pairs", lambda x: x["p"] - x["a"])
    ).withColumn("_absolute", F.transform("_errors", lambda e: F.abs(e)))
    size = F.size("_absolute")
    rank = F.least(size, F.ceil((size + 1) * F.lit(config.level)).cast("int"))
    rows = rows.withColumn(
        "radius", portable(F.try_element_at(F.sort_array("_absolute"), rank))
    )
    scale = F.aggregate("_pairs", F.lit(0.0), lambda s, x: s + F.abs(x["a"]))
    covered = F.size(F.filter("_absolute", lambda e: e <= F.col("radius")))
    on = F.col("eligible")
    return rows.select(
        "series_id", "method", "eligible", "exclusion_reason", "folds",
        F.when(on, size).alias("observations"),
        F.when(on, portable(_mean(F.col("_absolute")))).alias("mae"),
        F.when(on, portable(F.sqrt(_mean(F.transform("_errors", lambda e: e * e))))).alias("rmse"),
        F.when(
            on,
            portable(
                F.aggregate("_absolute", F.lit(0.0), lambda s, x: s + x) / F.nullif(scale, F.lit(0.0))
            ),
        ).alias("wape"),
        F.when(on, portable(_mean(F.col("_errors")))).alias("bias"),
        F.when(on, portable(covered / size)).alias("coverage"),
        F.when(on, portable(2 * F.col("radius"))).alias("interval_width"),
        "radius", *CARRIED,
    )


def _best(eligible: Column) -> Column:
    """Best eligible method: WAPE (absent ranks last), then MAE, then name."""
    order = F.struct(F.coalesce("wape", F.lit(float("inf"))), F.col("mae"), F.col("method"))
    return F.min_by(
        F.when(eligible, F.struct("method", "radius", "observations")), F.when(eligible, order)
    )


def winners(candidate_rows: DataFrame) -> DataFrame:
    """Selected method of each series that has an eligible candidate."""
    return (
        candidate_rows.filter("eligible")
        .groupBy("series_id")
        .agg(_best(F.col("eligible")).alias("_w"))
        .select(
            "series_id",
            F.col("_w.method").alias("selected_method"),
            F.col("_w.radius").alias("radius"),
            F.col("_w.observations").alias("calibration_errors"),
        )
    )


def forecast(points: DataFrame, config: ForecastConfig = ForecastConfig()) -> DataFrame:
    """One run per series: status, reason, selected method and the forecast values.

    ``forecast`` is an array of ``step, ts, point, lower, upper``, empty for negative releases.
    """
    runs = (
        _candidates(_prepared(points, config), config)
        .groupBy("series_id")
        .agg(
            _best(F.col("eligible")).alias("_w"),
            *[F.first(name).alias(name) for name in CARRIED],
        )
        .withColumn("selected_method", F.col("_w.method"))
        .withColumn("radius", F.col("_w.radius"))
    )
    chosen = F.col("selected_method")
    status = (
        F.when(F.col("rejection").isNotNull(), REJECTED)
        .when(chosen.isNull() | F.col("interval_us").isNull(), INSUFFICIENT)
        .otherwise(COMPLETED)
    )
    reason = F.coalesce(
        F.col("rejection"),
        F.when(F.col("interval_us").isNull(), TOO_SHORT),
        F.when(chosen.isNull(), NO_METHOD),
    )
    point = F.coalesce(
        *[F.when(chosen == m, _predict(m, F.col("n"), config)) for m in config.methods]
    )
    radius = F.col("radius")

    def value(p: Column, i: Column) -> Column:
        low = p - radius
        if config.nonnegative:
            low = F.greatest(F.lit(0.0), low)
        return F.struct(
            (i + 1).alias("step"),
            F.timestamp_micros(
                (F.col("last_us") + (i + 1) * F.col("interval_us")).cast("long")
            ).alias("ts"),
            p.alias("point"),
            portable(low).alias("lower"),
            portable(p + radius).alias("upper"),
        )

    return (
        runs.withColumn("_point", point)
        .withColumn("status", status)
        .select(
            "series_id", "status", reason.alias("failure_reason"), "selected_method",
            F.col("n").alias("observation_count"), "interval_seconds", "radius",
            F.timestamp_micros("last_us").alias("data_cutoff"),
            F.when(F.col("status") == COMPLETED, F.transform("_point", value)).alias("forecast"),
        )
    )


def forecast_values(runs: DataFrame) -> DataFrame:
    """Long form of the completed forecasts."""
    return runs.select("series_id", "selected_method", F.explode("forecast").alias("f")).select(
        "series_id", "selected_method", "f.*"
    )


def replay(points: DataFrame, config: ForecastConfig = ForecastConfig()) -> DataFrame:
    """Withhold the last ``horizon`` points, forecast from the rest and score the held-out part.

    Windows are strictly forward: everything before the cut trains, everything after it tests.
    """
    held_cut = W.partitionBy("series_id").orderBy(F.desc("ts"))
    held = (
        points.withColumn("_r", F.row_number().over(held_cut)).filter(F.col("_r") <= config.horizon)
    )
    cut = held.groupBy("series_id").agg(F.min("ts").alias("_cut"), F.count("*").alias("held_out"))
    training = points.join(cut, "series_id").filter(F.col("ts") < F.col("_cut")).drop("_cut", "held_out")
    runs = forecast(training, config)
    predicted = forecast_values(runs)
    aligned = predicted.join(
        held.select("series_id", "ts", F.col("value").cast("double").alias("actual")), ["series_id", "ts"]
    )
    error = F.col("point") - F.col("actual")
    scores = aligned.groupBy("series_id").agg(
        F.count("*").alias("aligned"),
        portable(F.avg(F.abs(error))).alias("mae"),
        portable(F.sqrt(F.avg(error * error))).alias("rmse"),
        portable(F.sum(F.abs(error)) / F.nullif(F.sum(F.abs("actual")), F.lit(0.0))).alias("wape"),
        portable(
            F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double"))
        ).alias("interval_coverage"),
    )
    return (
        cut.select("series_id", "held_out")
        .join(
            runs.select(
                "series_id", "status", "failure_reason", "selected_method",
                F.col("observation_count").alias("training_values"),
            ),
            "series_id", "left",
        )
        .join(scores, "series_id", "left")
        .withColumn("status", F.coalesce("status", F.lit(INSUFFICIENT)))
        .withColumn("failure_reason", F.when(
            F.col("status") != COMPLETED, F.coalesce("failure_reason", F.lit(TOO_SHORT))
        ))
    )
