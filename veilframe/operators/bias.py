"""The bias recommender, its metrics, and comparisons of releases by it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.features import clipped, least_rows
from veilframe.functions.hashing import below, draw
from veilframe.operators.releases import ROW, Release, release_values, row_key
from veilframe.session import buckets, checkpointed, checkpointed_by, discarded, shuffles_deleted


@dataclass(frozen=True)
class BiasModel:
    mean: float
    users: DataFrame  # customer_id, bu
    items: DataFrame  # movie_id, bi
    known: DataFrame | None = None  # customer_id, movie_id, s, n: sums and numbers of the ratings, by user, if they are kept


#: Biases of up to this many cells (values times models) are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 4_000_000


def fit_bias(df: DataFrame, rating_col: str = "rating", epochs: int = 8, reg: float = 10.0, keep: bool = False) -> BiasModel:
    """Alternating regularised means. Ratings are added up by (user, item) and written by user and by item, so that a half epoch shuffles
    none of them where the other side's biases can be broadcast, and one row for each sum where they can't. A single epoch reads them by
    item once, so they aren't written for that. Biases that are few are marked for broadcast."""
    rows = df.select("customer_id", "movie_id", F.col(rating_col).cast("double").alias("r")).where(F.col("r").isNotNull())
    placed = rows.repartition(buckets(df.sparkSession), "customer_id")
    known = checkpointed_by(placed.groupBy("customer_id", "movie_id").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n")), "customer_id", placed=True)
    mean = known.agg(F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).first()[0]
    if mean is None:
        discarded(known)
        raise ValueError("there are no ratings to fit")
    by = {"customer_id": known, "movie_id": checkpointed_by(known, "movie_id") if epochs > 1 else known}

    def step(key: str, other: str, held: DataFrame | None, few: bool) -> DataFrame:
        met = by[key] if held is None else _met(by, key, other, held, few)
        left = F.col("s") - F.col("n") * (F.lit(mean) + (F.lit(0.0) if held is None else F.col("b")))
        return met.groupBy(key).agg((F.sum(left) / (F.sum("n") + reg)).alias("b"))

    few: dict = {}
    held = _alternated(step, epochs, 1, few)
    if not epochs:
        held = {k: known.select(k).distinct().withColumn("b", F.lit(0.0)) for k in by}
    else:
        discarded(*[x for x in by.values() if x is not known], *[] if keep else [known])
    named = [held[k].withColumnRenamed("b", n) for k, n in (("customer_id", "bu"), ("movie_id", "bi"))]
    return BiasModel(mean, *[F.broadcast(x) if few.get(k) else x for k, x in zip(by, named, strict=True)], known if keep else None)


class SharedFits:
    """fit_bias for several models of one baseline: each table is fitted once, and the sums of its ratings are kept until discard()."""

    def __init__(self):
        self.made: dict = {}

    def __call__(self, df: DataFrame, rating_col: str = "rating", epochs: int = 8, reg: float = 10.0) -> BiasModel:
        key = (id(df), rating_col, epochs, reg)
        if key not in self.made:
            self.made[key] = df, fit_bias(df, rating_col, epochs, reg, keep=True)  # with df, whose id stays its own then
        return self.made[key][1]

    def discard(self) -> None:
        discarded(*[model.known for _, model in self.made.values()])
        self.made.clear()


def _met(by: dict, key: str, other: str, held: DataFrame, few: bool) -> DataFrame:
    """The rows with the biases of `other`: held by `key` where these are few, else as they lie by `other`. A null meets nothing."""
    return by[key].join(F.broadcast(held), other) if few else by[other].join(held, other)


def _alternated(step, epochs: int, models: int, few: dict | None = None) -> dict:
    """Biases by user and by item after so many epochs of step(key, other, biases of other or None, are they few); each is written
    once, and the one before goes. few: a dictionary that is told which of the two are few."""
    held: dict = {}
    few = {} if few is None else few
    for _ in range(epochs):
        for key, other in (("customer_id", "movie_id"), ("movie_id", "customer_id")):
            new = checkpointed(step(key, other, held.get(other), few.get(other, False)))
            if key in held:
                discarded(held[key])
            else:
                few[key] = new.count() * models <= BROADCAST_CELLS
            held[key] = new
    return held


def predict_bias(model: BiasModel, pairs: DataFrame, name: str = "prediction") -> DataFrame:
    """pairs with the prediction; unknown users and items have no bias."""
    both = pairs.join(model.users, "customer_id", "left").join(model.items, "movie_id", "left")
    value = F.lit(model.mean) + F.coalesce("bu", F.lit(0.0)) + F.coalesce("bi", F.lit(0.0))
    return both.withColumn(name, clipped(value)).drop("bu", "bi")


def metrics(actual: Column, predicted: Column) -> list[Column]:
    err = predicted - actual
    return [
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.avg(F.when(F.abs(err) <= 1, 1.0).otherwise(0.0)) * 100).alias("within_one_star"),
    ]


ERRORS = ("rmse", "mae", "within_one_star")


def evaluate(predictions: DataFrame, label: str = "rating", name: str = "prediction") -> DataFrame:
    return predictions.agg(F.count(F.lit(1)).alias("test_rows"), *metrics(F.col(label).cast("double"), F.col(name)))


def split(df: DataFrame, test_share: float = 0.2, seed: int = 333, check: bool = True, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, test): each row goes to test with the given probability. once: df is read and drawn once, and written."""
    if not 0 < test_share < 1:
        raise ValueError("test_share must be between 0 and 1")
    test, names = below(seed, "holdout", test_share, row_key(df)), df.columns
    if once:
        df, test = checkpointed(df.withColumn("_test", test)), F.col("_test")
    parts = df.where(~test).select(*names), df.where(test).select(*names)
    if check:
        not_empty(*parts)
    return parts


def not_empty(*parts: DataFrame) -> None:
    if any(p.isEmpty() for p in parts):
        raise ValueError("one side of the split is empty")


def sampled(df: DataFrame, rows: int, seed: int = 333) -> DataFrame:
    """Exactly `rows` rows (or all), by least hash."""
    return df.where(least_rows(df, rows, draw(seed, "sample", row_key(df)), row_key(df))).limit(rows)


def exact_split(df: DataFrame, train_share: float = 0.8, seed: int = 333) -> tuple[DataFrame, DataFrame]:
    """(sample of exactly round(share * rows) rows, the others)."""
    n = round(df.count() * train_share)
    key = row_key(df)
    inside = least_rows(df, n, draw(seed, "exact", key), key) if n else F.lit(False)
    return df.where(inside), df.where(~inside)


def holdout_users(df: DataFrame, share: float = 0.25, seed: int = 333) -> DataFrame:
    """At least one user, a share of all, by least hash."""
    users = df.select("customer_id").distinct()
    n = max(1, int(users.count() * share))
    return users.where(least_rows(users, n, draw(seed, "holdout-user", "customer_id"), F.col("customer_id")))


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.7, seed: int = 333) -> tuple[DataFrame, DataFrame]:
    rank = F.row_number().over(Window.partitionBy(label).orderBy(draw(seed, "strata", key), key))
    size = F.count(F.lit(1)).over(Window.partitionBy(label))
    held = df.withColumn("_in", rank <= F.round(size * share))
    return held.where("_in").drop("_in"), held.where("NOT _in").drop("_in")


def official_holdout(
    ratings: DataFrame, pairs: DataFrame, max_train: int | None = None, max_test: int | None = None, order: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, test): the listed pairs are the test; all of them leave the training side, even those beyond max_test."""
    keys = ["movie_id", "customer_id"]
    by = order or keys
    train, test = ratings.join(pairs.select(*keys), keys, "left_anti"), ratings.join(pairs.select(*keys), keys, "left_semi")
    return (first_rows(train, max_train, by) if max_train else train), (first_rows(test, max_test, by) if max_test else test)


def first_rows(df: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The first n rows in an order: sorted partitions are written, whole ones taken as far as they go, and one of them cut."""
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    parts = df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    held = checkpointed(parts)
    whole, left, cut = [], n, None
    for r in held.groupBy("_part").count().orderBy("_part").collect():  # a row for each partition
        if r["count"] > left:
            cut = r["_part"]
            break
        whole.append(r["_part"])
        left -= r["count"]
    out = held.where(F.col("_part") < (len(whole) and whole[-1] + 1))
    if cut is not None and left:
        out = out.union(held.where(F.col("_part") == cut).withColumn("_rank", rank).where(F.col("_rank") <= left).drop("_rank"))
    return out.drop("_part")


def compare_releases(train: DataFrame, test: DataFrame, releases: list[Release] | None = None, epochs: int = 8, reg: float = 10.0, **options) -> DataFrame:
    """Errors of models fitted on each release, against the true test ratings. Releases with the same training table and label
    share one fit. The fixed releases (releases is None) are the columns of one table and are fitted together."""
    spark, rows, fits, sizes = train.sparkSession, [], {}, {}
    if releases is None:
        named, table = release_values(train, **options)
        sizes, fits = _fit_together(table, test, sorted({n for *_, n in named}), sorted({v for _, _, v, _ in named if v}), epochs, reg)
    else:
        named = [(r.name, r.rating_col, (id(r.data), r.rating_col), r.data) for r in releases]
    for name, rating_col, key, data in named:
        n = sizes[data] if releases is None else data.count()
        row = [name, rating_col, n, None, None, None, None]
        if rating_col is None:
            rows.append((*row, "skipped_no_rating_labels"))
            continue
        if n == 0:
            rows.append((*row, "skipped_empty_training_set"))
            continue
        if key not in fits:
            model = fit_bias(data, rating_col, epochs, reg)
            fits[key] = (model.mean, *evaluate(predict_bias(model, test)).first()[:3])
        if fits[key][0] is None:
            raise ValueError("there are no ratings to fit")
        mean, tested, rmse, mae = fits[key]
        rows.append((name, rating_col, n, tested, mean, rmse, mae, "ok"))
    frame = spark.createDataFrame(
        rows, "release_name string, rating_col string, train_rows long, test_rows long, global_mean double, rmse double, mae double, status string"
    )
    return frame.orderBy("status", F.col("rmse").asc_nulls_last(), "release_name")


def _fit_together(table: DataFrame, test: DataFrame, flags: list[str], values: list[str], epochs: int, reg: float) -> tuple[dict, dict]:
    """(rows of each flag; mean, test rows, RMSE and MAE of a model of each value): fit_bias and evaluate for all at once, as columns of the
    sums of one table. A user or movie that a value lacks has the bias 0, as in predict_bias."""
    sums = [x for v in values for x in (F.coalesce(F.sum(v), F.lit(0.0)).alias(f"s_{v}"), F.count(v).alias(f"n_{v}"))]
    known = checkpointed_by(table.groupBy("customer_id", "movie_id").agg(*sums, *[F.count_if(f).alias(f) for f in flags]), "customer_id")
    by = {"customer_id": known, "movie_id": checkpointed_by(known, "movie_id")}
    means = [(F.sum(f"s_{v}") / F.nullif(F.sum(f"n_{v}"), F.lit(0))).alias(v) for v in values]
    whole = known.agg(*means, *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in flags]).first()

    def step(key: str, other: str, held: DataFrame | None, few: bool) -> DataFrame:
        met = by[key] if held is None else _met(by, key, other, held, few)
        less = lambda v: F.lit(whole[v] or 0.0) + (F.lit(0.0) if held is None else F.col(f"b_{v}"))
        return met.groupBy(key).agg(*[(F.sum(F.col(f"s_{v}") - F.col(f"n_{v}") * less(v)) / (F.sum(f"n_{v}") + reg)).alias(f"b_{v}") for v in values])

    held = _alternated(step, epochs, len(values))
    asked = test.select("customer_id", "movie_id", F.col("rating").cast("double").alias("r"))
    for key, name in (("customer_id", "u"), ("movie_id", "i")):
        if epochs:
            asked = asked.join(held[key].toDF(key, *[f"{name}_{v}" for v in values]), key, "left")
    own = lambda v: sum((F.coalesce(f"{n}_{v}", F.lit(0.0)) for n in "ui"), F.lit(whole[v] or 0.0)) if epochs else F.lit(whole[v] or 0.0)
    found = asked.select("r", *[clipped(own(v)).alias(v) for v in values])
    row = found.agg(F.count(F.lit(1)).alias("rows"), *[x.alias(f"{n}_{v}") for v in values for n, x in zip(ERRORS, metrics(F.col("r"), F.col(v)), strict=True)]).first()
    discarded(*by.values(), *held.values())
    return {f: whole[f] for f in flags}, {v: (whole[v], row["rows"], row[f"rmse_{v}"], row[f"mae_{v}"]) for v in values}


def global_mean_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    mean = train.agg(F.avg("rating").alias("_mean"))
    return evaluate(test.join(F.broadcast(mean)).withColumn("prediction", clipped(F.col("_mean"))))


def utility_sweep(train: DataFrame, test: DataFrame, grid: list[tuple[str, float, DataFrame]], fit_predict, model: str = "bias") -> DataFrame:
    """(model, scenario, p, rmse, mae, within_one_star, retained shares) of a model retrained on every noisy release. p = 0 reuses
    the clean run. Retained by RMSE: the share of the clean model's lead over the global mean that is left."""
    base = global_mean_baseline(train, test).first()

    def errors(release: DataFrame):
        predictions = fit_predict(release, test)
        with shuffles_deleted(train.sparkSession):
            return evaluate(predictions).first()

    clean = errors(train)
    return _swept(train, model, base, clean, [(s, p, clean if p == 0 else errors(noisy)) for s, p, noisy in grid])


def _swept(train: DataFrame, model: str, base, clean, found: list) -> DataFrame:
    lead = base["rmse"] - clean["rmse"]
    out = [
        (
            model,
            scenario,
            float(p),
            got["rmse"],
            got["mae"],
            got["within_one_star"],
            100 * (base["rmse"] - got["rmse"]) / lead if lead > 0 else None,
            100 * got["within_one_star"] / clean["within_one_star"] if clean["within_one_star"] else None,
            100 * (got["rmse"] / clean["rmse"] - 1) if clean["rmse"] else None,
        )
        for scenario, p, got in found
    ]
    return train.sparkSession.createDataFrame(
        out,
        "model string, scenario string, p double, rmse double, mae double, within_one_star double, retained_rmse_pct double, "
        "retained_within_one_pct double, rmse_increase_pct double",
    )


def bias_sweep(train: DataFrame, test: DataFrame, grid: list, epochs: int = 6, reg: float = 10.0, cases: DataFrame | None = None) -> DataFrame:
    """utility_sweep of the bias model, all points fitted together. grid: (scenario, p, release), or (scenario, p, number of a variant) with
    `cases`: the rows of all variants as customer_id, movie_id, rating and _in, whose bit k tells that variant k has the row; 0 is the clean
    one. A row that many variants share is one, and the biases of all variants are the columns of one row. Variants are fitted by
    VARIANTS at a time."""
    if cases is None:
        noisy = [k for k, (_, p, _) in enumerate(grid) if p > 0]
        if len(noisy) > MOST - 1:
            raise ValueError(f"a sweep has {MOST} variants at most")
        tables = [train, *[grid[k][2] for k in noisy]]
        number = {k: v for v, k in enumerate(noisy, 1)}
        points = [(s, p, number.get(k, 0)) for k, (s, p, _) in enumerate(grid)]
        parts = [df.select("customer_id", "movie_id", "rating", F.lit(1 << v).cast("long").alias("_in")) for v, df in enumerate(tables)]
        cases = reduce(DataFrame.union, parts)
    else:
        points = list(grid)
    rows = cases.select("customer_id", "movie_id", F.col("rating").cast("double").alias("r"), "_in").where(F.col("r").isNotNull())
    known = checkpointed_by(rows, "customer_id")
    by = {"customer_id": known, "movie_id": checkpointed_by(known, "movie_id")}
    needed, got = sorted({0, *[v for *_, v in points]}), {}
    for at in range(0, len(needed), VARIANTS):
        got |= _swept_variants(by, test, needed[at : at + VARIANTS], epochs, reg)
    discarded(*by.values())
    return _swept(train, "bias", global_mean_baseline(train, test).first(), got[0], [(s, p, got[v]) for s, p, v in points])


#: Variants of a sweep: as many as a whole number has bits; and those that are fitted in one go.
MOST, VARIANTS = 62, 24


def _swept_variants(by: dict, test: DataFrame, variants: list[int], epochs: int, reg: float) -> dict:
    """variant -> its errors on test."""
    inside = {v: F.col("_in").bitwiseAND(F.lit(1 << v).cast("long")) != 0 for v in variants}
    means = by["customer_id"].agg(*[F.avg(F.when(inside[v], F.col("r"))).alias(f"m{v}") for v in variants]).first()
    if any(x is None for x in means):
        raise ValueError("there are no ratings to fit")

    def step(key: str, other: str, held: DataFrame | None, few: bool) -> DataFrame:
        met = by[key] if held is None else _met(by, key, other, held, few)
        less = {v: F.lit(means[f"m{v}"]) if held is None else F.lit(means[f"m{v}"]) + F.col(f"b{v}") for v in variants}
        sums = [F.coalesce(F.sum(F.when(inside[v], F.col("r") - less[v])), F.lit(0.0)) for v in variants]
        return met.groupBy(key).agg(*[(x / (F.count(F.when(inside[v], 1)) + reg)).alias(f"b{v}") for v, x in zip(variants, sums, strict=True)])

    held = _alternated(step, epochs, len(variants))
    asked = test.select("customer_id", "movie_id", F.col("rating").cast("double").alias("r"))
    for key, name in (("customer_id", "u"), ("movie_id", "i")):
        if epochs:
            asked = asked.join(held[key].toDF(key, *[f"{name}{v}" for v in variants]), key, "left")
    own = lambda v: sum((F.coalesce(f"{n}{v}", F.lit(0.0)) for n in "ui"), F.lit(0.0)) if epochs else F.lit(0.0)
    found = asked.select("r", *[clipped(F.lit(means[f"m{v}"]) + own(v)).alias(f"p{v}") for v in variants])
    row = found.agg(*[x.alias(f"{n}{v}") for v in variants for n, x in zip(ERRORS, metrics(F.col("r"), F.col(f"p{v}")), strict=True)]).first()
    discarded(*held.values())
    return {v: {n: row[f"{n}{v}"] for n in ERRORS} for v in variants}


def bias_fit_predict(epochs: int = 6, reg: float = 10.0, fit=None):
    return lambda train, test: predict_bias((fit or fit_bias)(train, "rating", epochs, reg), test)


def frontier(privacy: DataFrame, utility: DataFrame, keys=("scenario", "p")) -> DataFrame:
    """Privacy and utility of each release side by side."""
    return privacy.join(utility, list(keys), "left")


def multi_model_sweep(train: DataFrame, test: DataFrame, grid, models: dict) -> DataFrame:
    """utility_sweep for several models: name -> fit_predict(train, test). A noisy release is drawn once for all of them, and written."""
    grid = [(s, p, checkpointed(noisy.drop(ROW)) if p else noisy) for s, p, noisy in grid]
    made = [utility_sweep(train, test, grid, f, name) for name, f in models.items()]
    discarded(*[noisy for _, p, noisy in grid if p])
    return reduce(DataFrame.unionByName, made)
