"""Every registered query of the reference operators, with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import features as fx
from veilframe.functions.hashing import TOP
from veilframe.operators import attack, bias, fidelity, item_knn, k_anonymity, linkage, neighbours, releases
from veilframe.plans import adapters as ad
from veilframe.session import checkpoint_folder, checkpointed

SEED, RARE, TRIALS, EPOCHS = 333, 20, 300, 8
CTE = f"WITH {ad.RATINGS}"
KEY = "row_key"


def base(spark, d) -> DataFrame:
    return fx.with_features(ad.ratings(spark, d))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Sums of floats differ in their last bits with the order of adding."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# --- sources, features ------------------------------------------------------------------------------------------------
def rating_adapter(spark, d):
    return ad.ratings(spark, d)


def rating_features(spark, d):
    return base(spark, d).select(KEY, "month", "year", "rating_bucket", "rating_bucket_midpoint")


def imdb_scale_mapping(spark, d):
    ten = table10(spark, d)
    low, high = fx.star_bounds(F.col("ten"))
    return ten.select("ten", fx.expected_stars(F.col("ten")).alias("expected"), low.alias("low"), high.alias("high"), fx.rating_bucket((low + high) / 2).alias("preference"))


def table10(spark, d):
    return ad.table(spark, d, "lineitem").select((F.col("l_quantity") / 5).alias("ten")).distinct()


def parse_year(spark, d):
    part = ad.table(spark, d, "part")
    return part.select("p_partkey", fx.parse_year(F.concat("p_brand", F.lit(" ("), (1950 + F.col("p_size")).cast("string"), F.lit(")"))).alias("year"))


def title_normalize(spark, d):
    return ad.titles(spark, d).select("movie_id", fx.normalize_title(F.concat(F.lit("The "), "title", F.lit(" & Co."))).alias("norm"))


def text_filters(spark, d):
    own = ad.people(spark, d)
    return own.where(fx.user_contains("c_name", "01") | fx.user_equals("segment", "building")).select(
        "c_name", fx.label_bit(F.when(F.col("c_acctbal") < 0, "<0").otherwise(">=0")).alias("bit"), fx.mapped(F.col("segment"), {"BUILDING": "B"}).alias("segment")
    )


def dense_codes(spark, d):
    return fx.dense_codes(ad.ratings(spark, d), "customer_id")


def deidentified(spark, d):
    return k_anonymity.deidentified(ad.people(spark, d), ["c_name"]).groupBy("nation", "segment", "band").agg(F.count(F.lit(1)).alias("people"))


def summary_stats(spark, d):
    r = ad.ratings(spark, d)
    return rounded(r.agg(F.count("rating").alias("n"), F.avg("rating").alias("mean"), F.stddev("rating").alias("sd"), F.min("rating").alias("lo"), F.max("rating").alias("hi"),
                         F.countDistinct("customer_id").alias("users"), F.countDistinct("movie_id").alias("movies")))


def _folder(spark) -> str:
    """A fresh folder that driver and executors share."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def header_block_source(spark, d):
    """The ratings written as header-block files and read back."""
    from veilframe.sources.header_block import read_ratings

    line = F.concat_ws(",", "customer_id", "rating", "date")
    path = _folder(spark)
    blocks = ad.ratings(spark, d).groupBy("movie_id").agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    blocks.select(F.concat(F.col("movie_id").cast("string"), F.lit(":\n"), "lines").alias("value")).repartition(3, "value").write.text(path)
    return read_ratings(spark, path)


def titles_source(spark, d):
    from veilframe.sources.tables import read_titles

    path = _folder(spark)
    held = ad.titles(spark, d)
    held.select(F.concat_ws(",", F.col("movie_id").cast("string"), F.when(F.col("movie_id") % 7 == 0, "NULL").otherwise(F.col("year").cast("string")), F.concat("title", F.lit(", the film")))).write.text(path)
    return read_titles(spark, path).withColumn("year", F.coalesce("year", F.lit(-1)))


# --- k-anonymity and releases -----------------------------------------------------------------------------------------
K_ANON = {
    "original": ("movie_id", "rating", "month"),
    "remove_month": ("movie_id", "rating"),
    "year_only": ("movie_id", "rating", "year"),
    "coarsen": ("movie_id", "rating_bucket", "month"),
    "remove_month_coarsen": ("movie_id", "rating_bucket"),
    "movie_only": ("movie_id",),
}


def k_anon(cols, prepare=lambda df: df):
    return lambda spark, d: rounded(k_anonymity.fact_k_anonymity(prepare(base(spark, d)), cols))


def k_anon_sql(cols, source="base", more=""):
    c = ", ".join(cols)
    return f"""{CTE}{more}, sizes AS (SELECT {c}, COUNT(DISTINCT customer_id) AS k FROM {source} GROUP BY {c})
SELECT COUNT(*) AS fact_count, MIN(k) AS min_k, round(median(k), 9) AS median_k, round(AVG(k), 9) AS mean_k,
  round(AVG(CASE WHEN k = 1 THEN 1.0E0 ELSE 0.0E0 END) * 100, 9) AS pct_unique_facts FROM sizes"""


RARE_SQL = f""", rare AS (SELECT * FROM base WHERE movie_id IN (SELECT movie_id FROM base GROUP BY movie_id HAVING COUNT(DISTINCT customer_id) >= {RARE}))"""
SUPPRESS_SQL = """, big AS (SELECT movie_id, rating FROM base GROUP BY movie_id, rating HAVING COUNT(DISTINCT customer_id) >= 5),
held AS (SELECT b.* FROM base b JOIN big g ON b.movie_id IS NOT DISTINCT FROM g.movie_id AND b.rating IS NOT DISTINCT FROM g.rating)"""


def suppressed(df):
    return releases.suppress_low_k(df, ["movie_id", "rating"], 5)


def rare_removed(df):
    return releases.remove_rare_items(df, RARE)


def class_sizes(spark, d):
    return releases.class_sizes(base(spark, d), ["movie_id", "rating"])


def fact_index(spark, d):
    return k_anonymity.fact_index(base(spark, d), ["movie_id", "rating"])


def release_list(spark, d):
    got = releases.make_releases(ad.ratings(spark, d), SEED, RARE, 5, ("movie_id", "rating"))
    return reduce(DataFrame.unionByName, [r.data.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(r.name).alias("release_name"), "rows") for r in got])


def rating_noise(spark, d):
    return releases.add_rating_noise(ad.ratings(spark, d), SEED, 0.25).select(KEY, "rating")


def noise(weighted=False, **p):
    return lambda spark, d: releases.make_noisy_release(ad.ratings(spark, d), seed=SEED, weighted=weighted, **p).select(KEY, "customer_id", "movie_id", "rating")


def noise_sql(p, weighted=False):
    """p: column -> probability."""
    parts, froms, out = [CTE], ["ratings r"], {"customer_id": "r.customer_id", "movie_id": "r.movie_id", "rating": "r.rating"}
    for col, share in p.items():
        mask = f"{ad.draw(SEED, f'mask-{col}', 'r.row_key')} < {int(share * TOP)}"
        h, t = ad.draw(SEED, f"value-{col}", "r.row_key"), f"pool_{col}"
        if weighted:
            parts.append(f""", {t} AS (SELECT {col} AS v, n, CAST(SUM(n) OVER (ORDER BY {col}) - n AS BIGINT) AS lo, CAST(SUM(n) OVER (ORDER BY {col}) AS BIGINT) AS hi, CAST(SUM(n) OVER () AS BIGINT) AS total
  FROM (SELECT {col}, COUNT(*) AS n FROM ratings GROUP BY {col})),
draws_{col} AS (SELECT r.row_key, CASE WHEN {mask} AND o.total > o.n THEN CASE WHEN ({h} * (o.total - o.n)) // {TOP} >= o.lo THEN ({h} * (o.total - o.n)) // {TOP} + o.n
  ELSE ({h} * (o.total - o.n)) // {TOP} END END AS x FROM ratings r JOIN {t} o ON o.v = r.{col})""")
            froms.append(f"JOIN draws_{col} d_{col} ON d_{col}.row_key = r.row_key LEFT JOIN {t} n_{col} ON d_{col}.x >= n_{col}.lo AND d_{col}.x < n_{col}.hi")
        else:
            values = "SELECT unnest([1, 2, 3, 4, 5]) AS v" if col == "rating" else f"SELECT DISTINCT {col} AS v FROM ratings"
            parts.append(f", {t} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, COUNT(*) OVER () AS n FROM ({values}))")
            froms.append(f"JOIN {t} o_{col} ON o_{col}.v = r.{col} LEFT JOIN {t} n_{col} ON {mask} AND n_{col}.i = (o_{col}.i + 1 + {h} % (o_{col}.n - 1)) % o_{col}.n")
        out[col] = f"COALESCE(n_{col}.v, r.{col})"
    out["rating"] = f"CAST({out['rating']} AS INT)"
    return f"{''.join(parts)} SELECT r.row_key, {', '.join(f'{v} AS {k}' for k, v in out.items())} FROM {' '.join(froms)}"


def popularity_weights(spark, d):
    """Weights from popularity in place of factors, so that SQL can follow."""
    pop = ad.ratings(spark, d).groupBy("movie_id").agg(F.count(F.lit(1)).alias("n"))
    top = pop.agg(F.max("n").alias("top"))
    return pop.join(F.broadcast(top)).select("movie_id", (1.0 - F.col("n") / F.col("top")).alias("privacy_weight"))


def latent_sensitive_noise(spark, d):
    return releases.latent_sensitive(ad.ratings(spark, d), popularity_weights(spark, d), SEED).select(KEY, "rating", "month")


# --- attacks ----------------------------------------------------------------------------------------------------------
ATTACK = ("movie_id", "rating")


def candidate_trials(spark, d):
    b = base(spark, d)
    return rounded(attack.attack_trials(b, b, ATTACK, (1, 2, 3), TRIALS, SEED))


def trials_sql(index="base", ns=(1, 2, 3), cols=ATTACK, head="", known="base"):
    """CTEs up to trials(n_known, trial, target_user, candidate_count, hit)."""
    keys, on = ", ".join(cols), " AND ".join(f"i.{c} IS NOT DISTINCT FROM k.{c}" for c in cols)
    t = ad.draw(SEED, "target", "e.n_known", "e.trial")
    f = ad.draw(SEED, "fact", "t.n_known", "t.trial", "b.row_key")
    ns = ", ".join(map(str, ns))
    return f"""{head or CTE}, hist AS (SELECT customer_id, COUNT(*) AS rows_ FROM {known} GROUP BY customer_id),
elig AS (SELECT n_known, customer_id, row_number() OVER (PARTITION BY n_known ORDER BY customer_id) - 1 AS i, COUNT(*) OVER (PARTITION BY n_known) AS size_
  FROM hist, (SELECT unnest([{ns}]) AS n_known) WHERE rows_ >= n_known),
each_ AS (SELECT n_known, trial FROM (SELECT unnest([{ns}]) AS n_known), (SELECT unnest(range({TRIALS})) AS trial)),
targets AS (SELECT e.n_known, e.trial, g.customer_id AS target_user FROM each_ e JOIN elig g ON g.n_known = e.n_known AND g.i = {t} % g.size_),
facts AS (SELECT * FROM (SELECT t.n_known, t.trial, t.target_user, b.*, row_number() OVER (PARTITION BY t.n_known, t.trial ORDER BY {f}, b.row_key) AS rn
  FROM targets t JOIN {known} b ON b.customer_id = t.target_user) WHERE rn <= n_known),
known AS (SELECT DISTINCT n_known, trial, {keys} FROM facts),
wanted AS (SELECT n_known, trial, COUNT(*) AS w FROM known GROUP BY n_known, trial),
had AS (SELECT n_known, trial, candidate, COUNT(*) AS h FROM (SELECT DISTINCT k.n_known, k.trial, {', '.join('k.' + c for c in cols)}, i.customer_id AS candidate FROM known k JOIN {index} i ON {on}) GROUP BY n_known, trial, candidate),
found AS (SELECT n_known, trial, candidate FROM had JOIN wanted USING (n_known, trial) WHERE h = w),
trials AS (SELECT t.n_known, t.trial, t.target_user, COUNT(f.candidate) AS candidate_count, COALESCE(MAX(CASE WHEN f.candidate = t.target_user THEN 1 ELSE 0 END), 0) = 1 AS hit
  FROM targets t LEFT JOIN found f USING (n_known, trial) GROUP BY t.n_known, t.trial, t.target_user)"""


SUMMARY_SQL = """AVG(candidate_count) AS avg_candidate_size, median(candidate_count) AS median_candidate_size"""


def pct(flag, name):
    return f"round(AVG(CASE WHEN {flag} THEN 1.0E0 ELSE 0.0E0 END) * 100, 9) AS {name}"


def summary_sql():
    return f"""round(AVG(candidate_count), 9) AS avg_candidate_size, median(candidate_count) AS median_candidate_size, {pct('candidate_count = 1', 'pct_unique')},
  {pct('candidate_count <= 5', 'pct_5_or_less')}, {pct('candidate_count <= 10', 'pct_10_or_less')}, round(AVG({SURETY}), 9) AS avg_surety_pct, round(median({SURETY}), 9) AS median_surety_pct, COUNT(*) AS trials"""


def modes_sql():
    parts = [f"SELECT * FROM ({trials_sql(cols=cols)} SELECT '{m}' AS mode, '{' + '.join(cols)}' AS knowledge_cols, n_known, {summary_sql()} FROM trials GROUP BY n_known)" for m, cols in attack.MODES.items()]
    return " UNION ALL ".join(parts)


def release_attack_sql():
    parts = []
    for name, at, cols, _ in RELEASES:
        at = at.format("base")
        t = trials_sql(at, cols=cols, head=f"{CTE}, {_release_tables('base')}", known=at)
        parts.append(f"SELECT * FROM ({t} SELECT '{name}' AS release_name, '{' + '.join(cols)}' AS knowledge_cols, n_known, {summary_sql()} FROM trials GROUP BY n_known)")
    return " UNION ALL ".join(parts)


SURETY = "CASE WHEN candidate_count > 0 THEN 100.0E0 / candidate_count ELSE 0.0E0 END"


def candidate_summary(spark, d):
    return rounded(attack.attack_summary(attack_base(spark, d)))


def attack_base(spark, d):
    b = base(spark, d)
    return attack.attack_trials(b, b, ATTACK, (1, 2, 3), TRIALS, SEED)


def noisy_attack(spark, d):
    b = base(spark, d)
    noisy = releases.make_noisy_release(b, rating_p=0.2, seed=SEED)
    return attack.noisy_trials(b, noisy, ATTACK, (1, 2, 3), TRIALS, SEED)


def noisy_attack_trials(spark, d):
    return noisy_attack(spark, d)


def noisy_attack_summary(spark, d):
    return rounded(attack.noisy_summary(noisy_attack(spark, d)))


NOISY_HEAD = f"""{CTE}, pool AS (SELECT v, v - 1 AS i FROM (SELECT unnest([1, 2, 3, 4, 5]) AS v)),
noisy AS (SELECT r.customer_id, r.movie_id, CASE WHEN {ad.draw(SEED, 'mask-rating', 'r.row_key')} < {int(0.2 * TOP)}
  THEN CAST((r.rating - 1 + 1 + {ad.draw(SEED, 'value-rating', 'r.row_key')} % 4) % 5 + 1 AS INT) ELSE r.rating END AS rating FROM base r)"""
NOISY_SQL = f"""{trials_sql('noisy', head=NOISY_HEAD)}, flags AS (SELECT 'movie_id + rating' AS knowledge_cols, n_known, CAST(trial AS INT) AS trial, target_user, candidate_count, hit AS true_user_in_candidates,
  candidate_count BETWEEN 1 AND 4 AS less_than_5_candidates, candidate_count BETWEEN 1 AND 4 AND hit AS less_than_5_correct, candidate_count BETWEEN 1 AND 4 AND NOT hit AS less_than_5_wrong,
  candidate_count = 1 AS "unique", candidate_count = 1 AND hit AS unique_correct, candidate_count = 1 AND NOT hit AS unique_wrong, candidate_count = 0 AS no_match FROM trials)"""


def risk(column):
    return lambda spark, d: rounded(attack.risk_by(attack.trials_with_features(base(spark, d), ("movie_id", "rating", "month"), (1, 2, 3), TRIALS, SEED), column))


def risk_sql(column):
    return f"""{trials_sql(cols=('movie_id', 'rating', 'month'))}, pop AS (SELECT movie_id, COUNT(DISTINCT customer_id) AS popularity FROM base GROUP BY movie_id),
ranked AS (SELECT *, row_number() OVER (ORDER BY popularity, movie_id) AS rk, COUNT(*) OVER () AS n FROM pop),
buckets AS (SELECT movie_id, popularity, CASE WHEN rk <= 1 + (n - 1) * 0.25E0 THEN 'rare' WHEN rk <= 1 + (n - 1) * 0.5E0 THEN 'less_common' WHEN rk <= 1 + (n - 1) * 0.75E0 THEN 'common' ELSE 'popular' END AS bucket FROM ranked),
about AS (SELECT f.n_known, f.trial, arg_min(b.bucket, b.popularity * 1000000000 + b.movie_id) AS rarest_bucket, bool_or(f.rating <= 2) AS has_low_rating, bool_or(f.rating >= 4) AS has_high_rating
  FROM facts f JOIN buckets b USING (movie_id) GROUP BY f.n_known, f.trial)
SELECT {column}, n_known, COUNT(*) AS trials, round(AVG(candidate_count), 9) AS avg_candidate_size, {pct('candidate_count = 1', 'pct_unique')}, round(AVG({SURETY}), 9) AS avg_surety_pct
FROM trials JOIN about USING (n_known, trial) GROUP BY {column}, n_known"""


def knowledge_modes(spark, d):
    return rounded(attack.evaluate_modes(base(spark, d), attack.MODES, (1, 2, 3), TRIALS, SEED))


def release_attack_summary(spark, d):
    return release_attack_of(ad.ratings(spark, d))


def release_attack_of(ratings):
    got = releases.make_releases(ratings, SEED, RARE, 5, ("movie_id", "rating"))
    return rounded(attack.evaluate_releases(got, (1, 2, 3), TRIALS, SEED)[2])


# --- splits and the bias model ----------------------------------------------------------------------------------------
TEST_SQL = f"{ad.draw(SEED, 'holdout', KEY)} < {int(0.2 * TOP)}"


def holdout_split(spark, d):
    train, test = bias.split(ad.ratings(spark, d), 0.2, SEED, check=False)
    return train.select(KEY, F.lit("train").alias("side")).union(test.select(KEY, F.lit("test").alias("side")))


def exact_split(spark, d):
    train, test = bias.exact_split(ad.ratings(spark, d), 0.8, SEED)
    return train.select(KEY, F.lit("train").alias("side")).union(test.select(KEY, F.lit("test").alias("side")))


def holdout_users(spark, d):
    return bias.holdout_users(ad.ratings(spark, d), 0.25, SEED)


def official_holdout(spark, d):
    r = ad.ratings(spark, d)
    pairs = r.where(F.col("date") >= F.lit("2000-01-01").cast("date")).select("movie_id", "customer_id").distinct()
    train, test = bias.official_holdout(r, pairs)
    return train.select(KEY, F.lit("train").alias("side")).union(test.select(KEY, F.lit("test").alias("side")))


def bias_predictions(spark, d):
    train, test = bias.split(ad.ratings(spark, d), 0.2, SEED, check=False)
    return rounded(bias.predict_bias(bias.fit_bias(train, epochs=EPOCHS), test).select(KEY, "prediction"), 6)




def bias_ctes(epochs=EPOCHS, train="train", value="rating", p="", by=""):
    """CTEs mu{p}(m), bu{p}(customer_id, bu), bi{p}(movie_id, bi) of a model's epochs; by: a further key of every table, with a comma."""
    on = lambda key: f"USING ({by}{key})"
    mean = f"CROSS JOIN mu{p}" if not by else f"JOIN mu{p} USING ({by.rstrip(', ')})"
    grouped = f" GROUP BY {by.rstrip(', ')}" if by else ""
    out = [f"mu{p} AS MATERIALIZED (SELECT {by}AVG(CAST({value} AS DOUBLE)) AS m FROM {train}{grouped})"]
    for e in range(1, epochs + 1):
        other, less = ("", "") if e == 1 else (f"JOIN bi{p}_{e - 1} {on('movie_id')}", f" - bi{p}_{e - 1}.b")
        out.append(f"bu{p}_{e} AS MATERIALIZED (SELECT {by}customer_id, SUM({value} - m{less}) / (COUNT(*) + 10.0E0) AS b FROM {train} {other} {mean} GROUP BY {by}customer_id)")
        out.append(f"bi{p}_{e} AS MATERIALIZED (SELECT {by}movie_id, SUM({value} - m - b) / (COUNT(*) + 10.0E0) AS b FROM {train} JOIN bu{p}_{e} {on('customer_id')} {mean} GROUP BY {by}movie_id)")
    out.append(f"bu{p} AS (SELECT {by}customer_id, b AS bu FROM bu{p}_{epochs}), bi{p} AS (SELECT {by}movie_id, b AS bi FROM bi{p}_{epochs})")
    return ", ".join(out)


SPLIT_SQL = f"{CTE}, train AS (SELECT * FROM ratings WHERE NOT ({TEST_SQL})), test AS (SELECT * FROM ratings WHERE {TEST_SQL})"
BIAS_SQL = f"""{SPLIT_SQL}, {bias_ctes()},
pred AS (SELECT t.*, GREATEST(1.0E0, LEAST(5.0E0, m + COALESCE(bu, 0) + COALESCE(bi, 0))) AS prediction FROM test t LEFT JOIN bu USING (customer_id) LEFT JOIN bi USING (movie_id), mu)"""
METRICS_SQL = """COUNT(*) AS test_rows, round(sqrt(AVG((prediction - rating) * (prediction - rating))), 6) AS rmse, round(AVG(abs(prediction - rating)), 6) AS mae,
round(AVG(CASE WHEN abs(prediction - rating) <= 1 THEN 1.0E0 ELSE 0.0E0 END) * 100, 6) AS within_one_star"""


def bias_metrics(spark, d):
    train, test = bias.split(ad.ratings(spark, d), 0.2, SEED, check=False)
    return rounded(bias.evaluate(bias.predict_bias(bias.fit_bias(train, epochs=EPOCHS), test)), 6)


def global_mean(spark, d):
    return rounded(bias.global_mean_baseline(*bias.split(ad.ratings(spark, d), 0.2, SEED, check=False)), 6)


def release_rmse(spark, d):
    return release_rmse_of(ad.ratings(spark, d))


def release_rmse_of(ratings):
    train, test = bias.split(ratings, 0.2, SEED)
    got = bias.compare_releases(train, test, epochs=EPOCHS, seed=SEED, rare_min=RARE, k=5, suppress_cols=("movie_id", "rating"))
    return rounded(got.na.fill(-1).na.fill("none"), 6)


def _release_tables(source):
    """CTEs of the tables of the fixed releases made of a table with the columns of base."""
    h = ad.draw(SEED, "rating-noise", "row_key")
    return f"""noisy_ AS (SELECT * EXCLUDE (rating), CAST(CASE WHEN {h} < {int(0.125 * TOP)} THEN GREATEST(1, rating - 1) WHEN {h} >= {TOP - int(0.125 * TOP)} THEN LEAST(5, rating + 1) ELSE rating END AS INT) AS rating FROM {source}),
rare_ AS (SELECT * FROM {source} WHERE movie_id IN (SELECT movie_id FROM {source} GROUP BY movie_id HAVING COUNT(DISTINCT customer_id) >= {RARE})),
held_ AS (SELECT b.* FROM {source} b JOIN (SELECT movie_id, rating FROM {source} GROUP BY movie_id, rating HAVING COUNT(DISTINCT customer_id) >= 5) g USING (movie_id, rating))"""


#: name, table, known columns, rating column
RELEASES = [
    ("original_movie_rating_month", "{}", ("movie_id", "rating", "month"), "rating"),
    ("remove_month", "{}", ("movie_id", "rating"), "rating"),
    ("year_only", "{}", ("movie_id", "rating", "year"), "rating"),
    ("coarsen_rating", "{}", ("movie_id", "rating_bucket", "month"), "rating_bucket_midpoint"),
    ("remove_month_and_coarsen_rating", "{}", ("movie_id", "rating_bucket"), "rating_bucket_midpoint"),
    ("add_rating_noise", "noisy_", ("movie_id", "rating", "month"), "rating"),
    (f"remove_rare_movies_min_{RARE}", "rare_", ("movie_id", "rating", "month"), "rating"),
    ("k_suppress_movie_rating_month_k5", "held_", ("movie_id", "rating", "month"), "rating"),
    ("movie_only", "{}", ("movie_id",), None),
]


def release_rmse_sql():
    parts = [f"{CTE}, tb AS MATERIALIZED (SELECT * FROM base WHERE NOT ({TEST_SQL})), test AS MATERIALIZED (SELECT * FROM base WHERE {TEST_SQL}), {_release_tables('tb')}"]
    fits, rows = {}, []
    for name, at, _, value in RELEASES:
        at = at.format("tb")
        n = f"(SELECT COUNT(*) FROM {at})"
        if value is None:
            rows.append(f"SELECT '{name}' AS release_name, 'none' AS rating_col, {n} AS train_rows, -1 AS test_rows, -1.0E0 AS global_mean, -1.0E0 AS rmse, -1.0E0 AS mae, 'skipped_no_rating_labels' AS status")
            continue
        if (at, value) not in fits:
            k = fits[at, value] = f"_f{len(fits)}"
            parts.append(f"""{bias_ctes(train=at, value=value, p=k)}, e{k} AS (SELECT COUNT(*) AS n, any_value(m) AS m, sqrt(AVG(d * d)) AS r, AVG(abs(d)) AS a FROM (
  SELECT m, GREATEST(1.0E0, LEAST(5.0E0, m + COALESCE(bu, 0) + COALESCE(bi, 0))) - rating AS d FROM test LEFT JOIN bu{k} USING (customer_id) LEFT JOIN bi{k} USING (movie_id) CROSS JOIN mu{k}))""")
        k = fits[at, value]
        rows.append(f"SELECT '{name}', '{value}', {n}, n, round(m, 6), round(r, 6), round(a, 6), 'ok' FROM e{k}")
    return ", ".join(parts) + " " + " UNION ALL ".join([rows[-1], *rows[:-1]])


RELEASE_LIST_SQL = f"{CTE}, {_release_tables('base')} " + " UNION ALL ".join(f"SELECT '{n}' AS release_name, COUNT(*) AS rows FROM {at.format('base')}" for n, at, _, _ in RELEASES)


# --- linkage ----------------------------------------------------------------------------------------------------------
def matched(spark, d):
    return linkage.match_titles(ad.profile(spark, d), ad.titles(spark, d))


def match_exact_year(spark, d):
    return matched(spark, d).where("match_method = 'exact_title_year'").select("imdb_title", "imdb_year", "imdb_rating", "netflix_movie_id")


def match_unique_title(spark, d):
    wrong = ad.profile(spark, d).withColumn("year", F.col("year") + 1000)
    got = linkage.match_titles(wrong, ad.titles(spark, d), linkage.MatchConfig(fuzzy=False))
    return got.select("imdb_title", "imdb_year", "imdb_rating", F.coalesce("netflix_movie_id", F.lit(-1)).alias("netflix_movie_id"), "match_method")


def match_fuzzy(spark, d):
    typo = ad.profile(spark, d).withColumn("title", F.concat("title", F.lit("x")))
    return rounded(linkage.match_titles(typo, ad.titles(spark, d)).select("imdb_title", "imdb_year", F.coalesce("netflix_movie_id", F.lit(-1)).alias("netflix_movie_id"), "match_method", "match_score"))


MATCH_SQL = f"""WITH {ad.RATINGS}, {ad.TITLES}, {ad.PROFILE},
norm_t AS (SELECT *, {{t}} AS norm FROM titles), norm_p AS (SELECT *, {{p}} AS norm FROM profile)"""


def norm_sql(col):
    tokens = f"regexp_extract_all(replace(lower({col}), '&', ' and '), '[a-z0-9]+')"
    return f"array_to_string(CASE WHEN list_contains(['a', 'an', 'the'], {tokens}[1]) THEN {tokens}[2:] ELSE {tokens} END, ' ')"


MATCH_SQL = MATCH_SQL.format(t=norm_sql("title"), p=norm_sql("title"))
EXACT_SQL = f"""{MATCH_SQL}, exact_ AS (SELECT p.title AS imdb_title, p.year AS imdb_year, p.user, p.rating AS imdb_rating,
  (SELECT MAX(movie_id) FROM norm_t t WHERE t.norm = p.norm AND t.year = p.year) AS netflix_movie_id FROM norm_p p)"""
FACTS_SQL = f"""{EXACT_SQL}, facts AS (SELECT netflix_movie_id, AVG(imdb_rating) AS imdb_rating, AVG(GREATEST(1, LEAST(5, imdb_rating / 2))) AS e, MIN(CAST(GREATEST(FLOOR(GREATEST(1, LEAST(5, imdb_rating / 2))), 1) AS INT)) AS lo,
  MAX(CAST(LEAST(CEIL(GREATEST(1, LEAST(5, imdb_rating / 2))), 5) AS INT)) AS hi FROM exact_ GROUP BY netflix_movie_id)"""


def linkage_facts(spark, d):
    got = linkage.linkage_facts(matched(spark, d))
    return rounded(got.select("netflix_movie_id", "imdb_rating", "expected_netflix_rating", "rating_low", "rating_high", "match_method", "match_score"))


def linkage_candidates(spark, d):
    _, _, found = linkage.linkage_attack(ad.profile(spark, d), ad.titles(spark, d), ad.ratings(spark, d), f"USER{ad.PERSON}")
    return rounded(found.withColumn("rank", F.col("rank").cast("bigint")), 6)


CANDIDATES_SQL = f"""{FACTS_SQL}, sums AS (SELECT customer_id, SUM(-0.5E0 * ((rating - e) / 0.75E0) * ((rating - e) / 0.75E0)) AS s, SUM((rating - e) * (rating - e)) AS sq, SUM(abs(rating - e)) AS ab, COUNT(*) AS n,
  COUNT(*) FILTER (rating BETWEEN lo AND hi) AS x FROM ratings JOIN facts ON movie_id = netflix_movie_id GROUP BY customer_id),
f AS (SELECT COUNT(*) AS t FROM facts),
made AS (SELECT customer_id, s + (t - n) * -0.75E0 AS log_score, n AS matched_facts, t AS total_facts, n / CAST(t AS DOUBLE) AS coverage, x AS exact_rating_matches, x / CAST(n AS DOUBLE) AS exact_rating_rate,
  ab / n AS mean_abs_error, sqrt(sq / n) AS rmse_to_imdb_profile FROM sums, f WHERE n >= 2)
SELECT row_number() OVER (ORDER BY round(log_score, 9) DESC, matched_facts DESC, exact_rating_rate DESC, customer_id) AS rank, customer_id, round(log_score, 6) AS log_score, matched_facts, total_facts,
  round(coverage, 6) AS coverage, exact_rating_matches, round(exact_rating_rate, 6) AS exact_rating_rate, round(mean_abs_error, 6) AS mean_abs_error, round(rmse_to_imdb_profile, 6) AS rmse_to_imdb_profile
FROM made QUALIFY rank <= 50"""


# --- quasi-identifiers ------------------------------------------------------------------------------------------------
QIS = ("nation", "segment", "band")


def qi_join(spark, d):
    p = ad.people(spark, d)
    return k_anonymity.qi_join(p.select("c_name", *QIS), p.select(*QIS, F.round("c_acctbal", 2).alias("balance")), QIS)


def qi_powerset(spark, d):
    return rounded(k_anonymity.powerset_reidentification(ad.people(spark, d), QIS))


def powerset_sql():
    parts = []
    for mask in range(1, 8):
        cols = [q for i, q in enumerate(QIS) if mask >> i & 1]
        c, ok = ", ".join(cols), " AND ".join(f"{q} IS NOT NULL" for q in cols)
        parts.append(f"SELECT '{'+'.join(cols)}' AS columns, round((SELECT COUNT(*) FROM (SELECT {c} FROM people WHERE {ok} GROUP BY {c} HAVING COUNT(*) = 1)) / CAST((SELECT COUNT(*) FROM people) AS DOUBLE), 9) AS reidentified")
    return f"WITH {ad.PEOPLE} " + " UNION ALL ".join(parts)


def match_count_hist(spark, d):
    p = ad.people(spark, d)
    return k_anonymity.match_count_histogram(p, p, ("nation", "segment"))


def full_row_classes(spark, d):
    return rounded(k_anonymity.full_row_classes(ad.people(spark, d), QIS))


def small_group_means(spark, d):
    return rounded(k_anonymity.group_means(ad.people(spark, d), QIS, "c_acctbal"), 6)


def differencing(spark, d):
    return rounded(k_anonymity.differencing_attack(ad.people(spark, d), F.col("c_name") == "Customer#000000007", "c_acctbal"), 4)


def inferred_share(spark, d):
    p = ad.people(spark, d)
    return rounded(k_anonymity.inferred_share(p.select("c_name", "nation"), p.select("nation", (F.col("c_acctbal") < 0).alias("debt")), ["nation"], F.col("debt")))


# --- similarity -------------------------------------------------------------------------------------------------------
def popularity_quartile(spark, d):
    return attack.popularity_buckets(ad.ratings(spark, d))


def pct_rank_weight(spark, d):
    from veilframe.operators.als import privacy_weights

    pop = ad.ratings(spark, d).groupBy("movie_id").agg(F.count(F.lit(1)).alias("count"), F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("norm"))
    return rounded(privacy_weights(pop).select("movie_id", "popularity_pct", "leverage_pct", (F.col("privacy_weight") + 1e-9).alias("privacy_weight")), 6)


def knn_parts(spark, d):
    train, test = bias.split(ad.ratings(spark, d), 0.2, SEED, check=False)
    model = bias.fit_bias(train, epochs=EPOCHS)
    res = item_knn.residuals(train, model)
    return train, test, model, res


def item_knn_neighbors(spark, d):
    *_, res = knn_parts(spark, d)
    return rounded(item_knn.item_neighbours(res).select("movie_id", "neighbour", "sim"), 6)


def item_knn_predict(spark, d):
    _, test, model, res = knn_parts(spark, d)
    return rounded(item_knn.predict_item_knn(model, res, item_knn.item_neighbours(res), test).select(KEY, "prediction"), 5)


KNN_SQL = f"""{BIAS_SQL}, coll AS (SELECT customer_id, movie_id, AVG(CAST(rating AS DOUBLE)) AS r FROM train GROUP BY customer_id, movie_id),
res AS (SELECT customer_id, movie_id, r - GREATEST(1.0E0, LEAST(5.0E0, m + COALESCE(bu, 0) + COALESCE(bi, 0))) AS res FROM coll LEFT JOIN bu USING (customer_id) LEFT JOIN bi USING (movie_id), mu),
norms AS (SELECT movie_id, sqrt(SUM(res * res)) AS norm FROM res GROUP BY movie_id),
dots AS (SELECT a.movie_id AS a, b.movie_id AS b, SUM(a.res * b.res) AS dot FROM res a JOIN res b USING (customer_id) WHERE a.movie_id <> b.movie_id GROUP BY a.movie_id, b.movie_id),
sims AS (SELECT a AS movie_id, b AS neighbour, COALESCE(dot / NULLIF(na.norm * nb.norm, 0), 0) AS sim FROM dots JOIN norms na ON na.movie_id = a JOIN norms nb ON nb.movie_id = b WHERE dot > 0),
near AS (SELECT * FROM sims WHERE round(sim, 9) >= 0.05E0 QUALIFY row_number() OVER (PARTITION BY movie_id ORDER BY round(sim, 9) DESC, neighbour) <= 30)"""
KNN_PREDICT_SQL = f"""{KNN_SQL}, shift AS (SELECT t.customer_id, t.movie_id, SUM(sim * res) / SUM(abs(sim)) AS s FROM (SELECT DISTINCT customer_id, movie_id FROM test) t
  JOIN near n ON n.movie_id = t.movie_id JOIN res r ON r.customer_id = t.customer_id AND r.movie_id = n.neighbour GROUP BY t.customer_id, t.movie_id)
SELECT row_key, round(GREATEST(1.0E0, LEAST(5.0E0, prediction + COALESCE(s, 0))), 5) AS prediction FROM pred LEFT JOIN shift USING (customer_id, movie_id)"""


def profile_nn_attack(spark, d):
    r = ad.ratings(spark, d)
    return rounded(neighbours.nearest_neighbor_attack(neighbours.sample_profiles(r, TRIALS, 6, SEED), r), 6)


def membership(spark, d):
    r = ad.ratings(spark, d)
    return rounded(neighbours.membership_features(neighbours.sample_profiles(r, TRIALS, 6, SEED), r), 6)


NN_SQL = f"""{CTE}, users AS (SELECT customer_id FROM ratings GROUP BY customer_id HAVING COUNT(*) >= 6 ORDER BY {ad.draw(SEED, 'profile-user', 'customer_id')}, customer_id LIMIT {TRIALS}),
prof AS (SELECT * FROM ratings JOIN users USING (customer_id) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY {ad.draw(SEED, 'profile-fact', 'row_key')}, row_key) <= 6),
p AS (SELECT customer_id AS profile, movie_id, AVG(CAST(rating AS DOUBLE)) - 3 AS x FROM prof GROUP BY customer_id, movie_id),
r AS (SELECT customer_id AS candidate, movie_id, AVG(CAST(rating AS DOUBLE)) - 3 AS x FROM ratings GROUP BY customer_id, movie_id),
dots AS (SELECT profile, candidate, SUM(p.x * r.x) AS dot FROM p JOIN r USING (movie_id) GROUP BY profile, candidate),
pn AS (SELECT profile, sqrt(SUM(x * x)) AS a FROM p GROUP BY profile), rn AS (SELECT candidate, sqrt(SUM(x * x)) AS b FROM r GROUP BY candidate),
sims AS (SELECT profile, candidate, COALESCE(dot / NULLIF(a * b, 0), 0) AS sim FROM dots JOIN pn USING (profile) JOIN rn USING (candidate)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY round(sim, 9) DESC, candidate) AS rk FROM sims)"""
MEMBER_SQL = f"""{NN_SQL}, f AS (SELECT profile, MAX(CASE WHEN rk = 1 THEN sim END) AS s1, MAX(CASE WHEN rk = 2 THEN sim END) AS s2, SUM(CASE WHEN rk <= 5 THEN sim ELSE 0 END) AS s FROM ranked GROUP BY profile),
k AS (SELECT customer_id AS profile, COUNT(DISTINCT movie_id) AS known_movies FROM prof GROUP BY customer_id)
SELECT profile, round(COALESCE(s1, 0), 6) AS best_similarity, round(COALESCE(s1, 0) - COALESCE(s2, 0), 6) AS gap_to_second, round(COALESCE(s, 0) / 5, 6) AS mean_top5, known_movies FROM k LEFT JOIN f USING (profile)"""


def membership_auc(spark, d):
    inside, members, others = neighbours.membership_sets(ad.ratings(spark, d), 60, 6, 0.25, SEED)
    return neighbours.membership_auc(members, others, inside, seed=SEED).select(F.round("auc", 6).alias("auc"), F.round("accuracy", 6).alias("accuracy"), "rows")


# --- fidelity, synthetic rows, factors, sweeps ------------------------------------------------------------------------
def js(spark, d):
    clean = ad.ratings(spark, d)
    return rounded(fidelity.js_divergence(clean, releases.add_rating_noise(clean, SEED, 0.25), "rating"))


JS_SQL = f"""{CTE}, noisy AS (SELECT CASE WHEN h < {int(0.125 * TOP)} THEN GREATEST(1, rating - 1) WHEN h >= {TOP - int(0.125 * TOP)} THEN LEAST(5, rating + 1) ELSE rating END AS rating
  FROM (SELECT rating, {ad.draw(SEED, 'rating-noise', 'row_key')} AS h FROM ratings)),
a AS (SELECT rating, COUNT(*) / CAST((SELECT COUNT(*) FROM ratings) AS DOUBLE) AS p FROM ratings GROUP BY rating),
b AS (SELECT rating, COUNT(*) / CAST((SELECT COUNT(*) FROM noisy) AS DOUBLE) AS q FROM noisy GROUP BY rating),
both_ AS (SELECT COALESCE(p, 0) AS p, COALESCE(q, 0) AS q, (COALESCE(p, 0) + COALESCE(q, 0)) / 2 AS m FROM a FULL JOIN b USING (rating))
SELECT round(0.5E0 * SUM(p * log2((p + 1e-12) / (m + 1e-12))) + 0.5E0 * SUM(q * log2((q + 1e-12) / (m + 1e-12))), 9) AS js_divergence FROM both_"""


def dataset_profile(spark, d):
    return rounded(fidelity.dataset_profile(base(spark, d)))


def rating_histogram(spark, d):
    return rounded(fidelity.histogram(ad.ratings(spark, d), "rating"))


def clipped_histories(spark, d):
    return rounded(fidelity.clipped_histories(ad.ratings(spark, d)))


def synthetic(spark, d):
    return synthetic_of(base(spark, d))


def synthetic_of(df):
    from veilframe.operators.synthetic import synthetic_release

    return synthetic_release(df, seed=SEED)


def als_predict(spark, d):
    from veilframe.operators.als import als_fit_predict

    train, test = bias.split(ad.ratings(spark, d), 0.2, SEED)
    return als_fit_predict()(train, test).select(KEY, "prediction")


def als_factors(spark, d):
    from veilframe.operators.als import als_model, factor_diagnostics
    from veilframe.operators.item_knn import collapsed

    r = ad.ratings(spark, d)
    return factor_diagnostics(als_model(collapsed(r), "rating"), r, ad.titles(spark, d))


GRID_EPOCHS = 6


def sweep(spark, d):
    train, test = bias.split(checkpointed(ad.ratings(spark, d).drop("date")), 0.2, SEED)
    points, cases = releases.noise_cases(train, seed=SEED)
    return rounded(bias.bias_sweep(train, test, points, GRID_EPOCHS, cases=cases).na.fill(-1.0), 6)


def privacy_utility(spark, d):
    b = base(spark, d)
    facts = checkpointed(attack.sampled_facts(b, (1, 2, 3), TRIALS, SEED))
    points, cases = releases.noise_cases(b, seed=SEED)
    risk_ = attack.variant_trials(facts, cases, points, ATTACK, (1, 2, 3), TRIALS)
    return rounded(bias.frontier(attack.noisy_summary(risk_, ("scenario", "p", "n_known")), sweep(spark, d)), 6)


def grid_ctes(source):
    """CTEs points(v, scenario, p), variants(v, and the thresholds of each column) and x: the rows of each variant. Points without
    noise share variant 0."""
    on = {"rating": (1, 0, 0), "movie": (0, 1, 0), "user_id": (0, 0, 1), "all_three": (1, 1, 1)}
    points, variants = [], ["(0, 0, 0, 0)"]
    for s in releases.SCENARIOS:
        for share in releases.SHARES:
            if share:
                variants.append(f"({len(variants)}, {', '.join(str(int(share * w * TOP)) for w in on[s])})")
            points.append(f"({len(variants) - 1 if share else 0}, '{s}', {float(share)!r}E0)")
    h = lambda what, col: ad.draw(SEED, f"{what}-{col}", "r.row_key")
    pool = lambda col: f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT {col} AS v FROM {source}))"
    return f"""points(v, scenario, p) AS (VALUES {', '.join(points)}), variants(v, tr, tm, tu) AS (VALUES {', '.join(variants)}),
pool_m AS MATERIALIZED {pool('movie_id')}, pool_u AS MATERIALIZED {pool('customer_id')},
drawn AS MATERIALIZED (SELECT r.*, {h('mask', 'rating')} AS hr, {h('mask', 'movie_id')} AS hm, {h('mask', 'customer_id')} AS hu, CAST((rating - 1 + 1 + {h('value', 'rating')} % 4) % 5 + 1 AS INT) AS nr, nm.v AS nm, nu.v AS nu
  FROM {source} r JOIN pool_m om ON om.v = r.movie_id JOIN pool_m nm ON nm.i = (om.i + 1 + {h('value', 'movie_id')} % (om.n - 1)) % om.n
  JOIN pool_u ou ON ou.v = r.customer_id JOIN pool_u nu ON nu.i = (ou.i + 1 + {h('value', 'customer_id')} % (ou.n - 1)) % ou.n),
x AS MATERIALIZED (SELECT v, row_key, CASE WHEN hu < tu THEN nu ELSE customer_id END AS customer_id, CASE WHEN hm < tm THEN nm ELSE movie_id END AS movie_id, CASE WHEN hr < tr THEN nr ELSE rating END AS rating FROM drawn CROSS JOIN variants)"""


SWEEP_CTES = f"""{grid_ctes('train')}, {bias_ctes(GRID_EPOCHS, 'x', p='_x', by='v, ')},
errors AS (SELECT v, GREATEST(1.0E0, LEAST(5.0E0, m + COALESCE(bu, 0) + COALESCE(bi, 0))) - rating AS e FROM test CROSS JOIN variants JOIN mu_x USING (v) LEFT JOIN bu_x USING (v, customer_id) LEFT JOIN bi_x USING (v, movie_id)),
got AS (SELECT v, sqrt(AVG(e * e)) AS rmse, AVG(abs(e)) AS mae, AVG(CASE WHEN abs(e) <= 1 THEN 1.0E0 ELSE 0.0E0 END) * 100 AS one FROM errors GROUP BY v),
lead_ AS (SELECT (SELECT sqrt(AVG((rating - m) * (rating - m))) FROM test, (SELECT AVG(CAST(rating AS DOUBLE)) AS m FROM train)) AS base, rmse AS clean, one AS clean_one FROM got WHERE v = 0),
swept AS (SELECT 'bias' AS model, scenario, p, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(one, 6) AS within_one_star, round(CASE WHEN base > clean THEN 100 * (base - rmse) / (base - clean) ELSE -1 END, 6) AS retained_rmse_pct,
  round(100 * one / clean_one, 6) AS retained_within_one_pct, round(100 * (rmse / clean - 1), 6) AS rmse_increase_pct FROM points JOIN got USING (v) CROSS JOIN lead_)"""
SWEEP_SQL = f"{SPLIT_SQL}, {SWEEP_CTES} SELECT * FROM swept"


def frontier_sql():
    """The attack on all variants of the whole table at once, then the sweep of the training side."""
    head = f"{CTE}, {grid_ctes('base')}"
    t = trials_sql(head=head)
    cut = t.index("had AS (")
    k = ", ".join("k." + c for c in ATTACK)
    flags = f"""had AS (SELECT v, n_known, trial, candidate, COUNT(*) AS h FROM (SELECT DISTINCT v, k.n_known, k.trial, {k}, i.customer_id AS candidate FROM known k JOIN x i ON {' AND '.join(f'i.{c} = k.{c}' for c in ATTACK)}) GROUP BY v, n_known, trial, candidate),
found AS (SELECT v, n_known, trial, candidate FROM had JOIN wanted USING (n_known, trial) WHERE h = w),
trials AS (SELECT v, t.n_known, t.trial, COUNT(f.candidate) AS candidate_count, COALESCE(MAX(CASE WHEN f.candidate = t.target_user THEN 1 ELSE 0 END), 0) = 1 AS hit
  FROM targets t CROSS JOIN variants LEFT JOIN found f USING (v, n_known, trial) GROUP BY v, t.n_known, t.trial),
flags AS (SELECT v, n_known, candidate_count, candidate_count BETWEEN 1 AND 4 AS less_than_5_candidates, candidate_count BETWEEN 1 AND 4 AND hit AS less_than_5_correct, candidate_count BETWEEN 1 AND 4 AND NOT hit AS less_than_5_wrong,
  candidate_count = 1 AS "unique", candidate_count = 1 AND hit AS unique_correct, candidate_count = 1 AND NOT hit AS unique_wrong, candidate_count = 0 AS no_match FROM trials)"""
    six = lambda flag, name: pct(flag, name).replace(", 9)", ", 6)")
    rate = lambda a, b: f"round(COALESCE(COUNT(*) FILTER ({a}) / CAST(NULLIF(COUNT(*) FILTER ({b}), 0) AS DOUBLE), 0), 6)"
    shares = ", ".join(six(f'"{c}"', f"pct_{c}") for c in ("unique", "unique_correct", "unique_wrong", "less_than_5_candidates", "less_than_5_correct", "less_than_5_wrong", "no_match"))
    risk_ = f"""{t[:cut]}{flags} SELECT scenario, p, n_known, COUNT(*) AS trials, round(AVG(candidate_count), 6) AS avg_candidate_size, median(candidate_count) AS median_candidate_size, {shares},
  COUNT(*) FILTER ("unique") AS unique_count, COUNT(*) FILTER (less_than_5_candidates) AS less_than_5_count, {rate('unique_wrong', '"unique"')} AS unique_false_positive_rate, {rate('less_than_5_wrong', 'less_than_5_candidates')} AS less_than_5_false_positive_rate
  FROM points JOIN flags USING (v) GROUP BY scenario, p, n_known"""
    return f"SELECT * FROM ({risk_}) JOIN ({SWEEP_SQL}) USING (scenario, p)"


def synthetic_checks(spark, d):
    real = checkpointed(base(spark, d).select("customer_id", "movie_id", "rating", "month"))
    return fidelity.synthetic_checks(checkpointed(synthetic_of(real)), real, key="id")


def train_on_synthetic(spark, d):
    from veilframe.operators.synthetic import train_on_synthetic as run

    b = base(spark, d)
    train, test = (checkpointed(x.select("customer_id", "movie_id", "rating", "month")) for x in bias.split(b, 0.2, SEED, check=False))
    bias.not_empty(train, test)
    return rounded(run(checkpointed(synthetic_of(train.union(test))), train, test), 6)


def raw_als(spark, d):
    from veilframe.operators.als import raw_als_metrics

    return raw_als_metrics(*bias.split(ad.ratings(spark, d), 0.2, SEED))


def multi_model(spark, d):
    train, test = bias.split(ad.ratings(spark, d).select("row_key", "customer_id", "movie_id", "rating"), 0.2, SEED, once=True)
    fit = bias.SharedFits()
    models = {"bias": bias.bias_fit_predict(1, fit=fit), "item_knn": item_knn.knn_fit_predict(epochs=1, fit=fit)}
    made = bias.multi_model_sweep(train, test, releases.noise_grid(train, (0.0, 0.2), ("rating",), SEED), models)
    fit.discard()
    return made


def scorecard(spark, d):
    from veilframe.plans.report import presented
    from veilframe.plans.report import scorecard as card

    from veilframe.plans.catalog_more import neighbour_risk

    r = checkpointed(ad.ratings(spark, d))
    return presented(card(release_rmse_of(r), checkpointed(release_attack_of(r)), neighbour_risk(r)))


def text_classifier(spark, d):
    from veilframe.operators.classifier import census_classifier

    people = ad.people(spark, d).withColumn("rich", (F.col("c_acctbal") > 5000).cast("int"))
    return census_classifier(people, ["segment"], ["nation", "band"], "rich", SEED)


def html_ratings(spark, d):
    from veilframe.sources.html_ratings import extract_ratings

    page = F.concat(
        F.lit('<html><script id="__NEXT_DATA__" type="application/json">{"a":[{"titleText":{"text":"'), "p_name",
        F.lit('"},"releaseYear":{"year":'), (1950 + F.col("p_size")).cast("string"), F.lit('},"userRating":{"value":'), (1 + F.col("p_size") % 10).cast("string"), F.lit("}}]}</script></html>"),
    )
    pages = ad.table(spark, d, "part").select("p_partkey", page.alias("html"))
    return extract_ratings(pages).select("p_partkey", "title", "year", "rating")


def _of_noise(**p):
    return noise(**p), noise_sql({{"rating_p": "rating", "movie_p": "movie_id", "user_p": "customer_id"}[k]: v for k, v in p.items() if k != "weighted"}, p.get("weighted", False))


def _entries() -> dict:
    """name -> (query, SQL or None)."""
    out = {
        "rating_adapter": (rating_adapter, f"{CTE} SELECT * FROM ratings"),
        "rating_features": (rating_features, f"{CTE} SELECT row_key, month, year, rating_bucket, rating_bucket_midpoint FROM base"),
        "imdb_scale_mapping": (imdb_scale_mapping, """WITH t AS (SELECT DISTINCT l_quantity / 5 AS ten FROM lineitem), e AS (SELECT ten, GREATEST(1.0E0, LEAST(5.0E0, ten / 2)) AS expected FROM t),
b AS (SELECT *, CAST(GREATEST(FLOOR(expected), 1) AS INT) AS low, CAST(LEAST(CEIL(expected), 5) AS INT) AS high FROM e)
SELECT ten, expected, low, high, CASE WHEN (low + high) / 2.0E0 <= 2 THEN 'disliked' WHEN (low + high) / 2.0E0 >= 4 THEN 'liked' ELSE 'neutral' END AS preference FROM b"""),
        "parse_year": (parse_year, "SELECT p_partkey, CAST(NULLIF(regexp_extract(p_brand || ' (' || (1950 + p_size) || ')', '([0-9]{4})', 1), '') AS INT) AS year FROM part"),
        "title_normalize": (title_normalize, f"WITH {ad.TITLES}, x AS (SELECT movie_id, 'The ' || title || ' & Co.' AS t FROM titles) SELECT movie_id, {norm_sql('t')} AS norm FROM x"),
        "text_filters": (text_filters, f"WITH {ad.PEOPLE} SELECT c_name, CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END AS INT) AS bit, CASE WHEN segment = 'BUILDING' THEN 'B' ELSE segment END AS segment FROM people WHERE contains(c_name, '01') OR lower(segment) = 'building'"),
        "dense_codes": (dense_codes, f"{CTE} SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS code FROM (SELECT DISTINCT customer_id FROM ratings)"),
        "deidentified_counts": (deidentified, f"WITH {ad.PEOPLE} SELECT nation, segment, band, COUNT(*) AS people FROM people GROUP BY nation, segment, band"),
        "summary_statistics": (summary_stats, f"{CTE} SELECT COUNT(rating) AS n, round(AVG(rating), 9) AS mean, round(stddev_samp(rating), 9) AS sd, MIN(rating) AS lo, MAX(rating) AS hi, COUNT(DISTINCT customer_id) AS users, COUNT(DISTINCT movie_id) AS movies FROM ratings"),
        "fact_k_anonymity_rare_removed": (k_anon(K_ANON["original"], rare_removed), k_anon_sql(K_ANON["original"], "rare", RARE_SQL)),
        "fact_k_anonymity_k_suppressed": (k_anon(("movie_id", "rating"), suppressed), k_anon_sql(("movie_id", "rating"), "held", SUPPRESS_SQL)),
        "k_suppress_rows": (lambda s, d: suppressed(base(s, d)).select(KEY), f"{CTE}{SUPPRESS_SQL} SELECT row_key FROM held"),
        "remove_rare_rows": (lambda s, d: rare_removed(base(s, d)).select(KEY), f"{CTE}{RARE_SQL} SELECT row_key FROM rare"),
        "equivalence_class_sizes": (class_sizes, f"{CTE} SELECT movie_id, rating, COUNT(DISTINCT customer_id) AS k FROM base GROUP BY movie_id, rating"),
        "fact_index": (fact_index, f"{CTE} SELECT DISTINCT movie_id, rating, customer_id FROM base"),
        "release_list": (release_list, RELEASE_LIST_SQL),
        "rating_noise": (rating_noise, f"""{CTE}, x AS (SELECT row_key, rating, {ad.draw(SEED, 'rating-noise', 'row_key')} AS h FROM ratings)
SELECT row_key, CAST(CASE WHEN h < {int(0.125 * TOP)} THEN GREATEST(1, rating - 1) WHEN h >= {TOP - int(0.125 * TOP)} THEN LEAST(5, rating + 1) ELSE rating END AS INT) AS rating FROM x"""),
        "row_noise_rating": _of_noise(rating_p=0.1),
        "row_noise_movie": _of_noise(movie_p=0.1),
        "row_noise_user": _of_noise(user_p=0.1),
        "row_noise_all": _of_noise(rating_p=0.1, movie_p=0.1, user_p=0.1),
        "weighted_noise": _of_noise(rating_p=0.1, movie_p=0.1, weighted=True),
        "latent_sensitive_noise": (latent_sensitive_noise, f"""{CTE}, pop AS (SELECT movie_id, COUNT(*) AS n FROM ratings GROUP BY movie_id), w AS (SELECT movie_id, 1.0E0 - n / CAST(MAX(n) OVER () AS DOUBLE) AS w FROM pop),
e AS (SELECT quantile_cont(w, 0.85) AS edge FROM w), x AS (SELECT b.*, w, edge, {ad.draw(SEED, 'latent-flip', 'row_key')} AS f, {ad.draw(SEED, 'latent-sign', 'row_key')} AS g FROM base b JOIN w USING (movie_id), e)
SELECT row_key, CAST(CASE WHEN f < (0.08E0 + 0.47E0 * w) * {TOP} THEN GREATEST(1, LEAST(5, rating + CASE WHEN g < {TOP // 2} THEN -1 ELSE 1 END)) ELSE rating END AS INT) AS rating,
  CASE WHEN w >= edge THEN CAST(year AS VARCHAR) ELSE month END AS month FROM x"""),
        "candidate_trials": (candidate_trials, f"""{trials_sql()} SELECT 'movie_id + rating' AS knowledge_cols, n_known, CAST(trial AS INT) AS trial, target_user, candidate_count, hit AS true_user_in_candidates, candidate_count = 1 AS "unique", round({SURETY}, 9) AS surety_pct FROM trials"""),
        "candidate_summary": (candidate_summary, f"""{trials_sql()} SELECT 'movie_id + rating' AS knowledge_cols, n_known, round(AVG(candidate_count), 9) AS avg_candidate_size, median(candidate_count) AS median_candidate_size, {pct('candidate_count = 1', 'pct_unique')},
  {pct('candidate_count <= 5', 'pct_5_or_less')}, {pct('candidate_count <= 10', 'pct_10_or_less')}, round(AVG({SURETY}), 9) AS avg_surety_pct, round(median({SURETY}), 9) AS median_surety_pct, COUNT(*) AS trials FROM trials GROUP BY n_known"""),
        "noisy_attack_trials": (noisy_attack_trials, f"{NOISY_SQL} SELECT * FROM flags"),
        "noisy_attack_summary": (noisy_attack_summary, f"""{NOISY_SQL} SELECT knowledge_cols, n_known, COUNT(*) AS trials, round(AVG(candidate_count), 9) AS avg_candidate_size, median(candidate_count) AS median_candidate_size,
  {', '.join(pct('"' + c + '"', 'pct_' + c) for c in ('unique', 'unique_correct', 'unique_wrong', 'less_than_5_candidates', 'less_than_5_correct', 'less_than_5_wrong', 'no_match'))},
  COUNT(*) FILTER ("unique") AS unique_count, COUNT(*) FILTER (less_than_5_candidates) AS less_than_5_count,
  round(COALESCE(COUNT(*) FILTER (unique_wrong) / CAST(NULLIF(COUNT(*) FILTER ("unique"), 0) AS DOUBLE), 0), 9) AS unique_false_positive_rate,
  round(COALESCE(COUNT(*) FILTER (less_than_5_wrong) / CAST(NULLIF(COUNT(*) FILTER (less_than_5_candidates), 0) AS DOUBLE), 0), 9) AS less_than_5_false_positive_rate FROM flags GROUP BY knowledge_cols, n_known"""),
        "risk_by_popularity_bucket": (risk("rarest_bucket"), risk_sql("rarest_bucket")),
        "risk_by_low_rating": (risk("has_low_rating"), risk_sql("has_low_rating")),
        "risk_by_high_rating": (risk("has_high_rating"), risk_sql("has_high_rating")),
        "knowledge_modes": (knowledge_modes, modes_sql()),
        "release_attack_summary": (release_attack_summary, release_attack_sql()),
        "holdout_split": (holdout_split, f"{CTE} SELECT row_key, CASE WHEN {TEST_SQL} THEN 'test' ELSE 'train' END AS side FROM ratings"),
        "exact_split": (exact_split, f"{CTE} SELECT row_key, CASE WHEN row_number() OVER (ORDER BY {ad.draw(SEED, 'exact', KEY)}, row_key) <= round(COUNT(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS side FROM ratings"),
        "holdout_users": (holdout_users, f"{CTE}, u AS (SELECT DISTINCT customer_id FROM ratings) SELECT customer_id FROM u QUALIFY row_number() OVER (ORDER BY {ad.draw(SEED, 'holdout-user', 'customer_id')}, customer_id) <= GREATEST(1, CAST(FLOOR(COUNT(*) OVER () * 0.25) AS BIGINT))"),
        "official_holdout_antijoin": (official_holdout, f"{CTE}, p AS (SELECT DISTINCT movie_id, customer_id FROM ratings WHERE date >= DATE '2000-01-01') SELECT row_key, CASE WHEN p.movie_id IS NULL THEN 'train' ELSE 'test' END AS side FROM ratings r LEFT JOIN p ON p.movie_id = r.movie_id AND p.customer_id = r.customer_id"),
        "bias_predictions": (bias_predictions, f"{BIAS_SQL} SELECT row_key, round(prediction, 6) AS prediction FROM pred"),
        "metrics_rmse_mae_within1": (bias_metrics, f"{BIAS_SQL} SELECT {METRICS_SQL} FROM pred"),
        "global_mean_baseline": (global_mean, f"{BIAS_SQL} SELECT {METRICS_SQL} FROM (SELECT rating, m AS prediction FROM test, mu)"),
        "release_rmse_summary": (release_rmse, release_rmse_sql()),
        "match_exact_year": (match_exact_year, f"{EXACT_SQL} SELECT imdb_title, imdb_year, imdb_rating, netflix_movie_id FROM exact_ WHERE netflix_movie_id IS NOT NULL"),
        "match_unique_title": (match_unique_title, f"""{MATCH_SQL}, alone AS (SELECT norm, MAX(movie_id) AS id FROM norm_t GROUP BY norm HAVING COUNT(DISTINCT movie_id) = 1)
SELECT p.title AS imdb_title, CAST(p.year + 1000 AS INT) AS imdb_year, p.rating AS imdb_rating, COALESCE(a.id, -1) AS netflix_movie_id, CASE WHEN a.id IS NULL THEN 'unmatched' ELSE 'unique_title' END AS match_method FROM norm_p p LEFT JOIN alone a USING (norm)"""),
        "match_fuzzy": (match_fuzzy, None),
        "linkage_facts": (linkage_facts, f"{FACTS_SQL} SELECT netflix_movie_id, round(imdb_rating, 9) AS imdb_rating, round(e, 9) AS expected_netflix_rating, lo AS rating_low, hi AS rating_high, 'exact_title_year' AS match_method, 1.0E0 AS match_score FROM facts"),
        "linkage_candidates": (linkage_candidates, CANDIDATES_SQL),
        "qi_join": (qi_join, f"WITH {ad.PEOPLE} SELECT a.c_name, a.nation, a.segment, a.band, round(b.c_acctbal, 2) AS balance FROM people a JOIN people b USING (nation, segment, band)"),
        "qi_powerset_reid": (qi_powerset, powerset_sql()),
        "match_count_hist": (match_count_hist, f"WITH {ad.PEOPLE} SELECT matches, COUNT(*) AS people FROM (SELECT COUNT(*) OVER (PARTITION BY nation, segment) AS matches FROM people) GROUP BY matches"),
        "full_row_classes": (full_row_classes, f"WITH {ad.PEOPLE}, s AS (SELECT COUNT(*) AS n FROM people GROUP BY nation, segment, band) SELECT COUNT(*) AS classes, MAX(n) AS max_size, MIN(n) AS min_size, round(AVG(n), 9) AS mean_size FROM s"),
        "small_group_means": (small_group_means, f"WITH {ad.PEOPLE} SELECT nation, segment, band, COUNT(*) AS people, round(AVG(c_acctbal), 6) AS mean, COUNT(*) = 1 AS exposed FROM people GROUP BY nation, segment, band"),
        "differencing_attack": (differencing, f"WITH {ad.PEOPLE} SELECT round(SUM(c_acctbal), 4) AS sum_all, round(SUM(CASE WHEN c_name = 'Customer#000000007' THEN 0 ELSE c_acctbal END), 4) AS sum_without, round(SUM(c_acctbal) - SUM(CASE WHEN c_name = 'Customer#000000007' THEN 0 ELSE c_acctbal END), 4) AS revealed FROM people"),
        "inferred_share": (inferred_share, f"WITH {ad.PEOPLE} SELECT a.c_name, a.nation, COUNT(*) AS matches, round(AVG(CASE WHEN b.c_acctbal < 0 THEN 1.0E0 ELSE 0.0E0 END), 9) AS share FROM people a JOIN people b USING (nation) GROUP BY a.c_name, a.nation"),
        "popularity_quartile": (popularity_quartile, f"""{CTE}, pop AS (SELECT movie_id, COUNT(DISTINCT customer_id) AS popularity FROM base GROUP BY movie_id), ranked AS (SELECT *, row_number() OVER (ORDER BY popularity, movie_id) AS rk, COUNT(*) OVER () AS n FROM pop)
SELECT movie_id, popularity, CASE WHEN rk <= 1 + (n - 1) * 0.25E0 THEN 'rare' WHEN rk <= 1 + (n - 1) * 0.5E0 THEN 'less_common' WHEN rk <= 1 + (n - 1) * 0.75E0 THEN 'common' ELSE 'popular' END AS bucket FROM ranked"""),
        "pct_rank_weight": (pct_rank_weight, f"""{CTE}, x AS (SELECT movie_id, COUNT(*) AS c, sqrt(SUM(rating * rating)) / sqrt(COUNT(*)) AS l FROM ratings GROUP BY movie_id),
y AS (SELECT movie_id, (rank() OVER (ORDER BY c) + (COUNT(*) OVER (PARTITION BY c) - 1) / 2.0E0) / COUNT(*) OVER () AS p, (rank() OVER (ORDER BY l) + (COUNT(*) OVER (PARTITION BY l) - 1) / 2.0E0) / COUNT(*) OVER () AS v FROM x)
SELECT movie_id, round(p, 6) AS popularity_pct, round(v, 6) AS leverage_pct, round(0.65E0 * v + 0.35E0 * (1 - p) + 1e-9, 6) AS privacy_weight FROM y"""),
        "item_knn_neighbors": (item_knn_neighbors, f"{KNN_SQL} SELECT movie_id, neighbour, round(sim, 6) AS sim FROM near"),
        "item_knn_predict": (item_knn_predict, KNN_PREDICT_SQL),
        "profile_nn_attack": (profile_nn_attack, f"""{NN_SQL}, f AS (SELECT profile, bool_or(candidate = profile AND rk = 1) AS a, bool_or(candidate = profile AND rk <= 10) AS b, MAX(CASE WHEN rk <= 10 THEN sim END) AS s FROM ranked GROUP BY profile)
SELECT customer_id AS profile, COALESCE(a, false) AS top1_hit, COALESCE(b, false) AS topk_hit, round(COALESCE(s, 0), 6) AS best_similarity FROM users LEFT JOIN f ON f.profile = customer_id"""),
        "membership_features": (membership, MEMBER_SQL),
        "membership_auc": (membership_auc, None),
        "js_divergence": (js, JS_SQL),
        "dataset_profile": (dataset_profile, f"""{CTE} SELECT COUNT(*) AS rows, COUNT(DISTINCT customer_id) AS users, COUNT(DISTINCT movie_id) AS movies, COUNT(DISTINCT month) AS months, round(AVG(rating), 9) AS mean_rating,
  (SELECT median(n) FROM (SELECT COUNT(*) AS n FROM base GROUP BY customer_id)) AS median_history, (SELECT median(n) FROM (SELECT COUNT(DISTINCT customer_id) AS n FROM base GROUP BY movie_id)) AS median_popularity FROM base"""),
        "rating_histogram": (rating_histogram, f"{CTE} SELECT rating AS value, round(COUNT(*) / CAST((SELECT COUNT(*) FROM ratings) AS DOUBLE), 9) AS share FROM ratings GROUP BY rating"),
        "clipped_histories": (clipped_histories, f"{CTE}, h AS (SELECT customer_id, COUNT(*) AS n FROM ratings GROUP BY customer_id) SELECT customer_id, round(LEAST(CAST(n AS DOUBLE), (SELECT quantile_cont(n, 0.99) FROM h)), 9) AS history FROM h"),
        "synthetic_release": (synthetic, None),
        "als_predict": (als_predict, None),
        "als_factor_diagnostics": (als_factors, None),
        "utility_sweep": (sweep, SWEEP_SQL),
        "privacy_utility_frontier": (privacy_utility, frontier_sql()),
        "tabular_classifier": (text_classifier, None),
        "header_block_source": (header_block_source, f"{CTE} SELECT CAST(movie_id AS INT) AS movie_id, CAST(customer_id AS INT) AS customer_id, CAST(rating AS TINYINT) AS rating, CAST(date AS VARCHAR) AS date FROM ratings"),
        "titles_source": (titles_source, f"WITH {ad.TITLES} SELECT CAST(movie_id AS INT) AS movie_id, CASE WHEN movie_id % 7 = 0 THEN -1 ELSE year END AS year, title || ', the film' AS title FROM titles"),
        "synthetic_checks": (synthetic_checks, None),
        "train_on_synthetic": (train_on_synthetic, None),
        "raw_als_metrics": (raw_als, None),
        "multi_model_sweep": (multi_model, None),
        "scorecard": (scorecard, None),
        "html_rating_extract": (html_ratings, "SELECT p_partkey, p_name AS title, CAST(1950 + p_size AS INT) AS year, CAST(1 + p_size % 10 AS DOUBLE) AS rating FROM part"),
    }
    for name, cols in K_ANON.items():
        out[f"fact_k_anonymity_{name}"] = (k_anon(cols), k_anon_sql(cols))
    from veilframe.plans import catalog_more

    return out | catalog_more.entries()


def queries() -> dict:
    return {name: q for name, (q, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
