"""Further registered queries: files written and read back, releases and reports, splits, checks, and models of all releases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import features as fx
from veilframe.operators import bias, fidelity, k_anonymity, neighbours, releases, synthetic
from veilframe.plans import adapters as ad
from veilframe.plans import report
from veilframe.plans.catalog import CTE, KEY, RARE, RELEASES, SEED, _folder, _release_tables, base, rounded, table10
from veilframe.session import checkpointed, discarded


# --- files --------------------------------------------------------------------------------------------------------------
def pairs_source(spark, d):
    """Header-block files with bare customers, written and read back."""
    from veilframe.sources.header_block import read_pairs

    path = _folder(spark)
    held = ad.ratings(spark, d).where(F.col("rating") == 5).groupBy("movie_id").agg(F.array_join(F.collect_set(F.col("customer_id").cast("string")), "\n").alias("lines"))
    held.select(F.concat(F.col("movie_id").cast("string"), F.lit(":\n"), "lines").alias("value")).repartition(3, "value").write.text(path)
    return read_pairs(spark, path)


def filtered_source(spark, d):
    """Ratings of some movies without dates, less the pairs that are held out."""
    from veilframe.sources.header_block import read_ratings

    path, r = _folder(spark), ad.ratings(spark, d)
    blocks = r.groupBy("movie_id").agg(F.array_join(F.collect_list(F.concat_ws(",", "customer_id", "rating", "date")), "\n").alias("lines"))
    blocks.select(F.concat(F.col("movie_id").cast("string"), F.lit(":\n"), "lines").alias("value")).repartition(2, "value").write.text(path)
    out = r.where(F.col("rating") == 5).select(F.col("movie_id").cast("int"), F.col("customer_id").cast("int")).distinct()
    return read_ratings(spark, path, movie_ids=range(1, 101), exclude_pairs=out, include_date=False)


def profile_source(spark, d):
    from veilframe.sources.tables import read_profile

    path = _folder(spark)
    held = ad.profile(spark, d).select(F.lit("7").alias("Unnamed: 0"), "title", F.concat(F.lit("("), F.col("year").cast("string"), F.lit(")")).alias("year"), "user", "rating")
    held.write.csv(path, header=True)
    return read_profile(spark, path)


def census_source(spark, d):
    """A table with blanks after commas, `?` for null and a full stop after labels."""
    from veilframe.sources.tables import names_schema, read_census

    path = _folder(spark)
    label = F.concat(F.when(F.col("c_acctbal") > 5000, ">50K").otherwise("<=50K"), F.lit("."))
    segment = F.when(F.col("nation") == 0, "?").otherwise(F.col("segment"))
    ad.people(spark, d).select(F.concat_ws(", ", F.col("nation").cast("string"), segment, label)).write.text(path)
    return read_census(spark, path, names_schema("nation: continuous.\nsegment: BUILDING, MACHINERY.\n"))


def people_source(spark, d):
    from veilframe.sources.tables import read_people

    path = _folder(spark)
    ad.people(spark, d).select("c_name", F.lpad(F.col("nation").cast("string"), 5, "0").alias("Zip"), "band").write.csv(path, header=True)
    return read_people(spark, path)


def exported_ratings(spark, d):
    from veilframe.sources.header_block import export_ratings

    path = _folder(spark)
    export_ratings(ad.ratings(spark, d), ad.titles(spark, d).where("year < 1960"), path)
    return spark.read.csv(path, header=True).select(KEY, F.col("rating").cast("int").alias("rating"))


def list_item_pages(spark, d):
    from veilframe.sources.html_ratings import ITEM_CLASS, extract_ratings

    item = F.concat(
        F.lit(f'<ul><li class="x {ITEM_CLASS}"><h3>1. '), "p_name", F.lit("</h3><span>"), (1950 + F.col("p_size")).cast("string"),
        F.lit('</span><span class="ipc-rating-star--rating">'), (1 + F.col("p_size") % 10).cast("string"), F.lit("</span></li></ul>"),
    )
    pages = ad.table(spark, d, "part").select("p_partkey", item.alias("html"))
    return extract_ratings(pages).select("p_partkey", "title", "year", "rating")


def report_file(spark, d):
    """A summary written as one CSV file and read back, and the same through the cache."""
    path = _folder(spark)
    made = fidelity.histogram(ad.ratings(spark, d), "rating")
    report.write_all(path, histogram=made)
    csv = spark.read.csv(f"{path}/histogram.csv", header=True).select(F.col("value").cast("int").alias("value"), F.col("share").cast("double").alias("share"))
    kept = reduce(lambda _, __: report.cached(spark, f"{path}/kept", lambda: made), range(2), None)
    return rounded(csv.join(kept.select("value", F.col("share").alias("cached_share")), "value"))


# --- releases and reports -------------------------------------------------------------------------------------------------
SIX = {"coarsen_rating": "coarsen_rating_to_preference", f"remove_rare_movies_min_{RARE}": "remove_rare_movies_min_500_users"}


def six_releases(spark, d):
    got = releases.six_releases(ad.ratings(spark, d), SEED)
    return reduce(DataFrame.unionByName, [r.data.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(r.name).alias("release_name"), F.lit(" + ".join(r.knowledge_cols)).alias("knowledge_cols"), "rows") for r in got])


def six_sql():
    rows = []
    for name, at, cols, _ in RELEASES:
        if name in ("original_movie_rating_month", "remove_month", "year_only", "movie_only", *SIX):
            at = "rare500" if at == "rare_" else at.format("base")
            rows.append(f"SELECT '{SIX.get(name, name)}' AS release_name, '{' + '.join(cols)}' AS knowledge_cols, COUNT(*) AS rows FROM {at}")
    return f"""{CTE}, rare500 AS (SELECT * FROM base WHERE movie_id IN (SELECT movie_id FROM base GROUP BY movie_id HAVING COUNT(DISTINCT customer_id) >= 500)) {' UNION ALL '.join(rows)}"""


def release_table(spark, d):
    """k-anonymity of all releases, with their labels in order."""
    got = releases.make_releases(ad.ratings(spark, d), SEED, RARE, 5, ("movie_id", "rating"))
    k = reduce(DataFrame.unionByName, [k_anonymity.release_k_anonymity(r) for r in got])
    return rounded(report.version_tagged(report.presented(k)).select("release_name", "label", "knowledge_cols", "rows_released", "fact_count", "min_k", "median_k", "mean_k", "pct_unique_facts", "dataset_version"))


def release_table_sql():
    label = report.LABELS | {f"remove_rare_movies_min_{RARE}": f"No rare movies, users >= {RARE}", "k_suppress_movie_rating_month_k5": "Suppressed, k >= 5"}
    rows = []
    for name, at, cols, _ in RELEASES:
        at, c = at.format("base"), ", ".join(cols)
        rows.append(f"""SELECT '{name}' AS release_name, '{label[name]}' AS label, '{' + '.join(cols)}' AS knowledge_cols, (SELECT COUNT(*) FROM {at}) AS rows_released, COUNT(*) AS fact_count, MIN(k) AS min_k, round(median(k), 9) AS median_k, round(AVG(k), 9) AS mean_k,
  round(AVG(CASE WHEN k = 1 THEN 1.0E0 ELSE 0.0E0 END) * 100, 9) AS pct_unique_facts, 'original_non_anonymized' AS dataset_version FROM (SELECT COUNT(DISTINCT customer_id) AS k FROM {at} GROUP BY {c})""")
    return f"{CTE}, {_release_tables('base')} {' UNION ALL '.join(rows)}"


def year_pivot(spark, d):
    sizes = base(spark, d).groupBy("year", "rating_bucket").agg(F.count(F.lit(1)).alias("n"))
    return report.pivoted(sizes, "year", "rating_bucket", "n").na.fill(0)


def summary_table(spark, d):
    got = k_anonymity.summary_statistics(ad.ratings(spark, d), ["rating"])
    return rounded(got.select("summary", F.col("rating").cast("double").alias("rating")), 6)


# --- functions, splits, checks --------------------------------------------------------------------------------------------
def legacy_bounds(spark, d):
    low, high = fx.legacy_star_bounds(F.col("ten"))
    return table10(spark, d).select("ten", low.alias("low"), high.alias("high"))


def stratified(spark, d):
    train, test = bias.stratified_split(ad.people(spark, d), "segment", "c_name", 0.7, SEED)
    return train.select("c_name", F.lit("train").alias("side")).union(test.select("c_name", F.lit("test").alias("side")))


def sampled_rows(spark, d):
    return bias.sampled(ad.ratings(spark, d), 10_000, SEED).select(KEY)


def capped_holdout(spark, d):
    r = ad.ratings(spark, d)
    pairs = r.where(F.col("date") >= F.lit("2000-01-01").cast("date")).select("movie_id", "customer_id").distinct()
    train, test = bias.official_holdout(r, pairs, 20_000, 500, ["movie_id", "customer_id", KEY])
    return train.select(KEY, F.lit("train").alias("side")).union(test.select(KEY, F.lit("test").alias("side")))


def post_processing(spark, d):
    """Synthetic rows as text, some out of range or of movies that don't exist."""
    raw = base(spark, d).select(KEY, (F.col("movie_id") * 2).cast("double").cast("string").alias("movie_id"), (F.col("rating") * 1.7 - 1).cast("string").alias("rating"), "month")
    return synthetic.post_processed(raw, ad.ratings(spark, d)).select(KEY, "movie_id", "rating", "date")


def release_checks(spark, d):
    """The checks of synthetic rows, on rows whose movies and ratings were moved."""
    b = base(spark, d)
    moved = b.withColumn("movie_id", F.col("movie_id") * 2).withColumn("rating", F.col("rating") + 1)
    return rounded(fidelity.synthetic_checks(moved, b, key=KEY))


# --- models that SQL can't express ------------------------------------------------------------------------------------------
def release_membership(spark, d):
    inside, members, others = (checkpointed(x) for x in neighbours.membership_sets(checkpointed(ad.ratings(spark, d).drop("date")), 60, 6, 0.25, SEED))
    made = releases.make_releases(inside, SEED, RARE, 5, ("movie_id", "rating"))
    return neighbours.release_membership(made, members, others).select("release_name", F.round("auc", 6).alias("auc"), F.round("accuracy", 6).alias("accuracy"), "rows")


def neighbour_risk(r: DataFrame) -> DataFrame:
    """(release_name, top1_pct, topk_pct) of the nearest-neighbour attack on each release that has ratings; releases with the same table
    and label share one."""
    profiles = checkpointed(neighbours.sample_profiles(r, 50, 6, SEED))
    share = lambda c: (F.avg(F.col(c).cast("double")) * 100).alias(c.replace("hit", "pct"))
    rows, found = [], {}
    for x in releases.make_releases(r, SEED, RARE, 5, ("movie_id", "rating")):
        if x.rating_col is None:
            continue
        key = (id(x.data), x.rating_col)
        if key not in found:
            held = checkpointed(x.data.select("customer_id", "movie_id", x.rating_col))
            found[key] = checkpointed(neighbours.nearest_neighbor_attack(profiles, held, rating_col=x.rating_col).agg(share("top1_hit"), share("topk_hit")))
            discarded(held)
        rows.append(found[key].withColumn("release_name", F.lit(x.name)))
    return reduce(DataFrame.unionByName, rows)


def entries() -> dict:
    """name -> (query, SQL or None)."""
    draw = ad.draw
    return {
        "pairs_source": (pairs_source, f"{CTE} SELECT DISTINCT CAST(movie_id AS INT) AS movie_id, CAST(customer_id AS INT) AS customer_id FROM ratings WHERE rating = 5"),
        "filtered_source": (filtered_source, f"{CTE} SELECT CAST(movie_id AS INT) AS movie_id, CAST(customer_id AS INT) AS customer_id, CAST(rating AS TINYINT) AS rating FROM ratings r WHERE movie_id BETWEEN 1 AND 100 AND NOT EXISTS (SELECT 1 FROM ratings o WHERE o.rating = 5 AND o.movie_id = r.movie_id AND o.customer_id = r.customer_id)"),
        "profile_source": (profile_source, f"WITH {ad.RATINGS}, {ad.TITLES}, {ad.PROFILE} SELECT title, year, user, rating FROM profile"),
        "census_source": (census_source, f"WITH {ad.PEOPLE} SELECT CAST(nation AS DOUBLE) AS nation, CASE WHEN nation = 0 THEN NULL ELSE segment END AS segment, CASE WHEN c_acctbal > 5000 THEN '>50K' ELSE '<=50K' END AS label FROM people"),
        "people_source": (people_source, f"WITH {ad.PEOPLE} SELECT c_name, lpad(CAST(nation AS VARCHAR), 5, '0') AS Zip, CAST(band AS INT) AS band FROM people"),
        "exported_ratings": (exported_ratings, f"{CTE}, {ad.TITLES} SELECT row_key, rating FROM ratings WHERE movie_id IN (SELECT movie_id FROM titles WHERE year < 1960)"),
        "list_item_pages": (list_item_pages, "SELECT p_partkey, p_name AS title, CAST(1950 + p_size AS INT) AS year, CAST(1 + p_size % 10 AS DOUBLE) AS rating FROM part"),
        "report_file": (report_file, f"{CTE}, h AS (SELECT rating AS value, round(COUNT(*) / CAST((SELECT COUNT(*) FROM ratings) AS DOUBLE), 9) AS share FROM ratings GROUP BY rating) SELECT value, share, share AS cached_share FROM h"),
        "six_releases": (six_releases, six_sql()),
        "release_table": (release_table, release_table_sql()),
        "year_pivot": (year_pivot, f"{CTE} SELECT year, COUNT(*) FILTER (rating_bucket = 'disliked') AS disliked, COUNT(*) FILTER (rating_bucket = 'liked') AS liked, COUNT(*) FILTER (rating_bucket = 'neutral') AS neutral FROM base GROUP BY year"),
        "summary_table": (summary_table, f"""{CTE}, s AS (SELECT COUNT(rating) AS n, AVG(rating) AS m, stddev_samp(rating) AS sd, MIN(rating) AS lo, quantile_disc(rating, 0.5) AS mid, MAX(rating) AS hi FROM ratings)
SELECT unnest(['count', 'mean', 'stddev', 'min', '50%', 'max']) AS summary, round(unnest([CAST(n AS DOUBLE), m, sd, lo, mid, hi]), 6) AS rating FROM s"""),
        "legacy_bounds": (legacy_bounds, "WITH t AS (SELECT DISTINCT l_quantity / 5 AS ten FROM lineitem) SELECT ten, CAST(floor(ten / 2) AS INT) AS low, CAST(floor(ten / 2) + CASE WHEN ten % 2 <> 0 THEN 1 ELSE 0 END AS INT) AS high FROM t"),
        "stratified_split": (stratified, f"WITH {ad.PEOPLE} SELECT c_name, CASE WHEN row_number() OVER (PARTITION BY segment ORDER BY {draw(SEED, 'strata', 'c_name')}, c_name) <= round(COUNT(*) OVER (PARTITION BY segment) * 0.7E0) THEN 'train' ELSE 'test' END AS side FROM people"),
        "sampled_rows": (sampled_rows, f"{CTE} SELECT row_key FROM ratings ORDER BY {draw(SEED, 'sample', KEY)}, row_key LIMIT 10000"),
        "capped_holdout": (capped_holdout, f"""{CTE}, p AS (SELECT DISTINCT movie_id, customer_id FROM ratings WHERE date >= DATE '2000-01-01'), s AS (SELECT r.*, CASE WHEN p.movie_id IS NULL THEN 'train' ELSE 'test' END AS side FROM ratings r LEFT JOIN p USING (movie_id, customer_id))
SELECT row_key, side FROM s QUALIFY row_number() OVER (PARTITION BY side ORDER BY movie_id, customer_id, row_key) <= CASE WHEN side = 'train' THEN 20000 ELSE 500 END"""),
        "post_processing": (post_processing, f"{CTE} SELECT row_key, CAST(movie_id * 2 AS INT) AS movie_id, CAST(GREATEST(1, LEAST(5, round(rating * 1.7E0 - 1))) AS INT) AS rating, month || '-15' AS date FROM base WHERE movie_id * 2 IN (SELECT movie_id FROM ratings)"),
        "release_checks": (release_checks, f"""{CTE}, n AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM base) SELECT 'in_range' AS "check", 'rating' AS "column", round((SELECT COUNT(*) FROM base WHERE rating + 1 BETWEEN (SELECT MIN(rating) FROM base) AND (SELECT MAX(rating) FROM base)) / n, 9) AS share FROM n
UNION ALL SELECT 'known_value', 'movie_id', round((SELECT COUNT(*) FROM base WHERE movie_id * 2 IN (SELECT movie_id FROM base)) / n, 9) FROM n UNION ALL SELECT 'known_value', 'month', 1.0E0 FROM n UNION ALL SELECT 'unique_key', 'row_key', 1.0E0 FROM n"""),
        "release_membership": (release_membership, None),
    }
