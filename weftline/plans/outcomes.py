"""Queries of variant scores and statistics of predictions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import matrix, scores
from weftline.plans.basics import query
from weftline.plans.biology import ROLL, table


@query("WITH l AS (SELECT vec_id // 8 AS seq, label, embedding[label + 1]::DOUBLE - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) AS p FROM embeddings) SELECT seq, count(*) FILTER (label <> 9) AS tokens, round(avg(p) FILTER (label <> 9), 6) AS fitness FROM l GROUP BY seq")
def t03_fitness(spark, sf_dir):
    """Mean log-likelihood of sequences; label 9 is padding."""
    t = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("seq"), "label", scores.log_probability(F.col("embedding"), F.col("label")).alias("p"))
    return scores.fitness(t, "seq", "p", F.col("label") != 9).withColumn("fitness", F.round("fitness", 6))


@query("SELECT vec_id, round(embedding[label + 1]::DOUBLE - embedding[(vec_id % 64)::INT + 1]::DOUBLE, 9) AS ratio FROM embeddings")
def t04_likelihood_ratio(spark, sf_dir):
    """Reference less alternate log-likelihood at the variant's place."""
    r = scores.likelihood_ratio(F.col("embedding"), F.col("label"), (F.col("vec_id") % 64).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(r, 9).alias("ratio"))


@query("WITH s AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 11 > 0) SELECT c.c_name AS name, 'Customer#' || lpad((c.c_custkey // 2)::VARCHAR, 9, '0') AS ref, round(a.c_acctbal - b.c_acctbal, 6) AS delta FROM customer c LEFT JOIN s a ON a.c_custkey = c.c_custkey LEFT JOIN s b ON b.c_custkey = c.c_custkey // 2")
def t11_k15_delta_scores(spark, sf_dir):
    """A variant's score less its reference's, through names and their places."""
    c = table(spark, sf_dir, "customer")
    places = matrix.dense_index(c.select(F.col("c_name").alias("name"), "c_custkey"), "c_custkey").join(c.select("c_custkey", F.col("c_name").alias("name")), "c_custkey").select("name", F.col("row_index").alias("place"))
    s = matrix.dense_index(c, "c_custkey").join(c.filter("c_custkey % 11 > 0").select("c_custkey", "c_acctbal"), "c_custkey").select(F.col("row_index").alias("place"), "c_acctbal")
    v = c.select(F.col("c_name").alias("name"), F.concat(F.lit("Customer#"), F.lpad(F.floor(F.col("c_custkey") / 2).cast("string"), 9, "0")).alias("ref"))
    return scores.delta_scores(v, places, s, "name", "ref", "place", "c_acctbal").select("name", "ref", F.round("delta", 6).alias("delta"))


@query("""WITH x AS (SELECT lang, n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0::DOUBLE AS r FROM x), t AS (SELECT lang, sum(n::DOUBLE * (n * n - 1)) AS ties FROM (SELECT lang, s, count(*) AS n FROM x GROUP BY ALL) GROUP BY lang),
a AS (SELECT lang, sum(y)::BIGINT AS n1, (count(*) - sum(y))::BIGINT AS n0, sum(CASE WHEN y = 1 THEN r END) AS rs FROM r GROUP BY lang), u AS (SELECT a.lang, n1, n0, rs - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1 + n0 AS n, ties FROM a JOIN t ON t.lang IS NOT DISTINCT FROM a.lang),
z AS (SELECT *, CASE WHEN n1 > 0 AND n0 > 0 THEN (greatest(u, n1 * n0 - u) - n1 * n0 / 2.0::DOUBLE - 0.5::DOUBLE) / sqrt(n1 * n0 / 12.0::DOUBLE * (n + 1 - ties / (n * (n - 1)))) END AS z FROM u),
e AS (SELECT *, CASE WHEN z > 0 THEN 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 150), lambda k: exp(k * ln(2) + (2 * k + 1) * ln(z / sqrt(2)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))) WHEN z <= 0 THEN 1 END AS p FROM z)
SELECT lang, n1, n0, CASE WHEN n1 > 0 AND n0 > 0 THEN u END AS u, round(z, 6) AS z, round(p, 6) AS p FROM e""")
def t06_mann_whitney(spark, sf_dir):
    """U and its p-value per language."""
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return scores.mann_whitney(t, "n_chars", "quality", "lang").withColumns({"z": F.round("z", 6), "p": F.round("p", 6)})


@query("""WITH o AS (SELECT *, round(o_totalprice * 100)::BIGINT AS price, o_orderkey % 1000 AS other FROM orders),
side AS (SELECT m.model, c.*, y, o_custkey, sum(CASE m.model WHEN 'price' THEN price ELSE other END)::DOUBLE / count(*) AS s
  FROM o, (VALUES ('price'), ('other')) m(model), (VALUES ('URGENT', 'LOW'), ('HIGH', 'LOW|MEDIUM')) c("case", control), (VALUES (1), (0)) l(y)
  WHERE regexp_matches(o_orderpriority, CASE y WHEN 1 THEN "case" ELSE control END) GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY model, "case" ORDER BY s) + (count(*) OVER (PARTITION BY model, "case", s) - 1) / 2.0::DOUBLE AS r FROM side),
t AS (SELECT model, "case", sum(n::DOUBLE * (n * n - 1)) AS ties FROM (SELECT model, "case", s, count(*) AS n FROM side GROUP BY ALL) GROUP BY ALL),
u AS (SELECT model, "case", control, sum(y)::BIGINT AS n_case, (count(*) - sum(y))::BIGINT AS n_control, sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE AS u FROM r GROUP BY ALL)
SELECT model, "case", control, n_case, n_control, round(u, 3) AS u, round((greatest(u, n_case * n_control - u) - n_case * n_control / 2.0::DOUBLE - 0.5::DOUBLE) / sqrt(n_case * n_control / 12.0::DOUBLE * (n_case + n_control + 1 - ties / ((n_case + n_control) * (n_case + n_control - 1.0::DOUBLE)))), 6) AS z FROM u JOIN t USING (model, "case")""")
def t06_comparisons(spark, sf_dir):
    """Two scores of customers' orders, each tested between listed kinds after a mean per customer."""
    t = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("price"), (F.col("o_orderkey") % 1000).alias("other"))
    t = scores.comparison_tests(t, "o_custkey", "o_orderpriority", ["price", "other"], [("URGENT", "LOW"), ("HIGH", "LOW|MEDIUM")])
    return t.select("model", "case", "control", "n_case", "n_control", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"))


FOLDS = f"f AS (SELECT c_nationkey AS fold, c_acctbal AS y, c_acctbal * 0.8::DOUBLE + 1000 * {ROLL.format(seed=12, key='c_custkey')} AS g FROM customer), r AS (SELECT fold, count(*) AS n, avg((y - g) * (y - g)) AS mse, 1 - avg((y - g) * (y - g)) / var_pop(y) AS r2, corr(y, g) AS pearson FROM f GROUP BY fold)"


def folds(spark, sf_dir):
    from weftline.operators.sampling import roll

    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("fold"), F.col("c_acctbal").alias("y"), (F.col("c_acctbal") * 0.8 + 1000 * roll(F.col("c_custkey"), 12)).alias("g"))
    return scores.regression(t, "y", "g", "fold")


@query(f"WITH {FOLDS} SELECT fold, n, round(mse, 3) AS mse, round(r2, 6) AS r2, round(pearson, 6) AS pearson FROM r")
def t07_regression(spark, sf_dir):
    """Errors, R2 and correlation of predictions in each fold."""
    return folds(spark, sf_dir).withColumns({"mse": F.round("mse", 3), "r2": F.round("r2", 6), "pearson": F.round("pearson", 6)})


@query(f"WITH {FOLDS} SELECT 'r2' AS metric, round(avg(r2), 6) AS mean, round(stddev_pop(r2), 6) AS std FROM r UNION ALL SELECT 'pearson', round(avg(pearson), 6), round(stddev_pop(pearson), 6) FROM r")
def t07_over_folds(spark, sf_dir):
    """Mean and deviation over the folds."""
    return scores.over_folds(folds(spark, sf_dir), "r2", "pearson").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query()
def t09_forest_search(spark, sf_dir):
    """Forests of several depths on the vectors, with given folds."""
    t = table(spark, sf_dir, "embeddings").withColumn("fold", F.col("vec_id") % 3)
    return scores.forest_search(t, "embedding", "label", "fold", 3, {"numTrees": [5], "maxDepth": [2, 4]})
