"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordered import running


def counted_below(df: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """``group, score, p, n, p_to, n_to``: rows (``n``) and positives (``p``) of each distinct score, and how many have that score or a lower one. Distinct
    scores are dealt by ranges of (group, score), so a group of all rows is ranked by many tasks."""
    t = df.groupBy(group, score).agg(F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("p"), F.count("*").alias("n"))
    return running(t, [group], [score], {"p_to": F.col("p"), "n_to": F.col("n")})


def rank_auc(df: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """ROC AUC per group from rank sums over distinct scores (ties count half); null without both classes."""
    t = counted_below(df, score, label, group)
    ranks2 = F.col("p").cast("decimal(20,0)") * (2 * F.col("n_to") - F.col("n") + 1)
    t = t.groupBy(group).agg(F.sum(ranks2).cast("double").alias("ranks2"), F.sum("p").alias("n1"), F.sum(F.col("n") - F.col("p")).alias("n0"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    return t.select(group, "n1", "n0", F.when((n1 > 0) & (n0 > 0), (F.col("ranks2") - n1 * (n1 + 1)) / (2 * n1 * n0)).alias("auc"))


def reconstruction(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean squared error over all elements of two vector columns, and its share of the variance of ``a``."""
    t = df.select(F.explode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("z")).select(F.col("z.a").cast("double").alias("a"), F.col("z.b").cast("double").alias("b"))
    return t.agg(F.avg((F.col("a") - F.col("b")) ** 2).alias("mse"), F.var_pop("a").alias("variance")).withColumn("explained", 1 - F.col("mse") / F.col("variance"))


def average_ranks(df: DataFrame, value: str, group: str, out: str) -> DataFrame:
    """``group, value, out``: the mean rank of each distinct value, from counts of distinct values."""
    t = running(df.groupBy(group, value).agg(F.count("*").alias("_n")), [group], [value], {"_to": F.col("_n")})
    return t.select(group, value, (F.col("_to") - (F.col("_n") - 1) / 2).alias(out))


def spearman(df: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """Rank correlation per group; ties take their mean rank, rows with a null stay out."""
    t = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(group, a, b)
    for value, rank in ((a, "_a"), (b, "_b")):
        ranks = average_ranks(t.select(F.col(group).alias("_g"), F.col(value).alias("_v")), "_v", "_g", rank)
        t = t.join(ranks, F.col(group).eqNullSafe(F.col("_g")) & (F.col(value) == F.col("_v"))).drop("_g", "_v")
    return t.groupBy(group).agg(F.corr("_a", "_b").alias("spearman"))


def pr_auc(df: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """Area under the precision-recall curve per group by trapezoids over distinct scores, from (recall 0, precision 1);
    null without a positive."""
    t = counted_below(df, score, label, group)
    totals = t.groupBy(F.col(group).alias("_g")).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    t = t.join(totals, F.col(group).eqNullSafe(F.col("_g")))
    above_p, above_n = F.col("all_p") - F.col("p_to"), F.col("all_n") - F.col("n_to")
    before = F.when(above_n > 0, above_p / above_n).otherwise(1.0)
    area = F.col("p") * ((above_p + F.col("p")) / (above_n + F.col("n")) + before) / 2
    return t.groupBy(group).agg(F.when(F.max("all_p") > 0, F.sum(area) / F.max("all_p")).alias("pr_auc"))


def log_probability(logits: Column, target: Column) -> Column:
    """The log-softmax of an array of logits at the zero-based ``target``, in one pass with a running maximum."""
    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("sum"))

    def add(s: Column, v: Column) -> Column:
        top = F.greatest(s["top"], v.cast("double"))
        return F.struct(top.alias("top"), (s["sum"] * F.exp(s["top"] - top) + F.exp(v.cast("double") - top)).alias("sum"))

    return F.get(logits, target).cast("double") - F.aggregate(logits, start, add, lambda s: s["top"] + F.log(s["sum"]))


def token_losses(df: DataFrame, group: str, logp: str) -> DataFrame:
    """``group, tokens, cross_entropy, perplexity`` of token log-probabilities; nulls are masked tokens."""
    t = df.groupBy(group).agg(F.count(logp).alias("tokens"), F.avg(-F.col(logp)).alias("cross_entropy"))
    return t.withColumn("perplexity", F.exp("cross_entropy"))


def loss_recovered(original: Column, patched: Column, zeroed: Column) -> Column:
    """The share of a loss gap that a patched run wins back."""
    return 1 - (patched - original) / (zeroed - original + 1e-8)


def token_accuracy(df: DataFrame, logits: str, label: str, ignored: int = -100) -> DataFrame:
    """``tokens, accuracy``: how often the first largest logit is the label; ignored and null labels don't count."""
    hit = F.array_position(logits, F.array_max(logits)) - 1 == F.col(label)
    return df.filter(F.col(label) != ignored).agg(F.count("*").alias("tokens"), F.avg(hit.cast("double")).alias("accuracy"))


def reconstruction_by_dimension(df: DataFrame, a: str, b: str) -> DataFrame:
    """``mse, explained, normalised``: the mean squared error, 1 - the residuals' variance over the variance (both summed over dimensions), and
    the error over the variance of all elements (sample variances)."""
    t = df.select(F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("i", "z")).select("i", F.col("z.a").cast("double").alias("a"), F.col("z.b").cast("double").alias("b"))
    d = F.col("a") - F.col("b")
    per = t.groupBy("i").agg(F.count("*").alias("n"), F.sum(d * d).alias("e"), F.var_samp("a").alias("va"), F.var_samp(d).alias("vr"), F.sum("a").alias("s"), F.sum(F.col("a") * F.col("a")).alias("q"))
    n, s = F.sum("n"), F.sum("s")
    return per.agg((F.sum("e") / n).alias("mse"), (1 - F.sum("vr") / F.sum("va")).alias("explained"), (F.sum("e") / n / ((F.sum("q") - s * s / n) / (n - 1))).alias("normalised"))


def fitness(tokens: DataFrame, seq: str, logp: str, kept: Column) -> DataFrame:
    """``seq, tokens, fitness``: the mean log-probability over the tokens that ``kept`` admits; null without any."""
    return tokens.groupBy(seq).agg(F.count_if(kept).alias("tokens"), F.avg(F.when(kept, F.col(logp))).alias("fitness"))


def likelihood_ratio(logits: Column, ref: Column, alt: Column) -> Column:
    """How much likelier a variant's site finds the reference token than the alternate one: the difference of their log-probabilities, in
    which the normaliser cancels. Null where a token is outside the vocabulary."""
    return F.get(logits, ref).cast("double") - F.get(logits, alt).cast("double")


def delta_scores(variants: DataFrame, names: DataFrame, scores: DataFrame, name: str, ref: str, place: str, score: str) -> DataFrame:
    """Adds ``delta``: a variant's sequence score less its reference's. Sequences have names, ``names`` gives their places (``name, place``), and
    ``scores`` is by place; two equi-joins for either side, null where a score is missing."""
    by = names.join(scores.select(place, score), place).select(F.col(name).alias("_n"), F.col(score).alias("_s"))
    t = variants.join(by.select(F.col("_n").alias(name), F.col("_s").alias("_v")), name, "left")
    t = t.join(by.select(F.col("_n").alias(ref), F.col("_s").alias("_r")), ref, "left")
    return t.withColumn("delta", F.col("_v") - F.col("_r")).drop("_v", "_r")


def normal_tail(z: Column) -> Column:
    """The chance that a standard normal variable exceeds ``z`` in absolute value: a series of positive terms up to 4, a continued fraction beyond."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    q = x * x
    start = F.struct(x.alias("term"), x.alias("sum"))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * 2 * q / (2 * n + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    near = 1 - 2 / F.sqrt(F.pi()) * F.exp(-q) * F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, add, lambda s: s["sum"])
    below = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(1.0), lambda s, n: 1 + n / (2 * q) / s)
    far = F.exp(-q) / (x * F.sqrt(F.pi()) * below)
    return F.when(x <= 4, near).otherwise(far)


def mann_whitney(df: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """``group, n1, n0, u, z, p``: U of label 1 from tie-averaged ranks, and the two-sided normal p-value with the corrections for ties and
    continuity; null without both classes or without two different scores. Counts of distinct scores come first."""
    t = counted_below(df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()), score, label, group)
    n, r2 = F.col("n").cast("double"), F.col("p").cast("decimal(20,0)") * (2 * F.col("n_to") - F.col("n") + 1)
    t = t.groupBy(group).agg(F.sum(r2).cast("double").alias("r2"), F.sum("p").alias("n1"), F.sum(F.col("n") - F.col("p")).alias("n0"), F.sum(n * (n * n - 1)).alias("ties"))
    n1 = F.col("n1").cast("double")
    n, both = n1 + F.col("n0"), n1 * F.col("n0")
    u = (F.col("r2") - n1 * (n1 + 1)) / 2
    sd = F.sqrt(both / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    t = t.select(group, "n1", "n0", F.when(both > 0, u).alias("u"), F.when((both > 0) & (sd > 0), (F.greatest(u, both - u) - both / 2 - 0.5) / sd).alias("z"))
    return t.withColumn("p", F.when(F.col("z") <= 0, 1.0).otherwise(normal_tail(F.col("z"))))


def comparison_tests(df: DataFrame, item: str, kind: str, models: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """``model, case, control, n_case, n_control, u, z, p, log_p``: for each model's score column and each pair of patterns of ``kind``, the test of the
    items with rows of the one kind against those of the other. An item's score is the mean of its rows of that kind; null scores stay
    out, and ``log_p`` is -log10 of ``p``."""
    named = [(m, case, control) for m in models for case, control in pairs]
    sides = [F.struct(F.lit(i).alias("test"), F.lit(y).alias("label"), F.col(kind).rlike(t[1 if y else 2]).alias("there"), F.col(t[0]).cast("double").alias("score")) for i, t in enumerate(named) for y in (1, 0)]
    t = df.select(item, F.inline(F.array(*sides))).filter(F.col("there") & F.col("score").isNotNull())
    t = t.groupBy("test", "label", item).agg(F.avg("score").alias("score"))
    tests = F.element_at(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("model", "case", "control"), x, strict=True))) for x in named)), F.col("test") + 1)
    t = mann_whitney(t, "score", "label", "test").withColumn("_t", tests)
    return t.select("_t.*", F.col("n1").alias("n_case"), F.col("n0").alias("n_control"), "u", "z", "p", (-F.log10("p")).alias("log_p"))


def regression(df: DataFrame, truth: str, guess: str, fold: str) -> DataFrame:
    """``fold, n, mse, r2, pearson`` of predictions: ``r2`` is 1 - squared errors over squared deviations."""
    t = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    e = F.col(truth) - F.col(guess)
    t = t.groupBy(fold).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.var_pop(truth).alias("v"), F.corr(truth, guess).alias("pearson"))
    return t.select(fold, "n", "mse", F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"), "pearson")


def over_folds(folds: DataFrame, *names: str) -> DataFrame:
    """``metric, mean, std`` over the rows of ``folds`` (population deviation)."""
    t = folds.agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    return t.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"{n}_m").alias("mean"), F.col(f"{n}_s").alias("std")) for n in names))).alias("x")).select("x.*")


def forest_search(df: DataFrame, vector: str, target: str, fold: str, folds: int, grid: dict[str, list], seed: int = 0) -> DataFrame:
    """A row for each setting of ``grid`` (parameters of Spark's random forest) with ``rmse``, the mean over given folds; ``best`` marks the least."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    t = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(target).cast("double").alias("label"), F.col(fold).cast("int").alias("fold"))
    forest, build = RandomForestRegressor(seed=seed), ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(getattr(forest, name), values)
    settings = build.build()
    found = CrossValidator(estimator=forest, estimatorParamMaps=settings, evaluator=RegressionEvaluator(metricName="rmse"), numFolds=folds, foldCol="fold", seed=seed).fit(t).avgMetrics
    rows = [(*(float(s[getattr(forest, n)]) for n in grid), float(m), bool(m == min(found))) for s, m in zip(settings, found, strict=True)]
    return df.sparkSession.createDataFrame(rows, ", ".join([*(f"{n} double" for n in grid), "rmse double", "best boolean"]))
