"""Statistics of learned features: annotations by codon, scores against concepts, profiles over variants, labels, atlases.

Activations are long: a row for each active (sequence, place, feature). Nothing is gathered by feature; all are partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import sequences as S


def carried_stats(acts: DataFrame, carrier: str, threshold: float) -> DataFrame:
    """``feature, n, mean, std, top, carriers``: over values above the threshold; ``std`` is the population's, not below zero."""
    v = F.col("value").cast("double")
    t = acts.filter(F.col("value") > threshold).groupBy("feature").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.max(v).alias("top"), F.countDistinct(carrier).alias("carriers"))
    mean = F.col("s") / F.col("n")
    return t.select("feature", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std"), "top", "carriers")


def with_dead(stats: DataFrame, features: DataFrame, counts: list[str]) -> DataFrame:
    """``stats`` with a row for every feature; those never active count zero and have no mean."""
    t = features.select("feature").join(stats, "feature", "left")
    return t.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def trna_adaptiveness(copies: DataFrame, codon: str, n: str) -> DataFrame:
    """``codon, aa, tai``: copies over the most copies among synonyms, 0 where there are none; stops are left out."""
    t = copies.select(F.col(codon).alias("codon"), S.amino_acid(F.col(codon)).alias("aa"), F.col(n).alias("n")).filter("aa not in ('*', '?')")
    top = F.max("n").over(Window.partitionBy("aa"))
    return t.select("codon", "aa", F.when(top > 0, F.col("n") / top).otherwise(0.0).alias("tai"))


def codon_annotations(acts: DataFrame, weights: DataFrame, rare: Column, least: int = 10) -> DataFrame:
    """A row for each feature of ``acts`` (feature, codon, next base ``after``, place ``pos``): ``residue`` (the best one, if it has over 0.3 of the
    activations), ``usage``, ``cpg``, ``wobble``, ``early`` (enrichment of the first 30 codons), and ``cai, tai`` (geometric means) and
    ``rscu`` (mean) from ``weights`` (codon, cai, tai, rscu); each needs more than ``least`` activations. Stops don't count for the last three."""
    t = acts.join(F.broadcast(weights), "codon", "left").withColumn("aa", S.amino_acid(F.col("codon")))  # 64 codons
    by = t.groupBy("feature", "aa").agg(F.count("*").alias("n"))
    best = by.groupBy("feature").agg(F.max_by(F.struct("aa", "n"), F.struct("n", -F.ascii("aa"))).alias("b"), F.sum("n").alias("all"))
    best = best.select("feature", F.when(F.col("b.n") / F.col("all") > 0.3, F.col("b.aa")).alias("residue"))
    share = lambda c: F.avg(c.cast("double"))
    coding = F.col("aa") != "*"
    log = lambda w: F.when(coding, F.when(F.col(w) > 0, F.log(w)).otherwise(0.0))
    last = F.substring("codon", 3, 1)
    t = t.groupBy("feature").agg(F.count("*").alias("n"), share(rare).alias("r"), share((last == "C") & F.coalesce(F.col("after") == "G", F.lit(False))).alias("c"), share(last.isin("G", "C")).alias("w"), share(F.col("pos") < 30).alias("f"), F.count_if(coding).alias("m"), F.avg(log("cai")).alias("lc"), F.avg(log("tai")).alias("lt"), F.avg(F.when(coding, F.coalesce("rscu", F.lit(1.0)))).alias("lr"))
    many, coded = F.col("n") > least, F.col("m") > least
    t = t.select(
        "feature",
        F.when(many & (F.col("r") > 0.6), "rare").when(many & (F.col("r") < 0.2), "common").alias("usage"),
        F.when(many & (F.col("c") > 0.3), F.col("c")).alias("cpg"),
        F.when(many & (F.col("w") > 0.7), "GC").when(many & (F.col("w") < 0.3), "AT").alias("wobble"),
        F.when(many & (F.col("f") > 0.15), F.col("f") / 0.05).alias("early"),
        F.when(coded, F.exp("lc")).alias("cai"),
        F.when(coded, F.exp("lt")).alias("tai"),
        F.when(coded, F.col("lr")).alias("rscu"),
    )
    return t.join(best, "feature")


THRESHOLDS = (0.0, 0.15, 0.5, 0.6, 0.8)


def concept_f1(acts: DataFrame, labels: DataFrame, seq: str, place: str, least: int = 10, by_place: tuple[str, ...] = (), thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``feature, concept, threshold, precision, recall, f1, recall_domain, f1_domain``: the best threshold by domain F1 of each pair, where
    that isn't 0. ``labels`` has ``seq, concept, place, domain``. Activations are divided by their feature's maximum (1 if that is 0); false
    positives count only in sequences that carry the concept; concepts with fewer than ``least`` labelled places go; those whose name
    begins with one of ``by_place`` are judged by places, not by domains. Counts for all thresholds are made in one pass; only
    labelled places meet activations, and a carrier's concepts meet its counts by feature."""
    a, b = f"_{seq}", f"_{place}"
    labels = labels.select(F.col(seq).alias(a), "concept", F.col(place).alias(b), "domain")
    about = labels.groupBy("concept").agg(F.count("*").alias("positives"), F.countDistinct("domain").alias("domains")).filter(F.col("positives") >= least)
    labels = labels.join(about.select("concept"), "concept", "left_semi")
    top = acts.groupBy("feature").agg(F.max("value").alias("_top"))
    t = acts.join(top, "feature").select(F.col(seq).alias(a), F.col(place).alias(b), "feature", (F.col("value") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1)).cast("double").alias("v"))
    counts = [F.count_if(F.col("v") > x).alias(f"n{i}") for i, x in enumerate(thresholds)]
    per = t.groupBy(a, "feature").agg(*counts)  # a carrier's activations meet its concepts as counts, a row for each feature
    every = per.join(labels.select(a, "concept").distinct(), a).groupBy("concept", "feature").agg(*(F.sum(f"n{i}").alias(f"all{i}") for i in range(len(thresholds))))
    placed = labels.filter(F.col("domain").isNotNull()).groupBy(a, b, "concept").agg(F.collect_list("domain").alias("_d"))
    spans = t.join(placed, [a, b]).select("concept", "feature", "v", F.posexplode("_d").alias("_i", "domain"))
    once = [F.count_if((F.col("_i") == 0) & (F.col("v") > x)).alias(f"once{i}") for i, x in enumerate(thresholds)]
    spans = spans.groupBy("concept", "feature", "domain").agg(F.max("v").alias("v"), *counts, *once)
    sums = []
    for i, x in enumerate(thresholds):
        sums += [F.sum(f"n{i}").alias(f"tp{i}"), F.sum(f"once{i}").alias(f"once{i}"), F.count_if(F.col("v") > x).alias(f"d{i}")]
    t = every.join(spans.groupBy("concept", "feature").agg(*sums), ["concept", "feature"], "left").join(about, "concept")
    t = t.withColumns({f"{k}{i}": F.coalesce(f"{k}{i}", F.lit(0)) for k in ("tp", "once", "d") for i in range(len(thresholds))})
    t = t.withColumns({f"fp{i}": F.col(f"all{i}") - F.col(f"once{i}") for i in range(len(thresholds))})
    rows = F.array(*(F.struct(F.lit(x).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"d{i}").alias("d")) for i, x in enumerate(thresholds)))
    t = t.select("concept", "feature", "positives", "domains", F.explode(rows).alias("x")).select("concept", "feature", "positives", "domains", "x.*")
    by_places = F.lit(False)
    for prefix in by_place:
        by_places = by_places | F.col("concept").startswith(prefix)
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    harmonic = lambda p, r: ratio(2 * p * r, p + r)
    t = t.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("positives"))})
    t = t.withColumn("recall_domain", F.when(by_places, F.col("recall")).otherwise(ratio(F.col("d"), F.col("domains"))))
    t = t.withColumns({"f1": harmonic(F.col("precision"), F.col("recall")), "f1_domain": harmonic(F.col("precision"), F.col("recall_domain"))})
    names = ("threshold", "precision", "recall", "f1", "recall_domain", "f1_domain")
    t = t.groupBy("feature", "concept").agg(F.max_by(F.struct(*names), F.struct("f1_domain", -F.col("threshold"))).alias("b"))
    return t.select("feature", "concept", *(F.col(f"b.{n}").alias(n) for n in names)).filter("f1_domain > 0")


def best_pairs(chosen: DataFrame, judged: DataFrame, score: str = "f1_domain") -> DataFrame:
    """``concept, feature, chosen, judged``: each concept's best feature by ``score`` in one table, with that pair's score in another; null where it has none."""
    best = chosen.groupBy("concept").agg(F.max_by(F.struct("feature", score), F.struct(score, -F.col("feature"))).alias("b"))
    best = best.select("concept", F.col("b.feature").alias("feature"), F.col(f"b.{score}").alias("chosen"))
    return best.join(judged.select("concept", "feature", F.col(score).alias("judged")), ["concept", "feature"], "left")


def feature_labels(pairs: DataFrame, features: DataFrame, least: float, score: str = "f1_domain") -> DataFrame:
    """``feature, label``: the concept that scores best, if it scores ``least``, else the feature's own number."""
    best = pairs.groupBy("feature").agg(F.max_by(F.struct("concept", score), F.struct(score, "concept")).alias("b")).filter(F.col(f"b.{score}") >= least)
    t = features.select("feature").join(best.select("feature", F.col("b.concept").alias("label")), "feature", "left")
    return t.withColumn("label", F.coalesce("label", F.concat(F.lit("Feature "), F.col("feature").cast("string"))))


def entropy(rows: DataFrame, feature: str, value: str) -> DataFrame:
    """``feature, entropy, dominant, distinct``: in bits, of the values' shares; the share of the commonest; how many there are."""
    n = rows.groupBy(feature, value).agg(F.count("*").alias("_n"))
    t = n.groupBy(feature).agg(F.sum("_n").alias("_s"), F.sum(F.col("_n") * F.log2("_n")).alias("_l"), F.max("_n").alias("_m"), F.count("*").alias("distinct"))
    return t.select(feature, (F.log2("_s") - F.col("_l") / F.col("_s")).alias("entropy"), (F.col("_m") / F.col("_s")).alias("dominant"), "distinct")


def variant_profile(active: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """A row for each feature of ``active`` (key, feature; distinct): over its records with a site, ``mean_score``, ``high_share`` (scores not below the
    exact median of all scores), ``source_share`` (of ``first`` among ``first`` and ``second``), and over all its records ``mean_cons, gc_mean,
    gc_std``, entropy and dominant share of ``context`` and ``gene``, ``genes``. ``records`` has ``score, site, source, cons, gc, context, gene``."""
    middle = records.agg(F.median("score").alias("_median"))
    t = active.join(records, key).crossJoin(F.broadcast(middle))  # one row
    sited = F.col("site") >= 0
    scored = sited & F.col("score").isNotNull()
    on = lambda cond, v: F.when(cond, v)
    whole = t.groupBy("feature").agg(
        F.avg(on(scored, F.col("score"))).alias("mean_score"),
        F.avg(on(scored, (F.col("score") >= F.col("_median")).cast("double"))).alias("high_share"),
        F.avg(on(sited & F.col("source").isin("first", "second"), (F.col("source") == "first").cast("double"))).alias("source_share"),
        F.avg("cons").alias("mean_cons"),
        F.avg("gc").alias("gc_mean"),
        F.stddev_pop("gc").alias("gc_std"),
    )
    context = entropy(t.filter("context != ''"), "feature", "context").select("feature", F.col("entropy").alias("context_entropy"), F.col("dominant").alias("context_dominant"))
    gene = entropy(t.filter("gene != ''"), "feature", "gene").select("feature", F.col("entropy").alias("gene_entropy"), F.col("dominant").alias("gene_dominant"), F.col("distinct").alias("genes"))
    return whole.join(context, "feature", "left").join(gene, "feature", "left")


def score_profile(top: DataFrame, scores: DataFrame, gene: str, score: str, high: float = 0.9) -> DataFrame:
    """``feature, mean, high_share, most, genes``: over a feature's top genes that have a score."""
    t = top.join(scores.select(gene, score), gene)
    return t.groupBy("feature").agg(F.avg(score).alias("mean"), F.avg((F.col(score) > high).cast("double")).alias("high_share"), F.max(score).alias("most"), F.count("*").alias("genes"))


def label_columns(terms: DataFrame, features: DataFrame, databases: list[str], score: str = "score") -> DataFrame:
    """``feature`` and a column for each database with its best term (highest score, then name), ``unlabeled`` where there is none."""
    best = terms.groupBy("feature", "database").agg(F.max_by("term", F.struct(F.col(score), F.col("term"))).alias("term"))
    t = features.select("feature").join(best.groupBy("feature").pivot("database", databases).agg(F.first("term")), "feature", "left")
    return t.select("feature", *(F.coalesce(d, F.lit("unlabeled")).alias(d) for d in databases))


def report_counts(terms: DataFrame, features: DataFrame) -> DataFrame:
    """``database, terms, enriched, share``: distinct terms, features with a term, their share of all features."""
    n = features.agg(F.countDistinct("feature").alias("_n"))
    t = terms.groupBy("database").agg(F.countDistinct("term").alias("terms"), F.countDistinct("feature").alias("enriched"))
    return t.crossJoin(F.broadcast(n)).select("database", "terms", "enriched", (F.col("enriched") / F.col("_n")).alias("share"))  # one row


def atlas(stats: DataFrame, places: DataFrame, key: str = "feature") -> DataFrame:
    """``stats`` joined with coordinates; ``log_frequency`` (-10 where never active), and no cluster for noise (-1)."""
    t = stats.join(places, key)
    return t.withColumns({"log_frequency": F.when(F.col("frequency") > 0, F.log10("frequency")).otherwise(-10.0), "cluster": F.when(F.col("cluster") != -1, F.col("cluster"))})


def contexts(hits: DataFrame, sequences: DataFrame, acts: DataFrame, seq: str, place: str, half: int) -> DataFrame:
    """Adds to ``hits`` (seq, feature, place) ``first, codons`` (the text within ``half`` codons) and ``values`` (the feature's activation at each of them)."""
    n = F.floor(F.length("_s") / 3)
    t = hits.join(sequences.select(seq, F.col("seq").alias("_s")), seq)
    t = t.withColumns({"first": F.greatest(F.lit(0), F.col(place) - half).cast("int"), "_last": F.least(n - 1, F.col(place) + half).cast("int")})
    t = t.withColumn("codons", F.substring(F.col("_s"), 3 * F.col("first") + 1, 3 * (F.col("_last") - F.col("first") + 1))).drop("_s")
    near = acts.select(seq, "feature", F.col(place).alias("_p"), F.col("value").alias("_v"))
    found = t.select(seq, "feature", place, "first", "_last").join(near, [seq, "feature"]).filter(F.col("_p").between(F.col("first"), F.col("_last")))
    found = found.groupBy(seq, "feature", place).agg(F.map_from_entries(F.collect_list(F.struct("_p", "_v"))).alias("_m"))
    t = t.join(found, [seq, "feature", place], "left")
    values = F.transform(F.sequence("first", "_last"), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return t.withColumn("values", values).drop("_last", "_m")



def every_kth(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """Rows whose distinct ``order`` has a rank (from 0, in its group) that ``k`` divides."""
    ranked = df.select(group, order).distinct().withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    return df.join(ranked.filter(F.col("rank") % k == 0), [group, order])
