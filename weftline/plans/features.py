"""Queries of feature statistics, matrices and ranked tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import sequences as S
from weftline.operators import features, graph, matrix, products, scores, sequence_tables
from weftline.plans import models
from weftline.plans.basics import query
from weftline.plans.biology import ACTS, AMINO, EXPR, SEQS, VARIANTS, acts, expr, seqs, table, variants

CACTS = f"""codon AS (SELECT doc_id, i::INT AS pos, substr(seq, (3 * i + 1)::INT, 3) AS codon, substr(seq, (3 * i + 4)::INT, 1) AS after FROM seqs, unnest(range(0, length(seq) // 3)) t(i)),
cacts AS (SELECT doc_id, pos, codon, after, f::INT AS feature, (1 + (doc_id + pos * 7 + f * 11) % 100) / 100 AS value FROM codon, unnest(range(0, 8)) t(f) WHERE (doc_id * 31 + pos * 17 + f * 13 + ascii(codon[3]) * f) % 5 = 0)"""
LABELS = """sizes AS (SELECT doc_id, length(seq) // 3 AS n FROM seqs), label AS (SELECT doc_id, 'DOM:' || (doc_id + k) % 3 AS concept, p::INT AS pos, max(doc_id * 3 + k) AS domain FROM sizes, unnest(range(0, 3)) t(k), unnest(range((doc_id * 3 + k * 20) % 50, (doc_id * 3 + k * 20) % 50 + 5 + doc_id % 7)) u(p) WHERE p < n GROUP BY ALL
UNION ALL SELECT doc_id, 'SITE', p::INT, doc_id FROM sizes, unnest(range(0, n)) u(p) WHERE doc_id % 2 = 0 AND p % 10 = doc_id % 10)"""


def codon_acts(spark, sf_dir):
    """Eight features over all codons of all documents, active rows only."""
    s = seqs(spark, sf_dir).select("doc_id", F.posexplode(S.codons(F.col("seq"))).alias("pos", "codon"), "seq")
    s = s.select("doc_id", "pos", "codon", F.substring(F.col("seq"), 3 * F.col("pos") + 4, F.lit(1)).alias("after"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("feature"))
    d, p, f = F.col("doc_id"), F.col("pos"), F.col("feature")
    s = s.filter((d * 31 + p * 17 + f * 13 + F.ascii(F.substring("codon", 3, 1)) * f) % 5 == 0)
    return s.withColumn("value", (1 + (d + p * 7 + f * 11) % 100) / 100)


def codon_labels(spark, sf_dir):
    """Three overlapping domains in each document, and single sites in every second one."""
    s = seqs(spark, sf_dir).select("doc_id", F.floor(F.length("seq") / 3).alias("n"))
    first = (F.col("doc_id") * 3 + F.col("k") * 20) % 50
    t = s.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).withColumn("pos", F.explode(F.sequence(first, first + 4 + F.col("doc_id") % 7))).filter("pos < n")
    t = t.groupBy("doc_id", F.concat(F.lit("DOM:"), ((F.col("doc_id") + F.col("k")) % 3).cast("string")).alias("concept"), F.col("pos").cast("int").alias("pos")).agg(F.max(F.col("doc_id") * 3 + F.col("k")).alias("domain"))
    sites = s.filter("n > 0 and doc_id % 2 = 0").withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).filter("pos % 10 = doc_id % 10")
    return t.unionByName(sites.select("doc_id", F.lit("SITE").alias("concept"), F.col("pos").cast("int").alias("pos"), F.col("doc_id").alias("domain")))


def f1_sql(rows: str, name: str) -> str:
    """SQL of ``concept_f1`` over the documents for which ``rows`` holds."""
    return f"""{name}_a AS (SELECT * FROM cacts WHERE {rows}), {name}_l AS (SELECT * FROM label WHERE {rows}), {name}_b AS (SELECT concept, count(*) AS positives, count(DISTINCT domain) AS domains FROM {name}_l GROUP BY concept HAVING count(*) >= 10),
{name}_v AS (SELECT a.doc_id, a.pos, a.feature, value / t.top AS v FROM {name}_a a JOIN (SELECT feature, max(value) AS top FROM {name}_a GROUP BY feature) t USING (feature)),
{name}_j AS (SELECT c.concept, v.feature, v.v, l.domain FROM {name}_v v JOIN (SELECT DISTINCT doc_id, concept FROM {name}_l JOIN {name}_b USING (concept)) c USING (doc_id) LEFT JOIN {name}_l l ON l.doc_id = v.doc_id AND l.concept = c.concept AND l.pos = v.pos),
{name}_n AS (SELECT concept, feature, th, count(*) FILTER (domain IS NOT NULL AND v > th) AS tp, count(*) FILTER (domain IS NULL AND v > th) AS fp, count(DISTINCT CASE WHEN v > th THEN domain END) AS d FROM {name}_j, (SELECT unnest([0, 0.15, 0.5, 0.6, 0.8])::DOUBLE AS th) t GROUP BY ALL),
{name}_p AS (SELECT concept, feature, th, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, tp / positives AS recall, CASE WHEN concept = 'SITE' THEN tp / positives ELSE d / domains END AS recall_domain FROM {name}_n JOIN {name}_b USING (concept)),
{name}_f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, CASE WHEN precision + recall_domain > 0 THEN 2 * precision * recall_domain / (precision + recall_domain) ELSE 0 END AS f1_domain FROM {name}_p),
{name} AS (SELECT * FROM {name}_f WHERE f1_domain > 0 QUALIFY row_number() OVER (PARTITION BY feature, concept ORDER BY f1_domain DESC, th) = 1)"""


def f1_pairs(spark, sf_dir, rows: str):
    return features.concept_f1(codon_acts(spark, sf_dir).filter(rows), codon_labels(spark, sf_dir).filter(rows), "doc_id", "pos", 10, ("SITE",))


@query(f"WITH {SEQS}, {CACTS}, {LABELS}, {f1_sql('true', 'r')} SELECT feature, concept, th AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(recall_domain, 9) AS recall_domain, round(f1_domain, 9) AS f1_domain FROM r")
def a11_a12_domain_f1(spark, sf_dir):
    """Best domain F1 of features and concepts; false positives count in carriers only."""
    t = f1_pairs(spark, sf_dir, "true")
    return t.select("feature", "concept", "threshold", *(F.round(x, 9).alias(x) for x in ("precision", "recall", "f1", "recall_domain", "f1_domain")))


@query(f"WITH {SEQS}, {CACTS}, {LABELS}, {f1_sql('doc_id % 2 = 0', 'v')}, {f1_sql('doc_id % 2 = 1', 't')}, b AS (SELECT concept, feature, f1_domain AS chosen FROM v QUALIFY row_number() OVER (PARTITION BY concept ORDER BY f1_domain DESC, feature) = 1) SELECT concept, b.feature, round(chosen, 9) AS chosen, round(t.f1_domain, 9) AS judged FROM b LEFT JOIN t USING (concept, feature)")
def j22_best_pairs(spark, sf_dir):
    """Each concept's best feature on one half, judged on the other."""
    t = features.best_pairs(f1_pairs(spark, sf_dir, "doc_id % 2 = 0"), f1_pairs(spark, sf_dir, "doc_id % 2 = 1"))
    return t.select("concept", "feature", F.round("chosen", 9).alias("chosen"), F.round("judged", 9).alias("judged"))


@query(f"WITH {SEQS}, {CACTS}, {LABELS}, {f1_sql('true', 'r')}, b AS (SELECT feature, concept FROM r WHERE f1_domain >= 0.3 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY f1_domain DESC, concept DESC) = 1) SELECT f::INT AS feature, coalesce(concept, 'Feature ' || f) AS label FROM range(0, 9) t(f) LEFT JOIN b ON feature = f")
def j22_feature_labels(spark, sf_dir):
    """The concept that labels each feature, where it scores enough."""
    every = spark.range(9).select(F.col("id").cast("int").alias("feature"))
    return features.feature_labels(f1_pairs(spark, sf_dir, "true"), every, 0.3)


@query(f"""WITH {SEQS}, {CACTS}, n AS (SELECT codon AS c, count(*) AS n FROM codon GROUP BY 1), w AS (SELECT c AS codon, {AMINO} AS aa, n FROM n), q AS (SELECT codon, aa, n / max(n) OVER p AS cai, n * count(*) OVER p / sum(n) OVER p AS rscu, CASE WHEN max(n % 7) OVER p > 0 THEN (n % 7) / max(n % 7) OVER p ELSE 0 END AS tai FROM w WINDOW p AS (PARTITION BY aa)),
a AS (SELECT feature, codon, after, pos, aa, cai, tai, rscu, n % 3 = 0 AS rare FROM cacts JOIN q USING (codon) JOIN (SELECT codon, n FROM w) USING (codon)),
b AS (SELECT feature, aa, count(*) AS k FROM a GROUP BY ALL), r AS (SELECT feature, CASE WHEN max(k) / sum(k) > 0.3 THEN max_by(aa, (k, -ascii(aa))) END AS residue FROM b GROUP BY feature),
s AS (SELECT feature, count(*) AS n, avg(rare::INT) AS r, avg((codon[3] = 'C' AND after = 'G')::INT) AS c, avg((codon[3] IN ('G', 'C'))::INT) AS w, avg((pos < 30)::INT) AS f, count(*) FILTER (aa <> '*') AS m, avg(CASE WHEN cai > 0 THEN ln(cai) ELSE 0 END) FILTER (aa <> '*') AS lc, avg(CASE WHEN tai > 0 THEN ln(tai) ELSE 0 END) FILTER (aa <> '*') AS lt, avg(rscu) FILTER (aa <> '*') AS lr FROM a GROUP BY feature)
SELECT feature, residue, CASE WHEN n > 10 AND r > 0.6 THEN 'rare' WHEN n > 10 AND r < 0.2 THEN 'common' END AS usage, CASE WHEN n > 10 AND c > 0.3 THEN round(c, 6) END AS cpg, CASE WHEN n > 10 AND w > 0.7 THEN 'GC' WHEN n > 10 AND w < 0.3 THEN 'AT' END AS wobble, CASE WHEN n > 10 AND f > 0.15 THEN round(f / 0.05::DOUBLE, 6) END AS early, CASE WHEN m > 10 THEN round(exp(lc), 6) END AS cai, CASE WHEN m > 10 THEN round(exp(lt), 6) END AS tai, CASE WHEN m > 10 THEN round(lr, 6) END AS rscu FROM s JOIN r USING (feature)""")
def a06_codon_annotations(spark, sf_dir):
    """What codons each feature fires on."""
    counts = sequence_tables.codon_counts(seqs(spark, sf_dir), "lang", "seq").groupBy("codon").agg(F.sum("n").alias("n"))
    tai = features.trna_adaptiveness(counts.withColumn("copies", F.col("n") % 7), "codon", "copies").select("codon", "tai")
    weights = sequence_tables.adaptiveness(counts).select("codon", "n", "cai", "rscu").join(tai, "codon", "left")
    t = features.codon_annotations(codon_acts(spark, sf_dir), weights, F.col("n") % 3 == 0)
    return t.select("feature", "residue", "usage", "wobble", *(F.round(x, 6).alias(x) for x in ("cpg", "early", "cai", "tai", "rscu")))


@query(f"WITH {SEQS}, {CACTS}, n AS (SELECT codon AS c, count(*) % 7 AS k FROM codon GROUP BY 1), w AS (SELECT c AS codon, {AMINO} AS aa, k FROM n) SELECT codon, aa, CASE WHEN max(k) OVER p > 0 THEN round(k / max(k) OVER p, 9) ELSE 0 END AS tai FROM w WHERE aa <> '*' WINDOW p AS (PARTITION BY aa)")
def a05_trna_adaptiveness(spark, sf_dir):
    """Copies over the most copies among synonyms."""
    counts = sequence_tables.codon_counts(seqs(spark, sf_dir), "lang", "seq").groupBy("codon").agg(F.sum("n").alias("n"))
    return features.trna_adaptiveness(counts.withColumn("copies", F.col("n") % 7), "codon", "copies").withColumn("tai", F.round("tai", 9))


@query(f"WITH {SEQS}, {CACTS}, s AS (SELECT feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, max(value) AS top, count(DISTINCT doc_id) AS carriers FROM cacts WHERE value > 0.25 GROUP BY feature) SELECT f::INT AS feature, coalesce(n, 0) AS n, round(mean, 6) AS mean, round(std, 6) AS std, top, coalesce(carriers, 0) AS carriers FROM range(0, 10) t(f) LEFT JOIN s ON feature = f")
def a07_a08_carried_stats(spark, sf_dir):
    """Mean, deviation, maximum and carriers of each feature above a threshold, dead ones too."""
    every = spark.range(10).select(F.col("id").cast("int").alias("feature"))
    t = features.with_dead(features.carried_stats(codon_acts(spark, sf_dir), "doc_id", 0.25), every, ["n", "carriers"])
    return t.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"""WITH {SEQS}, {CACTS}, rec AS (SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN length(seq)::DOUBLE END AS score, CASE WHEN doc_id % 13 > 0 THEN 5 ELSE -1 END AS site, CASE doc_id % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'other' END AS source, (doc_id % 100)::DOUBLE / 100 AS cons, CASE WHEN seq <> '' THEN length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) END AS gc, substr(seq, 1, 3) AS context, coalesce(lang, '') || doc_id % 7 AS gene FROM seqs),
act AS (SELECT DISTINCT doc_id, feature FROM cacts), t AS (SELECT * FROM act JOIN rec USING (doc_id), (SELECT median(score) AS mid FROM rec)),
w AS (SELECT feature, avg(score) FILTER (site >= 0) AS mean_score, avg((score >= mid)::INT) FILTER (site >= 0 AND score IS NOT NULL) AS high_share, avg((source = 'first')::INT) FILTER (site >= 0 AND source <> 'other') AS source_share, avg(cons) AS mean_cons, avg(gc) AS gc_mean, stddev_pop(gc) AS gc_std FROM t GROUP BY feature),
c AS (SELECT feature, -sum(p * log2(p)) AS context_entropy, max(p) AS context_dominant FROM (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p FROM (SELECT feature, context, count(*) AS n FROM t WHERE context <> '' GROUP BY ALL)) GROUP BY feature),
g AS (SELECT feature, -sum(p * log2(p)) AS gene_entropy, max(p) AS gene_dominant, count(*) AS genes FROM (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p FROM (SELECT feature, gene, count(*) AS n FROM t WHERE gene <> '' GROUP BY ALL)) GROUP BY feature)
SELECT feature, round(mean_score, 6) AS mean_score, round(high_share, 6) AS high_share, round(source_share, 6) AS source_share, round(mean_cons, 6) AS mean_cons, round(gc_mean, 6) AS gc_mean, round(gc_std, 6) AS gc_std, round(context_entropy, 6) AS context_entropy, round(context_dominant, 6) AS context_dominant, round(gene_entropy, 6) AS gene_entropy, round(gene_dominant, 6) AS gene_dominant, genes FROM w LEFT JOIN c USING (feature) LEFT JOIN g USING (feature)""")
def a13_variant_profile(spark, sf_dir):
    """Scores, sources, conservation, composition and genes of the records on which each feature fires."""
    d = F.col("doc_id")
    rec = seqs(spark, sf_dir).select("doc_id", F.when(d % 10 > 0, F.length("seq").cast("double")).alias("score"), F.when(d % 13 > 0, 5).otherwise(-1).alias("site"), F.when(d % 4 == 0, "first").when(d % 4 == 1, "second").otherwise("other").alias("source"), ((d % 100).cast("double") / 100).alias("cons"), S.gc_share(F.col("seq")).alias("gc"), F.substring("seq", 1, 3).alias("context"), F.concat(F.coalesce("lang", F.lit("")), (d % 7).cast("string")).alias("gene"))
    t = features.variant_profile(codon_acts(spark, sf_dir).select("doc_id", "feature").distinct(), rec, "doc_id")
    return t.select("feature", *(F.round(x, 6).alias(x) for x in ("mean_score", "high_share", "source_share", "mean_cons", "gc_mean", "gc_std", "context_entropy", "context_dominant", "gene_entropy", "gene_dominant")), "genes")


@query("WITH v AS (SELECT p_size AS feature, p_brand, max(p_retailprice) AS v FROM part GROUP BY ALL), t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY feature ORDER BY v DESC, p_brand) <= 6), s AS (SELECT p_brand, min(p_size)::DOUBLE / 10 AS pli FROM part WHERE p_partkey % 3 > 0 GROUP BY p_brand) SELECT feature, round(avg(pli), 9) AS mean, round(avg((pli > 0.15)::INT), 9) AS high_share, max(pli) AS most, count(*) AS genes FROM t JOIN s USING (p_brand) GROUP BY feature")
def a25_score_profile(spark, sf_dir):
    """Constraint scores of each feature's six top genes."""
    p = table(spark, sf_dir, "part")
    w = Window.partitionBy("feature").orderBy(F.desc("v"), "p_brand")
    top = p.groupBy(F.col("p_size").alias("feature"), "p_brand").agg(F.max("p_retailprice").alias("v")).withColumn("r", F.row_number().over(w)).filter("r <= 6")
    pli = p.filter("p_partkey % 3 > 0").groupBy("p_brand").agg((F.min("p_size").cast("double") / 10).alias("pli"))
    t = features.score_profile(top, pli, "p_brand", "pli", 0.15)
    return t.withColumns({"mean": F.round("mean", 9), "high_share": F.round("high_share", 9)})


TERMS = "terms AS (SELECT p_size AS feature, 'db' || p_partkey % 3 AS database, p_type AS term, p_retailprice AS score FROM part WHERE p_partkey % 17 < 3 AND p_size > 4)"


def terms(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_partkey % 17 < 3 and p_size > 4")
    return p.select(F.col("p_size").alias("feature"), F.concat(F.lit("db"), (F.col("p_partkey") % 3).cast("string")).alias("database"), F.col("p_type").alias("term"), F.col("p_retailprice").alias("score"))


@query(f"WITH {TERMS}, b AS (SELECT feature, database, max_by(term, (score, term)) AS term FROM terms GROUP BY ALL), f AS (SELECT DISTINCT p_size AS feature FROM part) SELECT feature, coalesce(max(term) FILTER (database = 'db0'), 'unlabeled') AS db0, coalesce(max(term) FILTER (database = 'db1'), 'unlabeled') AS db1, coalesce(max(term) FILTER (database = 'db2'), 'unlabeled') AS db2 FROM f LEFT JOIN b USING (feature) GROUP BY feature")
def a27_label_columns(spark, sf_dir):
    """Each feature's best term in each database."""
    every = table(spark, sf_dir, "part").select(F.col("p_size").alias("feature")).distinct()
    return features.label_columns(terms(spark, sf_dir), every, ["db0", "db1", "db2"])


@query(f"WITH {TERMS} SELECT database, count(DISTINCT term) AS terms, count(DISTINCT feature) AS enriched, round(count(DISTINCT feature) / (SELECT count(DISTINCT p_size) FROM part), 9) AS share FROM terms GROUP BY database")
def a28_report_counts(spark, sf_dir):
    """Terms and enriched features of each database."""
    every = table(spark, sf_dir, "part").select(F.col("p_size").alias("feature"))
    return features.report_counts(terms(spark, sf_dir), every).withColumn("share", F.round("share", 9))


@query(f"WITH {TERMS}, {ACTS}, s AS (SELECT feature, avg((value > 0.2)::INT) AS frequency FROM acts GROUP BY feature), b AS (SELECT feature, max_by(term, (score, term)) AS label FROM terms GROUP BY feature) SELECT s.feature::INT AS feature, CASE WHEN frequency > 0 THEN round(log10(frequency), 9) ELSE -10 END AS log_frequency, CASE WHEN s.feature % 5 > 0 THEN s.feature % 5 END AS cluster, coalesce(label, 'unlabeled') AS label FROM s LEFT JOIN b ON b.feature = s.feature")
def k09_k13_atlas(spark, sf_dir):
    """Statistics with coordinates, noise without a cluster, and the labels of an enrichment report."""
    s = acts(spark, sf_dir).groupBy("feature").agg(F.avg((F.col("value") > 0.2).cast("double")).alias("frequency"))
    place = s.select("feature", F.when(F.col("feature") % 5 == 0, -1).otherwise(F.col("feature") % 5).cast("long").alias("cluster"))
    best = terms(spark, sf_dir).groupBy("feature").agg(F.max_by("term", F.struct("score", "term")).alias("label"))
    t = features.atlas(s, place).join(best, "feature", "left")
    return t.select("feature", F.round("log_frequency", 9).alias("log_frequency"), "cluster", F.coalesce("label", F.lit("unlabeled")).alias("label"))


@query(f"WITH {SEQS}, {CACTS}, h AS (SELECT feature, doc_id, pos, value FROM cacts QUALIFY row_number() OVER (PARTITION BY feature ORDER BY value DESC, doc_id, pos) <= 20), w AS (SELECT h.*, seq, greatest(0, pos - 3)::INT AS f, least(length(seq) // 3 - 1, pos + 3)::INT AS l FROM h JOIN seqs USING (doc_id)) SELECT w.feature, w.doc_id, w.pos, substr(any_value(seq), 3 * any_value(f) + 1, 3 * (any_value(l) - any_value(f) + 1)) AS codons, string_agg(coalesce(c.value, 0)::DECIMAL(4,2)::VARCHAR, ',' ORDER BY p) AS values FROM w, unnest(range(f, l + 1)) t(p) LEFT JOIN cacts c ON c.doc_id = w.doc_id AND c.feature = w.feature AND c.pos = p GROUP BY w.feature, w.doc_id, w.pos")
def e03_contexts(spark, sf_dir):
    """Text and activations around each feature's twenty highest places."""
    a = codon_acts(spark, sf_dir)
    w = Window.partitionBy("feature").orderBy(F.desc("value"), "doc_id", "pos")
    hits = a.withColumn("r", F.row_number().over(w)).filter("r <= 20").select("feature", "doc_id", "pos")
    t = features.contexts(hits, seqs(spark, sf_dir), a, "doc_id", "pos", 3)
    return t.select("feature", "doc_id", "pos", "codons", F.array_join(F.transform("values", lambda v: v.cast("decimal(4,2)").cast("string")), ",").alias("values"))


@query(f"WITH {ACTS}, c AS (SELECT label, feature, round(avg(value::DOUBLE), 4)::DECIMAL(18,6) AS w FROM acts GROUP BY ALL), p AS (SELECT c.label, vec_id, sum(w * value) AS s FROM c JOIN acts a USING (feature) GROUP BY ALL), m AS (SELECT label, vec_id, round((s::DOUBLE - avg(s::DOUBLE) OVER (PARTITION BY vec_id)) * 1000000) AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS t, row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS b FROM m) SELECT label, 'top' AS side, t::INT AS rank, vec_id FROM r WHERE t <= 3 UNION ALL SELECT label, 'bottom', b::INT, vec_id FROM r WHERE b <= 3")
def e05_centred_extremes(spark, sf_dir):
    """The rows that score highest and lowest with each label's centre, scores centred by row."""
    t = products.extreme_products(models.centres(spark, sf_dir), models.vectors(spark, sf_dir), "label", "vec_id", "v", 3, centred=True, unit=10**6)
    return t.select("label", "side", "rank", "vec_id")


@query("WITH h AS (SELECT event_type, event_id // 7 AS iteration, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, iteration, n FROM (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY iteration) - 1 AS r FROM h) WHERE r % 5 = 0")
def e08_every_fifth(spark, sf_dir):
    """Every fifth iteration of each metric."""
    t = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("event_id") / 7).alias("iteration")).agg(F.count("*").alias("n"))
    return features.every_kth(t, "event_type", "iteration", 5).select("event_type", "iteration", "n")


@query("WITH v AS (SELECT vec_id, i, embedding[i]::DOUBLE AS a, floor(embedding[i]::DOUBLE * 10) / 10 AS b FROM embeddings, unnest(range(1, 65)) t(i)), d AS (SELECT i, var_samp(a) AS va, var_samp(a - b) AS vr FROM v GROUP BY i) SELECT round(avg((a - b) * (a - b)), 9) AS mse, round((SELECT 1 - sum(vr) / sum(va) FROM d), 6) AS explained, round(avg((a - b) * (a - b)) / var_samp(a), 6) AS normalised FROM v")
def x04_normalised_error(spark, sf_dir):
    """Errors of vectors cut to one decimal, by dimension and over all elements."""
    t = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("a"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 10) / 10).alias("b"))
    return scores.reconstruction_by_dimension(t, "a", "b").select(F.round("mse", 9).alias("mse"), F.round("explained", 6).alias("explained"), F.round("normalised", 6).alias("normalised"))


@query("SELECT event_id, user_id % 25 AS chrom, 1 + event_id * 7919 % 8000 AS pos FROM events ORDER BY chrom, pos, event_id LIMIT 500")
def o01_o02_first_variants(spark, sf_dir):
    """The first 500 variants by contig and place; each task sends its first 500 only."""
    return variants(spark, sf_dir).select("event_id", "chrom", "pos").orderBy("chrom", "pos", "event_id").limit(500)


@query("SELECT c_custkey, CASE WHEN n_regionkey % 2 = 0 THEN 'R' || n_regionkey ELSE 'other' END AS class FROM customer JOIN nation ON n_nationkey = c_nationkey")
def j19_listed_ancestor(spark, sf_dir):
    """Walk from customers over nations to listed regions; where the way ends without one there is a default."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("up"))
    up = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"))
    edges = c.select(F.col("node").alias("child"), F.col("up").alias("parent")).unionByName(up).unionByName(r.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("root").alias("parent")))
    listed = r.filter("r_regionkey % 2 = 0").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node"))
    t = graph.nearest_listed(c.select("node"), edges, listed)
    return c.join(t, "node").select("c_custkey", F.coalesce("ancestor", F.lit("other")).alias("class"))


@query(f"WITH {EXPR}, t AS (SELECT cell, string_agg(gene::VARCHAR, ',' ORDER BY gene) AS columns, string_agg((value * 2)::BIGINT::VARCHAR, ',' ORDER BY gene) AS entries FROM expr GROUP BY cell) SELECT * FROM t")
def s19_layer_rows(spark, sf_dir):
    """Rows of a matrix from one of its two layers."""
    t = expr(spark, sf_dir).select("cell", "gene", F.col("value").alias("raw"), (F.col("value") * 2).alias("processed"))
    t = matrix.csr_rows(matrix.layer(t, "processed", "cell", "gene", 0.9), "cell", "gene", "value")
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return t.select("cell", text("columns").alias("columns"), text("values").alias("entries"))


@query("SELECT o_orderkey AS id, 'exome' AS origin, o_totalprice AS value FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'genome', o_totalprice * 2 FROM orders WHERE o_orderkey % 2 = 1")
def u01_union(spark, sf_dir):
    """Two tables of one schema, columns in another order."""
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("exome").alias("origin"), F.col("o_totalprice").alias("value"))
    b = o.filter("o_orderkey % 2 = 1").select((F.col("o_totalprice") * 2).alias("value"), F.col("o_orderkey").alias("id"), F.lit("genome").alias("origin"))
    return matrix.checked_union(a, b)


MATRICES = "m AS (SELECT (l_orderkey % 3)::INT AS part, l_orderkey AS cell, l_partkey AS gene, sum(l_quantity)::BIGINT AS value FROM lineitem GROUP BY ALL)"


@query(f"WITH {MATRICES}, c AS (SELECT part, cell, count(*) AS n FROM m GROUP BY part, cell), r AS (SELECT part, cell, row_number() OVER (ORDER BY part, cell) - 1 AS row_index, n FROM c) SELECT part, cell, row_index, n, sum(n) OVER (ORDER BY row_index)::BIGINT - n AS pointer FROM r")
def u02_u03_concatenated(spark, sf_dir):
    """Three matrices as one: rows numbered on, row pointers shifted."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").cast("long").alias("value"))
    parts = [t.filter(F.col("cell") % 3 == k).withColumn("value", F.col("value").cast(kind)) for k, kind in enumerate(("int", "long", "int"))]
    return matrix.concatenated(parts, "cell", "gene", "value").select("part", "cell", "row_index", "n", "pointer")


@query("WITH d AS (SELECT n_nationkey AS part, n_regionkey // 2 AS kind, count(c_custkey) AS rows FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL), b AS (SELECT *, sum(new) OVER (ORDER BY part) AS block FROM (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (ORDER BY part))::INT AS new FROM d)) SELECT block::BIGINT AS block, min(part) AS first, sum(rows)::BIGINT AS rows, 'f' || any_value(kind) || ',g' || any_value(kind) AS features FROM b GROUP BY block")
def x02_feature_blocks(spark, sf_dir):
    """Feature lists appended in turn; one that equals the last joins its block."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("rows"))
    kind = F.floor(F.col("n_regionkey") / 2).cast("string")
    t = table(spark, sf_dir, "nation").join(rows, "n_nationkey", "left").select(F.col("n_nationkey").alias("part"), F.coalesce("rows", F.lit(0)).alias("rows"), F.array(F.concat(F.lit("f"), kind), F.concat(F.lit("g"), kind)).alias("features"))
    return matrix.feature_blocks(t, "part", "rows", "features").withColumn("features", F.array_join("features", ","))
