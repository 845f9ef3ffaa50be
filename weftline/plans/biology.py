"""Queries of the sequence and matrix operators over views of the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import sequences as S
from weftline.operators import intervals, matrix, sampling, scores, sequence_tables
from weftline.plans.basics import query

SEQS = "seqs AS (SELECT doc_id, lang, source, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
AMINO = f"substr('{S.AMINO}', (instr('TCAG', c[1]) - 1) * 16 + (instr('TCAG', c[2]) - 1) * 4 + instr('TCAG', c[3]), 1)"
CODONS = "list_transform(range(0, length(seq) // 3), lambda i: substr(seq, (3 * i + 1)::INT, 3))"
PROTEIN = f"coalesce(list_aggregate(list_transform({CODONS}, lambda c: {AMINO}), 'string_agg', ''), '')"
EXONS = "exons AS (SELECT l_orderkey AS tx, o_custkey % 25 AS chrom, k * 1000 + l_suppkey % 400 AS s, k * 1000 + l_suppkey % 400 + 30 * (1 + l_partkey % 5) AS e FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)"
VARIANTS = "variants AS (SELECT event_id, user_id % 25 AS chrom, 1 + event_id * 7919 % 8000 AS pos, event_id % 4 AS alt FROM events)"
ACTS = "acts AS (SELECT vec_id, label, i - 1 AS feature, greatest(embedding[i]::DOUBLE, 0)::DECIMAL(18,6) AS value FROM embeddings, unnest(range(1, 65)) t(i))"
ROLL = "(('0x' || substr(md5('{seed}|' || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seqs(spark, sf_dir) -> DataFrame:
    """The bases of each document; exploded, so that they are computed once, however often a query mentions them."""
    bases = F.regexp_replace(F.upper("text"), "[^ACGT]+", "")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.explode(F.array(bases)).alias("seq"))


def exons(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    t = table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = F.col("k") * 1000 + F.col("l_suppkey") % 400
    return t.select(F.col("l_orderkey").alias("tx"), (F.col("o_custkey") % 25).alias("chrom"), s.alias("s"), (s + 30 * (1 + F.col("l_partkey") % 5)).alias("e"))


def variants(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 25).alias("chrom"), (1 + F.col("event_id") * 7919 % 8000).alias("pos"), (F.col("event_id") % 4).alias("alt"))


def acts(spark, sf_dir) -> DataFrame:
    return matrix.activations(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def expr(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").cast("long").alias("value"))


EXPR = "expr AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity)::BIGINT AS value FROM lineitem GROUP BY ALL)"


@query(f"WITH {SEQS} SELECT doc_id, translate(seq, 'ACGT', 'TGCA') AS complement, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp, translate(seq, 'T', 'U') AS rna FROM seqs")
def p01_p02_strands(spark, sf_dir):
    """Complement, reverse complement, transcript."""
    s = F.col("seq")
    return seqs(spark, sf_dir).select("doc_id", S.complement(s).alias("complement"), S.reverse_complement(s).alias("revcomp"), S.transcribe(s).alias("rna"))


@query(f"WITH {SEQS} SELECT doc_id, substr(seq, 6, greatest(0, least(length(seq), 25) - 5)::INT) AS middle, CASE WHEN length(seq) > 5 THEN substr(seq, (greatest(0, length(seq) - 30) + 1)::INT, (length(seq) - 5 - greatest(0, length(seq) - 30))::INT) ELSE '' END AS tail FROM seqs")
def p03_slices(spark, sf_dir):
    """``seq[5:25]`` and ``seq[-30:-5]``."""
    s = F.col("seq")
    return seqs(spark, sf_dir).select("doc_id", S.python_slice(s, 5, 25).alias("middle"), S.python_slice(s, -30, -5).alias("tail"))


@query(f"WITH {SEQS} SELECT doc_id, (length(seq) // 3)::INT AS n_codons, {PROTEIN} AS protein FROM seqs")
def p05_p07_translate(spark, sf_dir):
    """Codons and their residues."""
    s = F.col("seq")
    return seqs(spark, sf_dir).select("doc_id", F.size(S.codons(s)).alias("n_codons"), S.translate(s).alias("protein"))


@query(f"""WITH {SEQS}, p AS (SELECT doc_id, seq, {PROTEIN} AS protein FROM seqs),
f AS (SELECT doc_id, starts_with(seq, 'ATG') AS starts_atg, coalesce(right(seq, 3) IN ('TAA', 'TAG', 'TGA'), false) AS ends_stop, length(seq) % 3 = 0 AS whole, instr(substr(protein, 1, greatest(0, length(protein) - 1)::INT), '*') > 0 AS internal_stop FROM p)
SELECT *, starts_atg AND ends_stop AND whole AND NOT internal_stop AS valid FROM f""")
def p10_p11_cds_flags(spark, sf_dir):
    """Coding-sequence checks."""
    return sequence_tables.cds_flags(seqs(spark, sf_dir), "seq").select("doc_id", "starts_atg", "ends_stop", "whole", "internal_stop", "valid")


@query(f"WITH {SEQS} SELECT doc_id, '+' AS strand, seq FROM seqs UNION ALL SELECT doc_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM seqs")
def p13_both_strands(spark, sf_dir):
    """Each sequence on both strands."""
    return sequence_tables.both_strands(seqs(spark, sf_dir).select("doc_id", "seq"), "seq").select("doc_id", "strand", "seq")


@query(f"WITH {SEQS} SELECT doc_id, length(seq)::INT AS n FROM seqs WHERE length(seq) BETWEEN 100 AND 600 AND seq NOT LIKE '%AAAA%'")
def p12_p31_filters(spark, sf_dir):
    """Length bounds and a motif filter."""
    t = sequence_tables.length_between(seqs(spark, sf_dir), "seq", 100, 600)
    return t.filter(~F.col("seq").contains("AAAA")).select("doc_id", F.length("seq").alias("n"))


@query(f"WITH {SEQS}, c AS (SELECT lang, unnest({CODONS}) AS codon FROM seqs) SELECT lang, codon, count(*) AS n FROM c GROUP BY ALL")
def a03_codon_counts(spark, sf_dir):
    """Codons per group."""
    return sequence_tables.codon_counts(seqs(spark, sf_dir), "lang", "seq")


@query(f"WITH {SEQS}, c AS (SELECT unnest({CODONS}) AS codon FROM seqs), n AS (SELECT codon, count(*) AS n FROM c GROUP BY codon) SELECT codon, n, round((avg(n) OVER ()) / n, 9) AS weight FROM n")
def a04_codon_weights(spark, sf_dir):
    """Inverse-frequency weights."""
    t = sequence_tables.inverse_frequency_weights(sequence_tables.codon_counts(seqs(spark, sf_dir), "lang", "seq"))
    return t.select("codon", "n", F.round("weight", 9).alias("weight"))


@query(f"WITH {SEQS}, c AS (SELECT unnest({CODONS}) AS c FROM seqs), n AS (SELECT c AS codon, {AMINO} AS aa, count(*) AS n FROM c GROUP BY ALL) SELECT codon, aa, n, round(n / max(n) OVER w, 9) AS cai, round(n * count(*) OVER w / sum(n) OVER w, 9) AS rscu FROM n WINDOW w AS (PARTITION BY aa)")
def a05_adaptiveness(spark, sf_dir):
    """Relative adaptiveness and synonymous usage."""
    t = sequence_tables.adaptiveness(sequence_tables.codon_counts(seqs(spark, sf_dir), "lang", "seq"))
    return t.select("codon", "aa", "n", F.round("cai", 9).alias("cai"), F.round("rscu", 9).alias("rscu"))


@query(f"WITH {SEQS}, n AS (SELECT doc_id, seq, CASE WHEN length(seq) < 128 THEN 1 ELSE 1 + (length(seq) - 128) // 96 END AS n FROM seqs) SELECT doc_id, k::INT AS window_no, (k * 96)::INT AS start, substr(seq, (k * 96 + 1)::INT, 128) AS text FROM n, unnest(range(0, n)) t(k)")
def i01_i02_windows(spark, sf_dir):
    """Windows of 128 at a stride of 96."""
    return sequence_tables.windows(seqs(spark, sf_dir), "doc_id", "seq", 128, 96).select("doc_id", "window_no", "start", "text")


@query(f"WITH {SEQS} SELECT doc_id || ':' || s || '-' || least(s + 100, length(seq)) AS name, substr(seq, (s + 1)::INT, 100) AS text FROM seqs, unnest(range(0, length(seq), 100)) t(s)")
def i08_chunks(spark, sf_dir):
    """Chunks of 100."""
    return sequence_tables.fixed_chunks(seqs(spark, sf_dir), "doc_id", "seq", 100)


@query(f"WITH {SEQS} SELECT CASE WHEN n < 50 THEN 0 WHEN n < 200 THEN 1 WHEN n < 400 THEN 2 WHEN n < 800 THEN 3 END::INT AS bucket, count(*) AS items, max(n)::INT AS longest FROM (SELECT length(seq) AS n FROM seqs) WHERE n < 800 GROUP BY 1")
def i11_size_buckets(spark, sf_dir):
    """Left-closed, right-open buckets of sizes."""
    t = seqs(spark, sf_dir).select(F.length("seq").alias("n"))
    return t.withColumn("bucket", sampling.size_bucket(F.col("n"), [0, 50, 200, 400, 800])).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("items"), F.max("n").alias("longest"))


@query()
def i13_token_batches(spark, sf_dir):
    """Greedy batches of 4000 bases in each source's stretches of 1000 ids."""
    t = seqs(spark, sf_dir).select("source", F.floor(F.col("doc_id") / 1000).alias("stretch"), "doc_id", F.length("seq").alias("n"))
    return sampling.token_batches(t, ["source", "stretch"], "doc_id", "n", 4000)


@query(f"WITH {VARIANTS}, {EXONS} SELECT event_id, tx, pos, s, e FROM variants JOIN exons USING (chrom) WHERE pos >= s AND pos < e")
def j03_variant_exon_join(spark, sf_dir):
    """Variants inside exons."""
    t = intervals.point_in_interval(variants(spark, sf_dir).drop("alt"), exons(spark, sf_dir), "chrom", "pos", "s", "e")
    return t.select("event_id", "tx", "pos", "s", "e")


@query(f"""WITH {VARIANTS}, {EXONS}, x AS (SELECT *, row_number() OVER w AS exon_number, coalesce(sum(e - s) OVER (PARTITION BY tx ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER (PARTITION BY tx) AS n FROM exons WINDOW w AS (PARTITION BY tx ORDER BY s, e))
SELECT event_id, tx, exon_number::INT AS exon_number, (before + pos - s)::BIGINT AS cds_pos, (exon_number > 1 AND pos - s < 2) OR (exon_number < n AND e - 1 - pos < 2) AS splice FROM variants JOIN x USING (chrom) WHERE pos >= s AND pos < e""")
def j04_j05_positions(spark, sf_dir):
    """Positions within transcripts, and splice junctions."""
    x = intervals.exon_offsets(exons(spark, sf_dir), "tx", "s", "e").withColumn("n", F.count("*").over(Window.partitionBy("tx")))
    x = x.select("chrom", "s", "e", "offset", "exon_number", "n", "tx")  # equal exons are listed in this order, so those of one offset stand together
    t = intervals.splice_flags(intervals.point_in_interval(variants(spark, sf_dir).drop("alt"), x, "chrom", "pos", "s", "e"), "pos", "s", "e", "n")
    return t.select("event_id", "tx", "exon_number", (F.col("offset") + F.col("pos") - F.col("s")).cast("long").alias("cds_pos"), "splice")


@query(f"WITH {EXONS} SELECT tx, string_agg(s::VARCHAR, ',' ORDER BY s, e) AS starts, string_agg(e::VARCHAR, ',' ORDER BY s, e) AS ends, count(*) AS n_exons, sum(e - s)::BIGINT AS length FROM exons GROUP BY tx")
def a01_transcripts(spark, sf_dir):
    """Exon lists per transcript."""
    return intervals.transcripts(exons(spark, sf_dir), "tx", "s", "e")


@query(f"WITH {EXONS}, t AS (SELECT chrom, tx, sum(e - s)::BIGINT AS length FROM exons GROUP BY ALL) SELECT chrom, tx, length FROM t QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY length DESC, tx) = 1")
def a30_longest_transcript(spark, sf_dir):
    """The longest transcript per gene."""
    t = exons(spark, sf_dir).groupBy("chrom", "tx").agg(F.sum(F.col("e") - F.col("s")).alias("length"))
    return t.groupBy("chrom").agg(F.max_by(F.struct("tx", "length"), F.struct("length", -F.col("tx"))).alias("x")).select("chrom", "x.tx", "x.length")


@query("SELECT l_orderkey AS tx, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_linenumber)")
def a31_consistent_transcripts(spark, sf_dir):
    """Transcripts without a repeated exon number."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tx")).agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("d"))
    return t.filter("n = d").select("tx", "n")


@query(f"WITH {VARIANTS} SELECT n AS variants_of, count(*) AS positions FROM (SELECT chrom, pos, alt, count(*) AS n FROM variants GROUP BY ALL) GROUP BY n")
def a18_count_of_counts(spark, sf_dir):
    """How many positions have how many variants."""
    return variants(spark, sf_dir).groupBy("chrom", "pos", "alt").agg(F.count("*").alias("variants_of")).groupBy("variants_of").agg(F.count("*").alias("positions"))


@query(f"WITH {VARIANTS} SELECT chrom, pos, alt, min(event_id) AS event_id, count(*) AS times FROM variants GROUP BY ALL")
def a19_recurrence(spark, sf_dir):
    """Samples per variant, first kept."""
    return variants(spark, sf_dir).groupBy("chrom", "pos", "alt").agg(F.min("event_id").alias("event_id"), F.count("*").alias("times"))


@query("SELECT user_id, max_by(event_id, (value, -event_id)) AS event_id FROM events WHERE value IS NOT NULL GROUP BY user_id")
def a20_highest_record(spark, sf_dir):
    """The record of highest value per key."""
    return table(spark, sf_dir, "events").filter("value is not null").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query(f"WITH {EXPR}, t AS (SELECT count(DISTINCT cell) AS n_rows, count(DISTINCT gene) AS n_cols, count(*) AS n_stored FROM expr) SELECT *, round(1 - n_stored / (n_rows * n_cols), 9) AS sparsity FROM t")
def a15_matrix_shape(spark, sf_dir):
    """Counters of the cell by gene matrix."""
    t = matrix.shape(expr(spark, sf_dir), "cell", "gene")
    return t.withColumn("sparsity", F.round("sparsity", 9))


@query(f"WITH {EXPR} SELECT cell, string_agg(gene::VARCHAR, ',' ORDER BY gene) AS columns, string_agg(value::VARCHAR, ',' ORDER BY gene) AS entries FROM expr GROUP BY cell")
def s19_i21_csr_rows(spark, sf_dir):
    """The matrix by rows."""
    t = matrix.csr_rows(expr(spark, sf_dir), "cell", "gene", "value")
    return t.select("cell", F.array_join(F.transform("columns", lambda x: x.cast("string")), ",").alias("columns"), F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("entries"))


@query("SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS row_index FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def o03_dense_index(spark, sf_dir):
    """Dense row numbers without a global sort."""
    return matrix.dense_index(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(f"WITH {EXPR}, n AS (SELECT cell, count(*) AS n FROM expr GROUP BY cell) SELECT cell, (cell // 100)::BIGINT AS block, n, (sum(n) OVER (PARTITION BY cell // 100 ORDER BY cell ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS pointer FROM n")
def e06_row_pointers(spark, sf_dir):
    """Row pointers within blocks of cells."""
    t = expr(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("cell") / 100))
    w = Window.partitionBy("block").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("cell", "block", "n", (F.sum("n").over(w) - F.col("n")).alias("pointer"))


NBRS = "ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders), nbrs AS (SELECT a.o_orderkey AS cell, b.o_orderkey AS nbr, b.o_orderdate AS d FROM ranked a JOIN ranked b ON a.o_custkey = b.o_custkey AND b.r BETWEEN a.r + 1 AND a.r + 16)"


def nbrs(spark, sf_dir) -> DataFrame:
    """The sixteen orders of a customer that follow an order: at most that many edges for each row, however many orders a customer has."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(1, 16)
    t = o.select(F.col("o_orderkey").alias("cell"), F.collect_list(F.struct(F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("nbr"))).over(w).alias("x"))
    return t.select("cell", F.explode("x").alias("x")).select("cell", "x.nbr", "x.d")


@query(f"WITH {NBRS}, n AS (SELECT cell, count(*) AS n FROM nbrs GROUP BY cell) SELECT sum(n)::BIGINT AS total, min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean FROM n")
def a16_neighbour_stats(spark, sf_dir):
    """Neighbours per cell."""
    return matrix.neighbour_stats(nbrs(spark, sf_dir), "cell", "nbr").withColumn("mean", F.round("mean", 9))


@query(f"WITH {NBRS}, f AS (SELECT cell, min_by(nbr, (d, nbr)) AS n FROM nbrs GROUP BY cell) SELECT o_orderkey AS cell, coalesce(n, o_orderkey) AS neighbour FROM orders LEFT JOIN f ON cell = o_orderkey")
def j10_first_neighbour(spark, sf_dir):
    """First neighbour or the cell itself."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"))
    return matrix.first_neighbour(rows, nbrs(spark, sf_dir), "cell", "nbr", ["d"])


@query(f"WITH {ACTS} SELECT feature::INT AS feature, round(avg((value > 0)::INT), 9) AS frequency, round(sum(CASE WHEN value > 0 THEN value END)::DOUBLE / count(CASE WHEN value > 0 THEN 1 END), 6) AS mean_active, max(value) AS top FROM acts GROUP BY feature")
def a07_a10_feature_stats(spark, sf_dir):
    """Frequency, mean and maximum per feature."""
    t = matrix.feature_stats(acts(spark, sf_dir))
    return t.select("feature", F.round("frequency", 9).alias("frequency"), F.round("mean_active", 6).alias("mean_active"), "top")


@query(f"WITH {ACTS} SELECT label, feature::INT AS feature, max(value) AS pooled FROM acts GROUP BY ALL")
def a09_max_pool(spark, sf_dir):
    """Maximum per group and feature."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return acts(spark, sf_dir).join(e, "vec_id").groupBy("label", "feature").agg(F.max("value").alias("pooled"))


@query(f"WITH {ACTS} SELECT feature::INT AS feature, r::INT AS rank, vec_id, value FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value DESC, vec_id) AS r FROM acts WHERE value > 0) WHERE r <= 10")
def e01_top_rows(spark, sf_dir):
    """Ten highest rows per feature."""
    return matrix.top_rows(acts(spark, sf_dir), "vec_id", 10).select("feature", "rank", "vec_id", "value")


@query(f"WITH {ACTS}, l AS (SELECT label, feature, max(value) AS v FROM acts GROUP BY ALL) SELECT feature::INT AS feature, label, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v DESC, label) AS r FROM l WHERE v > 0) WHERE r <= 3")
def e02_top_groups(spark, sf_dir):
    """Three highest groups per feature."""
    t = a09_max_pool(spark, sf_dir).withColumnRenamed("pooled", "value")
    return matrix.top_rows(t, "label", 3).select("feature", "label", "rank")


@query(f"""WITH {ACTS}, m AS (SELECT feature, max(value) AS top FROM acts GROUP BY feature),
h AS (SELECT a.label, a.feature, t.th, count(*) FILTER (WHERE value > th * top) AS hits FROM acts a JOIN m USING (feature), (SELECT unnest([0, 0.15, 0.5, 0.6, 0.8])::DECIMAL(3,2) AS th) t GROUP BY ALL),
p AS (SELECT label, count(*) AS positives FROM embeddings GROUP BY label), q AS (SELECT feature, th, sum(hits) AS called FROM h GROUP BY ALL)
SELECT label, feature::INT AS feature, max(round(2 * hits / nullif(called + positives, 0), 9)) AS f1 FROM h JOIN p USING (label) JOIN q USING (feature, th) GROUP BY ALL""")
def a11_concept_f1(spark, sf_dir):
    """Best F1 over thresholds of normalised activations, per concept and feature."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    a = acts(spark, sf_dir).join(e, "vec_id")
    top = a.groupBy("feature").agg(F.max("value").alias("top"))
    t = a.join(F.broadcast(top), "feature").withColumn("th", F.explode(F.array(*(F.lit(x).cast("decimal(3,2)") for x in ("0", "0.15", "0.5", "0.6", "0.8")))))
    hits = t.groupBy("label", "feature", "th").agg(F.sum((F.col("value") > F.col("th") * F.col("top")).cast("long")).alias("hits"))
    called = hits.groupBy("feature", "th").agg(F.sum("hits").alias("called"))
    pos = e.groupBy("label").agg(F.count("*").alias("positives"))
    f1 = F.round(2 * F.col("hits") / F.nullif(F.col("called") + F.col("positives"), F.lit(0)), 9)
    return hits.join(called, ["feature", "th"]).join(pos, "label").groupBy("label", "feature").agg(F.max(f1).alias("f1"))


@query("SELECT round(avg(n), 9) AS mean_l0, 64 - max(u) AS dead FROM (SELECT len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings), (SELECT count(DISTINCT i) AS u FROM embeddings, unnest(range(1, 65)) t(i) WHERE embedding[i] > 0)")
def x06_sparsity(spark, sf_dir):
    """Mean active features per row, and features never active."""
    a = acts(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.size(F.filter("embedding", lambda x: x > 0)).alias("n")).agg(F.round(F.avg("n"), 9).alias("mean_l0"))
    used = e.select(F.posexplode("embedding").alias("i", "x")).filter("x > 0").agg((64 - F.countDistinct("i")).alias("dead"))
    return v.crossJoin(used)


@query("""WITH x AS (SELECT lang, n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS r FROM x),
a AS (SELECT lang, sum(y)::BIGINT AS n1, count(*) - sum(y)::BIGINT AS n0, sum(CASE WHEN y = 1 THEN r END) AS rs FROM r GROUP BY lang)
SELECT lang, n1, n0, CASE WHEN n1 > 0 AND n0 > 0 THEN round((rs - n1 * (n1 + 1) / 2.0) / (n1 * n0), 9) END AS auc FROM a""")
def t05_t06_rank_auc(spark, sf_dir):
    """ROC AUC by rank sums with ties, per language."""
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("quality is not null")
    return scores.rank_auc(t, "n_chars", "quality", "lang").withColumn("auc", F.round("auc", 9))


@query("SELECT c_nationkey, round(corr(c_acctbal, c_custkey), 6) AS pearson FROM customer GROUP BY c_nationkey")
def t07_pearson(spark, sf_dir):
    """Correlation per fold."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.corr("c_acctbal", "c_custkey"), 6).alias("pearson"))


@query(f"SELECT doc_id, CASE WHEN r < 0.8 THEN 'train' WHEN r < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {ROLL.format(seed=42, key='doc_id')} AS r FROM documents)")
def r01_weighted_split(spark, sf_dir):
    """Rows to splits by weight."""
    t = sampling.weighted_split(table(spark, sf_dir, "documents"), F.col("doc_id"), {"train": 0.8, "val": 0.1, "test": 0.1}, 42)
    return t.select("doc_id", "split")


@query(f"SELECT doc_id, source, CASE WHEN r < 0.6 THEN 'train' WHEN r < 0.8 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, source, {ROLL.format(seed=42, key='source')} AS r FROM documents)")
def r03_group_split(spark, sf_dir):
    """Whole groups to splits."""
    t = sampling.weighted_split(table(spark, sf_dir, "documents"), F.col("source"), {"train": 0.6, "val": 0.2, "test": 0.2}, 42)
    return t.select("doc_id", "source", "split")


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {ROLL.format(seed=7, key='doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= ceil(n * 0.1)")
def r18_stratified(spark, sf_dir):
    """A tenth of each stratum."""
    return sampling.stratified(table(spark, sf_dir, "documents"), "lang", "doc_id", 0.1, 7).select("doc_id", "lang")


@query(f"SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {ROLL.format(seed=7, key='doc_id')}, doc_id) AS r FROM labels) WHERE r <= (SELECT ceil(min(n) * 0.5) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))")
def r23_class_balanced(spark, sf_dir):
    """As many rows of each class."""
    return sampling.class_balanced(table(spark, sf_dir, "labels"), "toxic", "doc_id", 0.5, 7).select("doc_id", "toxic")


@query("SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
def j07_members(spark, sf_dir):
    """Rows that are members of another table."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def j08_excluded(spark, sf_dir):
    """Rows that are not."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def j19_tree_walk(spark, sf_dir):
    """Ancestors of each leaf."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey")).select("c_custkey", "n_name", "r_name")


@query(f"WITH {SEQS} SELECT min(doc_id) AS doc_id, seq, count(*) AS copies FROM seqs WHERE seq <> '' GROUP BY seq")
def u04_u06_dedup(spark, sf_dir):
    """Equal sequences: the first id stays."""
    return seqs(spark, sf_dir).filter("seq != ''").groupBy("seq").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "seq", "copies")


@query("SELECT a, b, count(*) AS n FROM (SELECT l_partkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS b FROM lineitem GROUP BY l_partkey) GROUP BY ALL")
def u05_overlap(spark, sf_dir):
    """Overlap of two classes of ids."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(F.col("l_returnflag") == "A").alias("a"), F.max(F.col("l_returnflag") == "R").alias("b"))
    return t.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT event_type, date_part('hour', ts)::INT AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def a23_metric_table(spark, sf_dir):
    """Metric by iteration."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT p_brand, count(*) AS genes, max(p_retailprice) AS top FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 5 GROUP BY p_brand")
def a24_top_genes(spark, sf_dir):
    """The top genes of each set."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).filter("r <= 5").groupBy("p_brand").agg(F.count("*").alias("genes"), F.max("p_retailprice").alias("top"))


@query("SELECT lang, source, n, round(n / sum(n) OVER (PARTITION BY lang), 9) AS share FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)")
def a22_composition(spark, sf_dir):
    """Shares of a covariate."""
    t = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 9))


@query(f"WITH {SEQS} SELECT doc_id, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 9) AS gc FROM seqs WHERE seq <> ''")
def a13_gc(spark, sf_dir):
    """GC share of each sequence."""
    return seqs(spark, sf_dir).filter("seq != ''").select("doc_id", F.round(S.gc_share(F.col("seq")), 9).alias("gc"))
