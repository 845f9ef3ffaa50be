"""Queries of the schedule, genome, graph, batch, score and enrichment operators over views of the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import sequences as S
from weftline.functions import tokens as T
from weftline.operators import batches, enrichment, genome, graph, intervals, matrix, packing, products, sampling, schedules, scores, sequence_tables
from weftline.plans.basics import query
from weftline.plans.biology import ACTS, EXONS, EXPR, ROLL, SEQS, VARIANTS, acts, exons, expr, seqs, table, variants
from weftline.plans.training import IDS, TEXT
from weftline.sources import tables

SIZE = 256
WHOLE = "genome AS (SELECT chrom, string_agg(seq, '' ORDER BY doc_id, seq) AS g, sum(length(seq))::BIGINT AS n FROM (SELECT doc_id, doc_id % 25 AS chrom, seq FROM seqs WHERE length(seq) > 0) GROUP BY chrom)"
WHOLE_VARIANTS = "wide AS (SELECT event_id, user_id % 25 AS chrom, event_id * 7919 % (coalesce(n, 0) + 1) AS pos, event_id % 4 AS alt FROM events LEFT JOIN genome ON chrom = user_id % 25)"
WHOLE_EXONS = "wide AS (SELECT tx, exons.chrom AS chrom, (tx * 7919 + s) % (coalesce(n, 0) + 1) AS s, (tx * 7919 + s) % (coalesce(n, 0) + 1) + e - s AS e FROM exons LEFT JOIN genome USING (chrom))"


def walked(base: str) -> str:
    """SQL of ``permuted``: ``base`` has ``i, n, key``; ``walked`` adds ``x``."""
    q = "((('0x' || substr(md5(key || '|' || r::VARCHAR), 1, 13))::BIGINT % n - x) % n + n) % n AS q"
    step = f"SELECT * EXCLUDE (x, r, q), CASE WHEN substr(md5(key || '|' || r::VARCHAR || '|' || greatest(x, q)::VARCHAR), 1, 1) >= '8' THEN q ELSE x END AS x, r + 1 AS r FROM (SELECT *, {q} FROM walk WHERE r < {schedules.ROUNDS})"
    return f"walk AS (SELECT *, i::BIGINT AS x, 0 AS r FROM {base} UNION ALL {step}), walked AS (SELECT * EXCLUDE (r) FROM walk WHERE r = {schedules.ROUNDS})"


def whole_genome(spark, sf_dir):
    """The whole sequences of all documents as 25 contigs, in chunks of 256 bases, and ``chrom, n``: how long each contig is."""
    t = seqs(spark, sf_dir).withColumn("chrom", F.col("doc_id") % 25)
    return genome.contig_chunks(t, "chrom", "doc_id", "seq", SIZE), t.filter("length(seq) > 0").groupBy("chrom").agg(F.sum(F.length("seq").cast("long")).alias("n"))


def spread(places, sizes, key, *at):
    """``places`` moved by a stride of ``key`` over the whole contig; the first of ``at`` is the place that is wrapped."""
    t = places.join(F.broadcast(sizes), "chrom", "left")  # 25 rows
    first = (F.col(key) * 7919 + F.col(at[0])) % (F.coalesce("n", F.lit(0)) + 1)
    return t.withColumns({x: first + F.col(x) - F.col(at[0]) for x in at}).drop("n")


@query(f"WITH RECURSIVE b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n, '11' AS key FROM orders), {walked('b')} SELECT o_orderkey, x AS place FROM walked")
def r08_permutation(spark, sf_dir):
    """A keyed permutation of all orders, without a sort."""
    rows = matrix.dense_index(table(spark, sf_dir, "orders"), "o_orderkey")
    n = rows.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(n)).select("o_orderkey", schedules.permuted(F.col("row_index"), F.col("n"), F.lit("11")).alias("place"))


@query(f"WITH RECURSIVE a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), c AS (SELECT count(*) AS n, count(*) // 64 * 64 AS u FROM part), b AS (SELECT k AS place, k // u AS epoch, k % u AS i, n, '5:' || (k // u)::VARCHAR AS key FROM c, unnest(range(100, 3 * u)) t(k)), {walked('b')} SELECT place, epoch, p_partkey FROM walked JOIN a ON a.i = x")
def r09_r11_epochs(spark, sf_dir):
    """Three epochs of whole batches of 64, resumed after 100 samples."""
    rows = matrix.dense_index(table(spark, sf_dir, "part"), "p_partkey")
    return schedules.epoch_schedule(rows, "row_index", 5, epochs=3, consumed=100, batch=64).select("place", "epoch", "p_partkey")


@query(f"WITH RECURSIVE b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n, '3' AS key FROM customer), {walked('b')}, e AS (SELECT *, floor(n * 0.8::DOUBLE)::BIGINT AS a, floor(n * 0.1::DOUBLE)::BIGINT AS v FROM walked) SELECT c_custkey, CASE WHEN x < a THEN 'train' WHEN x < a + v THEN 'val' ELSE 'test' END AS split, CASE WHEN i < a THEN 'train' WHEN i < a + v THEN 'val' ELSE 'test' END AS in_order FROM e")
def r05_r07_splits(spark, sf_dir):
    """Rows cut by shares, in a permuted order and in their own."""
    rows = matrix.dense_index(table(spark, sf_dir, "customer"), "c_custkey")
    shares = {"train": 0.8, "val": 0.1, "test": 0.1}
    t = schedules.permutation_split(rows, "row_index", shares, 3).withColumnRenamed("split", "drawn")
    return schedules.contiguous_split(t, "row_index", shares).select("c_custkey", F.col("drawn").alias("split"), F.col("split").alias("in_order"))


@query(f"WITH {SEQS} SELECT doc_id, length(seq)::INT AS n FROM seqs WHERE length(seq) <= 500 ORDER BY {ROLL.format(seed=8, key='doc_id')}, doc_id LIMIT 50")
def r12_uniform_sample(spark, sf_dir):
    """Fifty sequences of up to 500 bases."""
    t = seqs(spark, sf_dir).select("doc_id", F.length("seq").alias("n"))
    return schedules.uniform_sample(t, "doc_id", F.col("n") <= 500, 50, 8)


@query(f"WITH {SEQS}, i AS (SELECT doc_id, length(seq) AS n, row_number() OVER (ORDER BY doc_id) AS scanned FROM seqs) SELECT doc_id, scanned FROM i WHERE n <= 200 ORDER BY scanned LIMIT 25")
def r14_first_records(spark, sf_dir):
    """The first 25 short sequences, and how many had been read."""
    rows = matrix.dense_index(table(spark, sf_dir, "documents"), "doc_id").join(seqs(spark, sf_dir).select("doc_id", F.length("seq").alias("n")), "doc_id")
    return schedules.first_records(rows, "row_index", F.col("n") <= 200, 25).select("doc_id", "scanned")


@query(f"WITH {SEQS}, {WHOLE}, {EXONS}, {WHOLE_EXONS}, x AS (SELECT DISTINCT * FROM wide), r AS (SELECT tx, string_agg(coalesce(substr(g, (s + 1)::INT, (e - s)::INT), ''), '' ORDER BY s, e) AS cds FROM x LEFT JOIN genome USING (chrom) GROUP BY tx) SELECT tx, length(cds)::INT AS n_bases, CASE WHEN tx % 2 = 1 THEN reverse(translate(cds, 'ACGT', 'TGCA')) ELSE cds END AS cds FROM r")
def a02_p04_spliced(spark, sf_dir):
    """Coding sequences read from all bases of all documents, exons over the whole contigs."""
    whole, sizes = whole_genome(spark, sf_dir)
    t = spread(exons(spark, sf_dir), sizes, "tx", "s", "e").withColumn("minus", F.col("tx") % 2 == 1)
    return genome.spliced(t, whole, "tx", "chrom", "s", "e", "minus", SIZE)


@query(f"WITH {SEQS}, {WHOLE}, {WHOLE_VARIANTS} SELECT event_id, chrom, pos, nullif(substr(g, (pos + 1)::INT, 1), '') AS ref, coalesce(substr(g, (pos + 1)::INT, 1) = substr('ACGT', (alt + 1)::INT, 1), false) AS unchanged FROM wide LEFT JOIN genome USING (chrom)")
def j18_reference_base(spark, sf_dir):
    """The base at variants over the whole contigs, from all bases of all documents."""
    whole, sizes = whole_genome(spark, sf_dir)
    t = genome.reference_base(spread(variants(spark, sf_dir).withColumn("pos", F.lit(0)), sizes, "event_id", "pos"), whole, "chrom", "pos", SIZE)
    alt = F.substring(F.lit("ACGT"), (F.col("alt") + 1).cast("int"), F.lit(1))
    return t.select("event_id", "chrom", "pos", "ref", F.coalesce(F.col("ref") == alt, F.lit(False)).alias("unchanged"))


@query(f"WITH {SEQS}, {WHOLE}, {WHOLE_VARIANTS}, w AS (SELECT event_id, greatest(pos - 16, 0) AS f, pos, substr('ACGT', (alt + 1)::INT, 1) AS a, g FROM wide JOIN genome USING (chrom) WHERE pos < length(g)), r AS (SELECT *, substr(g, (f + 1)::INT, (pos + 17 - f)::INT) AS ref_window FROM w) SELECT event_id, ref_window, substr(ref_window, 1, (pos - f)::INT) || a || substr(ref_window, (pos - f + 2)::INT) AS alt_window FROM r")
def p37_variant_windows(spark, sf_dir):
    """Windows around variants over the whole contigs, from all bases of all documents."""
    whole, sizes = whole_genome(spark, sf_dir)
    v = spread(variants(spark, sf_dir).withColumn("pos", F.lit(0)), sizes, "event_id", "pos").withColumn("alt", F.substring(F.lit("ACGT"), (F.col("alt") + 1).cast("int"), F.lit(1)))
    return genome.variant_windows(v, whole, ["event_id"], "chrom", "pos", "alt", 16, SIZE)


@query("SELECT gene, min_by(tx, (p, tx)) AS tx FROM (SELECT o_custkey AS gene, o_orderkey AS tx, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 END AS p FROM orders) WHERE p IS NOT NULL GROUP BY gene")
def j17_canonical(spark, sf_dir):
    """The transcript of the first tag per gene."""
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gene"), F.col("o_orderkey").alias("tx"), (F.col("o_orderkey") % 5 == 0).alias("mane"), (F.col("o_orderkey") % 3 == 0).alias("main"))
    return genome.canonical(t, "gene", "tx", "mane", "main")


@query("SELECT l_partkey, count(DISTINCT k) AS covered FROM lineitem, unnest(range(l_orderkey % 500, l_orderkey % 500 + 10 + l_linenumber)) t(k) GROUP BY l_partkey")
def a12_covered_length(spark, sf_dir):
    """Places under the union of a concept's intervals."""
    t = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") % 500).alias("s"), (F.col("l_orderkey") % 500 + 10 + F.col("l_linenumber")).alias("e"))
    return genome.covered_length(t, ["l_partkey"], "s", "e")


@query("SELECT user_id % 25 AS chrom, 1 + event_id * 7919 % 8000 AS pos, min(event_id) AS event_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS labels FROM events GROUP BY ALL")
def a17_labels(spark, sf_dir):
    """The first record and the sorted labels of each place."""
    t = variants(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    return t.groupBy("chrom", "pos").agg(F.min("event_id").alias("event_id"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("labels"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def a21_group_counts(spark, sf_dir):
    """Rows and distinct sources per group."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0),
w AS (SELECT p_partkey AS node, p_partkey AS cur, 0 AS depth FROM part UNION SELECT node, parent, depth + 1 FROM w JOIN e ON child = cur WHERE cur % 7 <> 3),
h AS (SELECT node, min_by(cur, (depth, cur)) AS ancestor, min(depth) AS depth FROM w WHERE cur % 7 = 3 GROUP BY node) SELECT p_partkey AS node, ancestor, depth FROM part LEFT JOIN h ON node = p_partkey""")
def j20_nearest_listed(spark, sf_dir):
    """The nearest listed ancestor of each part in a graph with two ways up."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    up = F.explode(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3)))
    edges = p.filter("p_partkey > 0").select(F.col("p_partkey").alias("child"), up.alias("parent")).distinct()
    nodes = p.select(F.col("p_partkey").alias("node"))
    return graph.nearest_listed(nodes, edges, nodes.filter("node % 7 = 3"))


@query("SELECT c_custkey, (SELECT min_by(key, k) FROM (SELECT n_nationkey AS k, (n_nationkey * 37)::VARCHAR AS key FROM nation) WHERE contains(c_name, key)) AS key FROM customer")
def j09_first_contained(spark, sf_dir):
    """The first key that a name contains."""
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 37).cast("string").alias("key"))
    return graph.first_contained(table(spark, sf_dir, "customer"), "c_custkey", "c_name", keys, "key", "k")


@query("WITH b AS (SELECT c_nationkey AS block, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT block, (sum(n) OVER (ORDER BY block))::BIGINT - n AS start, (sum(n) OVER (ORDER BY block))::BIGINT AS stop FROM b), i AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row_index FROM customer) SELECT c_custkey, row_index, block, row_index - start AS at FROM i JOIN s ON row_index >= start AND row_index < stop")
def j14_block_of_row(spark, sf_dir):
    """The feature block of each row, from the blocks' sizes."""
    c = table(spark, sf_dir, "customer")
    bounds = matrix.block_bounds(c.groupBy(F.col("c_nationkey").alias("block")).agg(F.count("*").alias("n")), "block", "n").withColumn("one", F.lit(1))
    t = intervals.point_in_interval(matrix.dense_index(c, "c_custkey").withColumn("one", F.lit(1)), bounds, "one", "row_index", "start", "stop")
    return t.select("c_custkey", "row_index", "block", (F.col("row_index") - F.col("start")).alias("at"))


@query(f"WITH {EXPR}, w AS (SELECT DISTINCT l_orderkey AS cell, l_partkey - l_linenumber % 2 AS gene FROM lineitem) SELECT cell, gene, coalesce(value, 0) AS value FROM w LEFT JOIN expr USING (cell, gene)")
def j12_j15_lookup(spark, sf_dir):
    """Values at given places, zero where none is stored."""
    t = table(spark, sf_dir, "lineitem")
    wanted = t.select(F.col("l_orderkey").alias("cell"), (F.col("l_partkey") - F.col("l_linenumber") % 2).alias("gene"))
    entries = t.select(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("value"))
    return matrix.lookup(wanted, entries, "cell", "gene", "value", 0.0).withColumn("value", F.col("value").cast("long"))


@query(f"WITH {EXPR}, g AS (SELECT cell, gene % 32 AS c, sum(value) AS v FROM expr GROUP BY ALL), d AS (SELECT DISTINCT cell FROM g) SELECT cell, string_agg(coalesce(v, 0)::BIGINT::VARCHAR, ',' ORDER BY k) AS entries FROM (d CROSS JOIN (SELECT unnest(range(32)) AS k)) p LEFT JOIN g ON g.cell = p.cell AND g.c = p.k GROUP BY p.cell".replace("SELECT cell, string_agg", "SELECT p.cell, string_agg"))
def x01_dense_rows(spark, sf_dir):
    """Rows of a matrix folded to 32 columns, zeros filled in."""
    t = expr(spark, sf_dir).select("cell", (F.col("gene") % 32).alias("gene"), "value")
    return matrix.dense_rows(t, "cell", "gene", "value", 32).select("cell", T.joined(F.col("values")).alias("entries"))


@query(f"WITH {ACTS}, f AS (SELECT label, min(vec_id) AS ref FROM embeddings GROUP BY label), d AS (SELECT a.vec_id, a.feature, abs(a.value - b.value) AS d FROM acts a JOIN f USING (label) JOIN acts b ON b.vec_id = ref AND b.feature = a.feature) SELECT vec_id, max(d) AS whole, max(d) FILTER (abs(feature - vec_id % 64) <= 3) AS near FROM d GROUP BY vec_id")
def a14_j16_deltas(spark, sf_dir):
    """Largest difference from a group's reference row, in all and within three places of a site."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    a = acts(spark, sf_dir)
    ref = a.join(e.groupBy("label").agg(F.min("vec_id").alias("vec_id")), "vec_id").select("label", "feature", F.col("value").alias("base"))
    d = a.join(e, "vec_id").join(ref, ["label", "feature"]).withColumn("d", F.abs(F.col("value") - F.col("base")))
    d = matrix.near_maximum(d, "vec_id", "feature", "d", 3, "near")
    return d.groupBy("vec_id").agg(F.max("d").alias("whole"), F.max(F.when(F.col("feature") == F.col("vec_id") % 64, F.col("near"))).alias("near"))


@query("WITH v AS (SELECT embedding[i]::DOUBLE AS a, floor(embedding[i]::DOUBLE * 10) / 10 AS b FROM embeddings, unnest(range(1, 65)) t(i)) SELECT round(avg((a - b) * (a - b)), 9) AS mse, round(var_pop(a), 9) AS variance, round(1 - avg((a - b) * (a - b)) / var_pop(a), 6) AS explained FROM v")
def x04_reconstruction(spark, sf_dir):
    """How well vectors cut to one decimal give back the whole."""
    t = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("a"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 10) / 10).alias("b"))
    return scores.reconstruction(t, "a", "b").select(F.round("mse", 9).alias("mse"), F.round("variance", 9).alias("variance"), F.round("explained", 6).alias("explained"))


def vectors(spark, sf_dir):
    """``vec_id, v``: positive parts in millionths."""
    micro = F.transform("embedding", lambda x: (F.greatest(x.cast("double"), F.lit(0.0)).cast("decimal(18,6)") * 1000000).cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", micro.alias("v"))


def centres(spark, sf_dir):
    """``label, v``: the mean activations of each label in millionths, to four places."""
    a = acts(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    mean = a.groupBy("label", "feature").agg((F.round(F.avg(F.col("value").cast("double")), 4).cast("decimal(18,6)") * 1000000).cast("long").alias("value"))
    return matrix.dense_rows(mean, "label", "feature", "value", 64).withColumnRenamed("values", "v").withColumn("v", F.col("v").cast("array<long>"))


@query(f"WITH {ACTS}, c AS (SELECT label, feature, round(avg(value::DOUBLE), 4)::DECIMAL(18,6) AS w FROM acts GROUP BY ALL), p AS (SELECT c.label, vec_id, sum(w * value) AS score FROM c JOIN acts a USING (feature) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS t, row_number() OVER (PARTITION BY label ORDER BY score, vec_id) AS b FROM p) SELECT label, 'top' AS side, t::INT AS rank, vec_id FROM r WHERE t <= 3 UNION ALL SELECT label, 'bottom', b::INT, vec_id FROM r WHERE b <= 3")
def x05_e05_extremes(spark, sf_dir):
    """The rows that score highest and lowest with each label's centre."""
    return products.extreme_products(centres(spark, sf_dir), vectors(spark, sf_dir), "label", "vec_id", "v", 3).select("label", "side", "rank", "vec_id")


@query("SELECT event_type, round(1 - (avg(value + 1) - avg(value)) / (avg(value * 3) - avg(value) + 1e-8), 6) AS recovered FROM events GROUP BY event_type")
def x07_loss_recovered(spark, sf_dir):
    """The share of a loss gap won back."""
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("a"), F.avg(F.col("value") + 1).alias("b"), F.avg(F.col("value") * 3).alias("c"))
    return m.select("event_type", F.round(scores.loss_recovered(F.col("a"), F.col("b"), F.col("c")), 6).alias("recovered"))


@query("WITH l AS (SELECT label, embedding[label + 1]::DOUBLE - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) AS p FROM embeddings) SELECT label, count(*) AS tokens, round(avg(-p), 6) AS cross_entropy, round(exp(avg(-p)), 5) AS perplexity FROM l GROUP BY label")
def t01_t02_losses(spark, sf_dir):
    """Cross entropy and perplexity of the labels under vectors taken as logits."""
    t = table(spark, sf_dir, "embeddings").select("label", scores.log_probability(F.col("embedding"), F.col("label")).alias("p"))
    return scores.token_losses(t, "label", "p").select("label", "tokens", F.round("cross_entropy", 6).alias("cross_entropy"), F.round("perplexity", 5).alias("perplexity"))


@query("SELECT count(*) AS tokens, round(avg((list_position(embedding, list_max(embedding)) - 1 = label)::INT), 9) AS accuracy FROM embeddings WHERE label <> 3")
def t08_token_accuracy(spark, sf_dir):
    """How often the largest logit is the label; label 3 is ignored."""
    return scores.token_accuracy(table(spark, sf_dir, "embeddings"), "embedding", "label", 3).withColumn("accuracy", F.round("accuracy", 9))


def enriched(sets: str) -> str:
    """SQL of the enrichment of ``sets`` (db, term, p_partkey) in parts of each type by price: ``found`` has es, p and q."""
    return f"""WITH RECURSIVE g AS (SELECT p_type AS feature, p_partkey, p_retailprice::DECIMAL(18,2) AS w, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank, count(*) OVER (PARTITION BY p_type) AS n FROM part),
sets AS ({sets}), h AS (SELECT * FROM (SELECT g.*, db, term, count(*) OVER (PARTITION BY feature, db, term) AS hits FROM g JOIN sets USING (p_partkey)) WHERE hits >= 3), b AS (SELECT feature, db, term, hits, n, rank AS i, q AS perm, '4:' || q::VARCHAR AS key FROM h, unnest(range(0, 21)) t(q)), {walked('b')},
s AS (SELECT feature, db, term, hits, n, perm, CASE WHEN perm = 0 THEN i ELSE x END AS rank FROM walked), m AS (SELECT s.*, w FROM s JOIN (SELECT feature, rank, w FROM g) USING (feature, rank)),
u AS (SELECT *, (sum(w) OVER (PARTITION BY feature, db, term, perm))::DOUBLE AS total, (sum(w) OVER r)::DOUBLE AS run, (rank + 1 - count(*) OVER r) / greatest(n - hits, 1) AS missed FROM m WINDOW r AS (PARTITION BY feature, db, term, perm ORDER BY rank ROWS UNBOUNDED PRECEDING)),
v AS (SELECT feature, db, term, perm, any_value(hits) AS hits, max(run / total - missed) AS up, min((run - w::DOUBLE) / total - missed) AS down FROM u GROUP BY feature, db, term, perm), e AS (SELECT *, CASE WHEN up >= -down THEN up ELSE down END AS e FROM v),
o AS (SELECT feature, db, term, hits, e AS es FROM e WHERE perm = 0), p AS (SELECT feature, db, term, o.hits, es, (1 + count(*) FILTER (perm > 0 AND CASE WHEN es >= 0 THEN e >= es ELSE e <= es END)) / 21 AS p FROM o JOIN e USING (feature, db, term) GROUP BY ALL),
k AS (SELECT *, p * count(*) OVER (PARTITION BY feature, db) / count(*) OVER (PARTITION BY feature, db ORDER BY p) AS t FROM p), found AS (SELECT feature, db, term, hits, es, p, least(1, min(t) OVER (PARTITION BY feature, db ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k)"""


BRANDS = "SELECT 'brand' AS db, p_brand AS term, p_partkey FROM part"
BOTH = f"{BRANDS} UNION ALL SELECT 'size', 'S' || (p_size // 10)::VARCHAR, p_partkey FROM part"


def prices(p):
    return p.select(F.col("p_type").alias("feature"), "p_partkey", F.col("p_retailprice").cast("decimal(18,2)").alias("score"))


@query(f"{enriched(BOTH)}, chosen AS (SELECT * FROM found WHERE q < 0.4 QUALIFY row_number() OVER (PARTITION BY feature, db ORDER BY q, abs(es) DESC, term) = 1) SELECT feature, db, term, hits, round(es, 9) AS es, round(p, 9) AS p, round(q, 9) AS q, row_number() OVER (PARTITION BY feature ORDER BY q, abs(es) DESC, db, term) = 1 AS best FROM chosen")
def t10_best_per_database(spark, sf_dir):
    """The best set of brands, and of sizes, for each type, and which of the two is better."""
    p = table(spark, sf_dir, "part")
    sets = p.select(F.lit("brand").alias("db"), F.col("p_brand").alias("term"), "p_partkey").unionByName(p.select(F.lit("size").alias("db"), F.concat(F.lit("S"), F.floor(F.col("p_size") / 10).cast("string")).alias("term"), "p_partkey"))
    t = enrichment.enrichment(prices(p), sets, "feature", "p_partkey", "score", "term", 20, 4, least=3, database="db")
    return enrichment.best_sets(t, "feature", "db", "term", 0.4).select("feature", "db", "term", "hits", *(F.round(c, 9).alias(c) for c in ("es", "p", "q")), "best")


@query(f"{enriched(BRANDS)} SELECT feature, term AS p_brand, hits, round(es, 9) AS es, round(p, 9) AS p, round(q, 9) AS q FROM found")
def t10_enrichment(spark, sf_dir):
    """Enrichment of brands in each type's parts by price, with twenty permutations."""
    p = table(spark, sf_dir, "part")
    t = enrichment.enrichment(prices(p), p, "feature", "p_partkey", "score", "p_brand", 20, 4, least=3)
    return t.select("feature", "p_brand", "hits", *(F.round(c, 9).alias(c) for c in ("es", "p", "q")))


@query("WITH t AS (SELECT p_type, split_part(p_name, ' ', 1) AS family FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 20), n AS (SELECT p_type, family, count(*) AS n FROM t GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY p_type) AS s, row_number() OVER (PARTITION BY p_type ORDER BY (length(family) < 2)::INT, n DESC, family) AS k FROM n) SELECT p_type, family, n FROM a WHERE k = 1 AND length(family) >= 2 AND n >= 0.2 * s AND n >= 3")
def a24_families(spark, sf_dir):
    """The commonest family among the twenty dearest parts of each type."""
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    top = table(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).filter("r <= 20").withColumn("family", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return enrichment.best_family(top, "p_type", "family", 0.2, 3)


@query(f"WITH {ACTS}, h AS (SELECT feature, vec_id, row_number() OVER (PARTITION BY feature ORDER BY value DESC, vec_id) AS r FROM acts WHERE value > 0), z AS (SELECT feature, vec_id, row_number() OVER (PARTITION BY feature ORDER BY md5('6|' || feature::VARCHAR || '|' || vec_id::VARCHAR), vec_id) AS r FROM acts WHERE value <= 0) SELECT feature::INT AS feature, vec_id, 'high' AS side, r::INT AS rank FROM h WHERE r <= 5 UNION ALL SELECT feature::INT, vec_id, 'zero', r::INT FROM z WHERE r <= 5")
def e04_contrast_rows(spark, sf_dir):
    """Five highest rows of each feature, and five at zero."""
    return enrichment.contrast_rows(acts(spark, sf_dir), "vec_id", "feature", "value", 5, 5, 6)


@query(f"""WITH RECURSIVE {SEQS}, h AS (SELECT v, n, row_number() OVER (ORDER BY v) AS rn FROM (SELECT length(seq)::BIGINT AS v, count(*) AS n FROM seqs GROUP BY 1)),
w AS (SELECT rn, v AS low, n AS items, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS c FROM h WHERE rn = 1 UNION ALL SELECT h.rn, CASE WHEN NOT shut THEN low WHEN v - low >= 200 THEN low + (v - low) // 200 * 200 ELSE v END, CASE WHEN shut THEN n ELSE items + n END, CASE WHEN shut THEN low END, CASE WHEN shut THEN v END, CASE WHEN shut THEN items END FROM (SELECT w.*, v, n, v - low >= 200 OR items >= 20 AS shut, h.rn AS next FROM w JOIN h ON h.rn = w.rn + 1) x JOIN (SELECT rn FROM h) h ON h.rn = x.next),
s AS (SELECT a, b, c FROM w WHERE a IS NOT NULL UNION ALL SELECT low, (SELECT max(v) + 1 FROM h), items FROM w WHERE rn = (SELECT max(rn) FROM h))
SELECT row_number() OVER (ORDER BY a, k) - 1 AS bucket, a + 200 * (k - 1) AS low, CASE WHEN b - a >= 200 THEN a + 200 * k ELSE b END AS high, CASE WHEN k = 1 THEN c ELSE 0 END AS items FROM s, unnest(range(1, greatest((b - a) // 200, 1) + 1)) t(k)""")
def i10_size_buckets(spark, sf_dir):
    """Buckets of sequence lengths with 20 rows or a width of 200."""
    return batches.size_buckets(seqs(spark, sf_dir).select(F.length("seq").alias("n")), "n", 200, 20)


@query(f"WITH {SEQS}, b AS (SELECT doc_id, CASE WHEN n < 100 THEN 0 WHEN n < 400 THEN 1 WHEN n < 2000 THEN 2 END::INT AS bucket FROM (SELECT doc_id, length(seq) AS n FROM seqs)) SELECT bucket, doc_id, ((row_number() OVER (PARTITION BY bucket ORDER BY {ROLL.format(seed=1, key='doc_id')}, doc_id) - 1) // CASE bucket WHEN 0 THEN 64 WHEN 1 THEN 16 ELSE 4 END)::BIGINT AS batch FROM b WHERE bucket IS NOT NULL")
def i12_bucket_batches(spark, sf_dir):
    """Batches of like lengths, larger where sequences are short."""
    return batches.bucket_batches(seqs(spark, sf_dir), "doc_id", F.length("seq"), [0, 100, 400, 2000], [64, 16, 4], 1)


@query()
def i07_greedy_chunks(spark, sf_dir):
    """Chunks of up to 5000 bases in each source's stretches of 1000 ids."""
    t = seqs(spark, sf_dir).select("source", F.floor(F.col("doc_id") / 1000).alias("stretch"), "doc_id", F.length("seq").alias("n"))
    return batches.greedy_chunks(t, ["source", "stretch"], "doc_id", "n", 5000)


@query(f"WITH {SEQS}, {IDS}, t AS (SELECT doc_id, ids, len(ids) AS n, (ceil(max(len(ids)) OVER (PARTITION BY doc_id // 16) / 8) * 8)::INT AS m FROM ids) SELECT doc_id, n::INT AS tokens, {TEXT.format('list_concat(ids, list_transform(range(m - n), lambda x: 3))')} AS ids FROM t")
def i18_padded(spark, sf_dir):
    """Batches of sixteen filled to their longest, in eights."""
    t = seqs(spark, sf_dir).select(F.floor(F.col("doc_id") / 16).alias("batch"), "doc_id", T.codon_ids(F.col("seq")).alias("ids"))
    t = batches.padded(t, ["batch"], "ids", T.PAD, 8)
    return t.select("doc_id", F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("tokens"), T.joined(F.col("ids")).alias("ids"))


@query(f"WITH {SEQS}, t AS (SELECT doc_id, ceil(length(seq) / 8)::INT AS step FROM seqs) SELECT doc_id, least(k, 7 - k)::INT AS rank, k::INT AS part, (k * step)::INT AS start, ((k + 1) * step)::INT AS stop FROM t, unnest(range(8)) u(k) WHERE step > 0")
def i19_zigzag(spark, sf_dir):
    """Slices of each sequence for four ranks."""
    return batches.zigzag(seqs(spark, sf_dir), "doc_id", F.length("seq"), 4)


@query(f"WITH {SEQS}, t AS (SELECT doc_id, seq, '|d__' || coalesce(lang, 'None') || ';s__' || coalesce(source, 'None') || '|' AS tag FROM seqs) SELECT doc_id, coalesce(list_aggregate(list_transform(range(0, length(seq), 200 - length(tag)), lambda k: repeat('0', length(tag)) || repeat('1', length(substr(seq, (k + 1)::INT, (200 - length(tag))::INT)))), 'string_agg', ''), '') || '1' AS mask FROM t")
def m06_tag_mask(spark, sf_dir):
    """Lineage tags found again in tagged sequences."""
    t = seqs(spark, sf_dir).select("doc_id", "seq", T.lineage_tag({"d": F.col("lang"), "s": F.col("source")}, F.col("doc_id"), 5).alias("tag"))
    ids = T.byte_ids(T.inject_tag(F.col("seq"), F.col("tag"), 200))
    return t.select("doc_id", F.array_join(F.transform(T.tag_mask(ids), lambda x: x.cast("string")), "").alias("mask"))


def codon_windows(spark, sf_dir, window, specials):
    """``doc_id, source, window_no, x``: every codon of every document once, in windows that leave room for special tokens."""
    n = F.floor(F.length("seq") / 3).cast("int")
    t = seqs(spark, sf_dir).select("doc_id", "source", T.codon_ids(F.col("seq")).alias("ids"), n.alias("n"))
    t = t.select("*", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(window - specials))).alias("window_no", "start"))
    return t.select("doc_id", "source", "window_no", F.slice("ids", F.col("start") + 1, window - specials).alias("x"))


@query(f"WITH {SEQS}, {IDS}, w AS (SELECT doc_id, k // 126 AS window_no, ids[k + 1:k + 126] AS x FROM ids, unnest(range(0, len(ids), 126)) t(k)) SELECT doc_id, window_no::INT AS window_no, {TEXT.format('list_concat([0], x[1:(doc_id % len(x))::INT], [4], x[(doc_id % len(x) + 2)::INT:], [1])')} AS ids FROM w")
def m04_variant_input(spark, sf_dir):
    """One codon masked in each window of 126 codons of every sequence; a sequence without a codon has none to mask."""
    t = codon_windows(spark, sf_dir, 128, 2).filter(F.size("x") > 0)
    row = F.concat(F.array(F.lit(T.CLS)), "x", F.array(F.lit(T.SEP)))
    return t.select("doc_id", "window_no", T.joined(T.variant_input(row, F.col("doc_id") % F.size("x"), F.lit(T.MASK))).alias("ids"))


@query(f"WITH {SEQS}, {IDS}, w AS (SELECT doc_id, source, k // 60 AS window_no, ids[k + 1:k + 60] AS x FROM ids, unnest(range(0, greatest(len(ids), 1), 60)) t(k)) SELECT doc_id, window_no::INT AS window_no, '<ctrl_' || lower(source) || '>' AS control, {TEXT.format('list_concat([0, 70, 2], x, [1], list_transform(range(60 - len(x)), lambda i: 3))')} AS ids FROM w")
def p16_control_tags(spark, sf_dir):
    """A control tag before each window of 60 codons of every sequence."""
    t = codon_windows(spark, sf_dir, 64, 4).withColumn("control", T.control_name(F.concat("source", F.lit("__x"))))
    return t.select("doc_id", "window_no", "control", T.joined(T.headed(F.col("x"), [0, 70, 2], [1], T.PAD, 64)).alias("ids"))


@query(f"WITH {SEQS}, n AS (SELECT doc_id, seq, length(seq) AS n FROM seqs), w AS (SELECT doc_id, k AS window_no, substr(seq, (k * 94 + 1)::INT, 126) AS s FROM n, unnest(range(0, 1 + ceil(greatest(n - 126, 0) / 94)::BIGINT)) t(k)) SELECT doc_id, window_no::INT AS window_no, {TEXT.format('list_concat([-100], list_transform(range(1, length(s) + 1), lambda i: CASE WHEN instr(chr(65) || chr(67) || chr(71), substr(s, i::INT, 1)) > 0 THEN instr(chr(65) || chr(67) || chr(71), substr(s, i::INT, 1)) - 1 ELSE -100 END), [-100])')} AS labels FROM w")
def m07_window_labels(spark, sf_dir):
    """Labels of the letters of overlapping windows; T counts as unknown."""
    t = packing.token_windows(seqs(spark, sf_dir), "doc_id", F.length("seq"), 128, 2, 32).join(seqs(spark, sf_dir).select("doc_id", "seq"), "doc_id")
    return t.select("doc_id", "window_no", T.joined(T.class_labels(F.col("seq"), "ACG", F.col("start"), F.col("stop"))).alias("labels"))


@query("SELECT n_nationkey::VARCHAR AS tax_id, n_name AS name, '' AS unique_name, 'scientific name' AS name_class FROM nation")
def s16_taxonomy_dump(spark, sf_dir):
    """Fields of a taxonomy dump; its lines are written from the nations."""
    line = F.concat(F.concat_ws("\t|\t", F.col("n_nationkey").cast("string"), "n_name", F.lit(""), F.lit("scientific name")), F.lit("\t|"))
    return tables.parse_dump(table(spark, sf_dir, "nation").select(line.alias("value")), ["tax_id", "name", "unique_name", "name_class"])


@query("SELECT DISTINCT 'GO:' || p_partkey AS child, 'GO:' || (p_partkey // d) AS parent FROM part, (SELECT unnest([2, 3]) AS d) WHERE p_partkey > 0 AND p_partkey % 10 <> 9")
def s25_term_edges(spark, sf_dir):
    """Edges of a term graph; its stanzas are written from the parts, every tenth obsolete."""
    p = F.col("p_partkey")
    up = F.when(p > 0, F.concat(F.lit("is_a: GO:"), F.floor(p / 2).cast("string"), F.lit(" ! x\nis_a: GO:"), F.floor(p / 3).cast("string"), F.lit("\n"))).otherwise("")
    stanza = F.concat(F.lit("id: GO:"), p.cast("string"), F.lit("\nname: "), "p_name", F.lit("\n"), up, F.when(p % 10 == 9, "is_obsolete: true\n").otherwise(""))
    return tables.term_edges(tables.parse_terms(table(spark, sf_dir, "part").select(stanza.alias("value")))).distinct()


@query("WITH l AS (SELECT CASE p_size % 4 WHEN 0 THEN 'model.encoder.layers.' || p_size || '.' || p_brand WHEN 1 THEN 'model.lm_head.' || p_partkey WHEN 2 THEN 'model.embedding.' || p_partkey ELSE 'model.norm.' || p_partkey END AS layer, p_size AS s FROM part) SELECT 'encoder' AS part, s AS number, min(layer) AS layer FROM l WHERE s % 4 = 0 GROUP BY s UNION ALL SELECT CASE s % 4 WHEN 1 THEN 'head' WHEN 2 THEN 'embedding' ELSE 'other' END, NULL, layer FROM l WHERE s % 4 > 0")
def s24_layer_names(spark, sf_dir):
    """Layers named in log lines; the lines are written from the parts."""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    kind = F.col("p_size") % 4
    name = F.when(kind == 0, F.concat(F.lit("model.encoder.layers."), s, F.lit("."), "p_brand")).when(kind == 1, F.concat(F.lit("model.lm_head."), k)).when(kind == 2, F.concat(F.lit("model.embedding."), k)).otherwise(F.concat(F.lit("model.norm."), k))
    return tables.parse_layers(table(spark, sf_dir, "part").select(F.concat(F.lit("INFO Assigned layer name: "), name).alias("value")))


@query("SELECT p_brand, min_by(p_size, p_partkey) AS p_size FROM part GROUP BY p_brand")
def s26_gene_scores(spark, sf_dir):
    """The first score of each gene."""
    return tables.gene_scores(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_partkey")


@query(f"WITH {SEQS}, n AS (SELECT doc_id, CASE WHEN length(seq) < 128 THEN 1 ELSE 1 + (length(seq) - 128) // 96 END AS n FROM seqs) SELECT doc_id, k::INT AS window_no, doc_id::VARCHAR || CASE WHEN n > 1 THEN '_' || k::VARCHAR ELSE '' END AS row_id FROM n, unnest(range(0, n)) t(k)")
def k12_window_rows(spark, sf_dir):
    """Output ids of windows: the record's, numbered where it has several."""
    t = sequence_tables.windows(seqs(spark, sf_dir), "doc_id", "seq", 128, 96)
    return tables.numbered_windows(t, "doc_id", "window_no").select("doc_id", "window_no", "row_id")


@query("SELECT event_id, 'T' || user_id AS transcript, (1 + event_id % 900)::INT AS pos, substr('ACGT', (1 + event_id % 4)::INT, 1) AS ref, substr('ACGT', (1 + (event_id + 1) % 4)::INT, 1) AS alt, coalesce(trunc(value * 0.1)::INT, -1000) AS bin FROM events")
def p27_p28_changes(spark, sf_dir):
    """Parsed coding changes, and binned scores; the texts are written from the events."""
    base = lambda k: F.substring(F.lit("ACGT"), (1 + (F.col("event_id") + k) % 4).cast("int"), F.lit(1))
    text = F.concat(F.lit("T"), F.col("user_id").cast("string"), F.lit(":c."), (1 + F.col("event_id") % 900).cast("string"), base(0), F.lit(">"), base(1))
    t = table(spark, sf_dir, "events").select("event_id", S.coding_change(text).alias("c"), S.bin_of(F.col("value"), 0.1).alias("bin"))
    return t.select("event_id", "c.transcript", "c.pos", "c.ref", "c.alt", "bin")


@query(f"SELECT doc_id, source, split FROM (SELECT doc_id, source, CASE WHEN r * 5 < 3 * n THEN 'train' ELSE 'test' END AS split FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {ROLL.format(seed=13, key='doc_id')}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents))")
def r24_halves(spark, sf_dir):
    """Three fifths of each source by hash, ranked without a hot group in one task."""
    t = sampling.hash_positions(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 13)
    return t.select("doc_id", "source", F.when(F.col("_pos") * 5 < 3 * F.col("_total"), "train").otherwise("test").alias("split"))
