"""Queries of splits, shuffles, blends, subsequences, batches and similar sequences, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import tokens as T
from weftline.operators import batches, blends, clusters, corpora, matrix, sampling, sequence_tables
from weftline.plans import biology, models  # noqa: F401  the queries whose SQL is given here
from weftline.plans.basics import ORACLES, query
from weftline.plans.biology import ROLL, SEQS, seqs, table
from weftline.plans.training import IDS, TEXT
from weftline.storage import scratch

GREEDY = """items AS (SELECT source, doc_id // 1000 AS stretch, doc_id, length(seq) AS n, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS rn FROM seqs WHERE length(seq) <= {limit}),
r AS (SELECT *, 0 AS batch, n::BIGINT AS used FROM items WHERE rn = 1 UNION ALL SELECT i.*, r.batch + (r.used > 0 AND r.used + i.n > {budget})::INT, CASE WHEN r.used > 0 AND r.used + i.n > {budget} THEN i.n ELSE r.used + i.n END FROM r JOIN items i ON i.source IS NOT DISTINCT FROM r.source AND i.stretch = r.stretch AND i.rn = r.rn + 1)"""
ORACLES["i13_token_batches"] = f"WITH RECURSIVE {SEQS}, {GREEDY.format(limit=4000, budget=4000)} SELECT source, stretch, doc_id, n::INT AS n, batch FROM r"
ORACLES["i07_greedy_chunks"] = f"WITH RECURSIVE {SEQS}, {GREEDY.format(limit=10**12, budget=5000)} SELECT source, stretch, batch AS chunk, count(*) AS rows, sum(n)::BIGINT AS tokens FROM r GROUP BY ALL"


@query(f"WITH RECURSIVE {SEQS}, {GREEDY.format(limit=3000, budget=3000)}, f AS (SELECT *, sum(n) OVER (PARTITION BY source, stretch, batch) AS total, max(batch) OVER (PARTITION BY source, stretch) AS last FROM r) SELECT source, stretch, doc_id, n::INT AS n, batch FROM f WHERE batch < last OR total = 3000")
def i14_budget_batches(spark, sf_dir):
    """Batches bounded by tokens: larger items are skipped, an open last batch is dropped."""
    t = seqs(spark, sf_dir).select("source", F.floor(F.col("doc_id") / 1000).alias("stretch"), "doc_id", F.length("seq").alias("n"))
    return sampling.token_batches(t, ["source", "stretch"], "doc_id", "n", 3000, drop_last=True)


@query(f"WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, {ROLL.format(seed=51, key='doc_id')} AS r FROM documents) SELECT doc_id, CASE WHEN k = 0 THEN 'train' WHEN k = 1 THEN 'val' WHEN k = 2 THEN 'test' WHEN r < 0.9::DOUBLE THEN 'train' WHEN r < 0.95::DOUBLE THEN 'val' ELSE 'test' END AS split FROM i")
def r02_forced_split(spark, sf_dir):
    """Splits by weight, none of them empty."""
    t = matrix.dense_index(table(spark, sf_dir, "documents"), "doc_id")
    return corpora.forced_split(t, "row_index", F.col("doc_id"), {"train": 0.9, "val": 0.05, "test": 0.05}, 51).select("doc_id", "split")


def drawn_sql(name: str, share: float, used: str, rounds: int = 6) -> str:
    """SQL of ``proportional_clusters``: one step for each organism (at most ``rounds``)."""
    h = ROLL.format(seed=42, key="cluster")
    out = [f"{name}0 AS (SELECT NULL::BIGINT AS cluster WHERE false)"]
    for k in range(1, rounds + 1):
        before = f"{name}{k - 1}"
        out.append(f"""{name}{k} AS (SELECT cluster FROM {before} UNION ALL SELECT cluster FROM (SELECT c.cluster, t.target, coalesce((SELECT sum(n) FROM cnt WHERE lang = t.lang AND cluster IN (SELECT cluster FROM {before})), 0) AS have, coalesce(sum(c.n) OVER (ORDER BY {h.replace('cluster', 'c.cluster')}, c.cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM cnt c JOIN (SELECT lang, greatest(1, trunc(trunc((SELECT count(*) FROM d) * {share}::DOUBLE) * (total / (SELECT sum(total) FROM tot)))::BIGINT) AS target FROM tot WHERE r = {k}) t USING (lang) WHERE c.cluster NOT IN (SELECT cluster FROM {before}) AND c.cluster NOT IN ({used})) WHERE before < target - have)""")
    return ", ".join(out)


@query(f"WITH d AS (SELECT doc_id, doc_id * 7919 % 211 AS cluster, lang FROM documents), cnt AS (SELECT cluster, lang, count(*) AS n FROM d WHERE lang IS NOT NULL GROUP BY ALL), tot AS (SELECT lang, sum(n) AS total, row_number() OVER (ORDER BY sum(n), lang) AS r FROM cnt GROUP BY lang), {drawn_sql('v', 0.1, 'SELECT 0 WHERE false')}, {drawn_sql('t', 0.05, 'SELECT cluster FROM v6')} SELECT doc_id, CASE WHEN cluster IN (SELECT cluster FROM v6) THEN 'val' WHEN cluster IN (SELECT cluster FROM t6) THEN 'test' ELSE 'train' END AS split FROM d")
def r04_proportional_split(spark, sf_dir):
    """Whole clusters to validation and test, in proportion to languages."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 7919 % 211).alias("cluster"), "lang")
    return corpora.proportional_split(d, "cluster", "lang", 0.1, 0.05, 42).select("doc_id", "split")


@query(f"SELECT doc_id, lang, CASE WHEN r < 0.6::DOUBLE THEN 'train' WHEN r < 0.8::DOUBLE THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, lang, {ROLL.format(seed=42, key='doc_id')} AS r FROM documents) WHERE lang IN (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 2)")
def r06_filtered_splits(spark, sf_dir):
    """Splits of the two commonest languages."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    top = d.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(2)
    t = sampling.weighted_split(d, F.col("doc_id"), {"train": 0.6, "val": 0.2, "test": 0.2}, 42)
    return corpora.filtered_splits(t, "doc_id", top, "lang").select("doc_id", "lang", "split")


PAIRS = """equal AS (SELECT seq, min(doc_id) AS v, length(seq) AS n FROM seqs GROUP BY seq), gram AS (SELECT DISTINCT v, n, substr(md5(substr(seq, i::INT, 12)), 1, 16) AS g FROM equal, unnest(range(1, n - 10)) t(i) WHERE n >= 12),
least AS (SELECT * FROM gram QUALIFY row_number() OVER (PARTITION BY v ORDER BY g) <= 20), top AS (SELECT g, max(n) AS n, arg_min(v, (-n, v)) AS v FROM least GROUP BY g),
met AS (SELECT DISTINCT t.v AS a, m.v AS b, t.n, m.n AS m FROM least m JOIN top t USING (g) WHERE t.v <> m.v AND m.n * 100 >= t.n * 90),
pairs AS (SELECT a, b, met.n, m FROM met JOIN equal x ON x.v = a JOIN equal y ON y.v = b WHERE levenshtein(x.seq, y.seq) <= floor(met.n * 30 / 100)), twins AS (SELECT e.v AS a, doc_id AS b FROM seqs JOIN equal e USING (seq) WHERE doc_id <> e.v),
links AS (SELECT a, b FROM pairs UNION ALL SELECT a, b FROM twins)"""


def linear(spark, sf_dir):
    return seqs(spark, sf_dir).select("doc_id", "seq"), "doc_id", "seq", 12, 20, 70, 90


@query(f"WITH {SEQS}, {PAIRS}, c AS (SELECT doc_id, {ROLL.format(seed=61, key='(doc_id % 40)')} < 0.2::DOUBLE AS held FROM seqs), near AS (SELECT a AS doc_id FROM links JOIN c ON c.doc_id = b WHERE held UNION SELECT b FROM links JOIN c ON c.doc_id = a WHERE held) SELECT doc_id, CASE WHEN held THEN 'held' WHEN doc_id IN (SELECT doc_id FROM near) THEN 'removed' ELSE 'train' END AS split FROM c")
def r16_held_out_clusters(spark, sf_dir):
    """Clusters held out; training rows whose whole sequence is like a held-out one's are removed."""
    t = seqs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 40).alias("cluster"))
    return corpora.held_out(t, "doc_id", "cluster", 0.2, 61, clusters.linear_pairs(*linear(spark, sf_dir))).select("doc_id", "split")


@query(f"WITH d AS (SELECT DISTINCT c_nationkey, c_mktsegment, c_nationkey // 3 AS tissue, {ROLL.format(seed=5, key='c_nationkey')} < 0.6::DOUBLE AS held FROM customer), m AS (SELECT c_nationkey FROM d WHERE c_mktsegment IN (SELECT c_mktsegment FROM d GROUP BY 1 HAVING bool_and(held)) UNION SELECT c_nationkey FROM d WHERE tissue IN (SELECT tissue FROM d GROUP BY 1 HAVING bool_and(held))) SELECT DISTINCT c_nationkey, CASE WHEN held AND c_nationkey NOT IN (SELECT c_nationkey FROM m) THEN 'held' ELSE 'train' END AS split FROM d")
def r17_covered_hold_out(spark, sf_dir):
    """Datasets held out while every kind stays in training."""
    t = table(spark, sf_dir, "customer").withColumn("tissue", F.floor(F.col("c_nationkey") / 3))
    return corpora.covered_hold_out(t, "c_nationkey", 0.6, 5, "c_mktsegment", "tissue")


@query(f"WITH e AS (SELECT event_id, event_id // 500 AS shard, event_id // 100 AS stretch FROM events), s AS (SELECT shard, row_number() OVER (ORDER BY {ROLL.format(seed=71, key='shard')}, shard) - 1 AS turn FROM (SELECT DISTINCT shard FROM e)) SELECT event_id, turn, stretch, row_number() OVER (PARTITION BY shard, stretch ORDER BY {ROLL.format(seed=72, key='event_id')}, event_id) - 1 AS at FROM e JOIN s USING (shard)")
def r20_buffered_shuffle(spark, sf_dir):
    """Shards in an order by hash, rows shuffled within buffers."""
    t = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 500).alias("shard"))
    return corpora.buffered_shuffle(t, "shard", "event_id", 100, 71).select("event_id", "turn", "stretch", "at")


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang), d AS (SELECT source, lang, (CASE WHEN lang = 'de' THEN n * -1.5 ELSE n END)::DOUBLE AS w FROM c), t AS (SELECT lang, sum(abs(w)) AS total FROM d GROUP BY lang) SELECT lang, source, round(w / total, 9) AS share, floor(abs(w / total) * 100000 + 0.5)::BIGINT AS quota FROM d JOIN t USING (lang)")
def r22_blend_weights(spark, sf_dir):
    """Weights of datasets normalised in each split, and their quotas."""
    d = table(spark, sf_dir, "documents").filter("source is not null and lang is not null").groupBy("lang", "source").agg(F.count("*").alias("n"))
    d = d.select("lang", "source", (F.col("n") * F.when(F.col("lang") == "de", -1.5).otherwise(1.0)).alias("w"))
    return corpora.blend_weights(d, "lang", "w", 100000).select("lang", "source", F.round("share", 9).alias("share"), "quota")


@query(f"WITH {SEQS}, w AS (SELECT doc_id, k::INT AS window_no, doc_id || ':' || k AS sample FROM (SELECT doc_id, CASE WHEN length(seq) < 128 THEN 1 ELSE 1 + (length(seq) - 128) // 96 END AS n FROM seqs), unnest(range(0, n)) t(k)), r AS (SELECT *, floor({ROLL.format(seed=3, key='sample')} * 4)::INT AS rank FROM w) SELECT window_no, doc_id, sample, rank, row_number() OVER (PARTITION BY rank, doc_id ORDER BY window_no) - 1 AS place FROM r")
def i03_i04_access_log(spark, sf_dir):
    """Who reads which window, after the stored settings are checked."""
    t = sequence_tables.windows(seqs(spark, sf_dir), "doc_id", "seq", 128, 96)
    found = table(spark, sf_dir, "documents").agg(F.lit(128).alias("window"), F.lit(96).alias("stride"), F.count("*").alias("rows"))
    t = t.crossJoin(F.broadcast(corpora.agreed_settings(found, window=128, stride=96).select("window")))  # one row
    return corpora.access_log(t, "window_no", "doc_id", 4, 3)


@query(f"WITH {SEQS}, n AS (SELECT doc_id, length(seq) // 3 AS n FROM seqs), a AS (SELECT doc_id, 'overlap' AS kind, k::INT AS part, (k * 50)::INT AS start, least(n, k * 50 + 60)::INT AS stop FROM n, unnest(range(0, greatest(1, (n - 10) // 50))) t(k) WHERE n BETWEEN 20 AND 3000), b AS (SELECT doc_id, 'whole', k::INT, (k * 60)::INT, least(n, k * 60 + 60)::INT FROM n, unnest(range(0, ceil(n / 60)::BIGINT)) t(k) WHERE n BETWEEN 20 AND 3000) SELECT * FROM a UNION ALL SELECT * FROM b")
def i06_token_subsequences(spark, sf_dir):
    """Token stretches with and without overlap."""
    n = F.floor(F.length("seq") / 3).cast("int")
    a, b = (corpora.token_subsequences(seqs(spark, sf_dir), "doc_id", n, 62, 2, 10, 20, 3000, whole).withColumn("kind", F.lit(kind)) for kind, whole in (("overlap", False), ("whole", True)))
    return a.unionByName(b).select("doc_id", "kind", "part", "start", "stop")


@query(f"WITH {SEQS} SELECT doc_id, (s // 70)::INT AS part, substr(seq, (s + 1)::INT, 100) AS text FROM seqs, unnest(range(0, length(seq), 70)) t(s)")
def i09_subsequences(spark, sf_dir):
    """Pieces of 100 at steps of 70."""
    return corpora.subsequences(seqs(spark, sf_dir), "doc_id", "seq", 100, 70)


@query(f"WITH {SEQS}, {IDS}, t AS (SELECT doc_id, doc_id % 2 AS part, doc_id // 32 AS batch, ids FROM ids), p AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS m FROM t) SELECT doc_id, batch, {TEXT.format('list_concat(ids, list_transform(range(m - len(ids)), lambda x: 3))')} AS ids FROM p")
def i20_collated(spark, sf_dir):
    """Results of two readers as one table, sequences filled to their batch's longest."""
    t = seqs(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 32).alias("batch"), T.codon_ids(F.col("seq")).alias("ids"))
    both = matrix.checked_union(t.filter("doc_id % 2 = 0"), t.filter("doc_id % 2 = 1"))
    return batches.padded(both, ["batch"], "ids", T.PAD).select("doc_id", "batch", T.joined(F.col("ids")).alias("ids"))


@query(f"WITH {SEQS}, {IDS}, f AS (SELECT doc_id, list_concat([0], ids[1:98], [1]) AS ids FROM ids), h AS (SELECT doc_id, list_transform(ids, lambda x, i: {{'x': x, 'h': ('0x' || substr(md5('43|' || doc_id::VARCHAR || '|' || (i - 1)::VARCHAR), 1, 13))::BIGINT}}) AS a FROM f), r AS (SELECT doc_id, list_transform(a, lambda e: {{'x': e.x, 'o': 5 + e.h % 64, 'r': (e.h >> 12) % 1048576}}) AS a FROM h) SELECT doc_id, {TEXT.format('list_transform(a, lambda e: CASE WHEN e.x > 4 AND e.r < 125829 THEN 4 WHEN e.x > 4 AND e.r < 141557 THEN e.o ELSE e.x END)')} AS input, {TEXT.format('list_transform(a, lambda e: CASE WHEN e.x > 4 AND e.r < 157286 THEN e.x ELSE -100 END)')} AS labels FROM r")
def m03_masked_rows(spark, sf_dir):
    """Masked-token rows of up to 100 whose end token stays."""
    t = seqs(spark, sf_dir).select("doc_id", T.framed_keeping_end(T.codon_ids(F.col("seq")), 100).alias("ids"))
    t = t.select("doc_id", T.masked(F.col("ids"), F.col("doc_id"), 43).alias("x"))
    return t.select("doc_id", T.joined(F.col("x.input")).alias("input"), T.joined(F.col("x.label")).alias("labels"))


@query(f"WITH {SEQS}, {IDS}, t AS (SELECT doc_id, list_concat([0], ids) AS ids, len(ids) AS n FROM ids) SELECT doc_id, {TEXT.format('ids')} AS ids, {TEXT.format('range(n + 1)')} AS positions, {TEXT.format('list_concat([0], list_transform(range(n), lambda x: 1))')} AS mask FROM t")
def m08_prediction_rows(spark, sf_dir):
    """Rows with a leading end token that the mask leaves out."""
    t = seqs(spark, sf_dir).select("doc_id", T.prediction_row(T.codon_ids(F.col("seq")), 0).alias("x"))
    return t.select("doc_id", *(T.joined(F.col(f"x.{c}")).alias(c) for c in ("ids", "positions", "mask")))


@query(f"""WITH RECURSIVE {SEQS}, s AS (SELECT DISTINCT doc_id, substr(seq, i::INT, 12) AS g FROM seqs, unnest(range(1, length(seq) - 10)) t(i) WHERE length(seq) >= 12), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL), link AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 60 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM seqs UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a) SELECT a AS doc_id, min(b) AS cluster FROM reach GROUP BY a""")
def c01_similar_sequences(spark, sf_dir):
    """Clusters of sequences that share three fifths of their 12-mers."""
    return corpora.similar_sequences(seqs(spark, sf_dir), "doc_id", "seq", 12, 60)


@query(f"WITH {SEQS}, {PAIRS} SELECT a, b FROM links")
def c01_sequence_pairs(spark, sf_dir):
    """Sequences with the longest that has a 12-mer with them, at 70 % identity and 90 % coverage."""
    return clusters.linear_pairs(*linear(spark, sf_dir))


@query()
def c01_linear_clusters(spark, sf_dir):
    """Clusters of sequences around the longest, in linear time."""
    return clusters.linear_clusters(*linear(spark, sf_dir))[0]


WEIGHTS = {"en": 5.0, "de": -1.5, "fr": 2.25}
SHARES = [57, 17, 26]  # of a hundred, as the weights above come out


@query(f"""WITH RECURSIVE turn AS (SELECT 0 AS slot, [0, 0, 0] AS c, {SHARES} AS s, NULL::BIGINT AS d, NULL::INT AS k UNION ALL SELECT slot + 1, list_transform(c, lambda x, j: x + (j = d1)::INT), s, d1, c[d1] FROM (SELECT *, list_min(list_transform([1, 2, 3], lambda i: CASE WHEN c[i] < s[i] AND floor(c[i] * 100 / s[i]) <= slot THEN [ceil((c[i] + 1) * 100 / s[i])::INT, i] END))[2] AS d1 FROM turn WHERE slot < 100)),
p AS (SELECT slot - 1 AS slot, {list(WEIGHTS)}[d] AS lang, k, {SHARES}[d] AS q FROM turn WHERE slot > 0), i AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM documents), z AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
a AS (SELECT draw, lang, n, (draw // 100) * q + k AS nth FROM range(0, 3000) t(draw) JOIN p ON slot = draw % 100 JOIN z USING (lang)), b AS (SELECT draw, lang, n, nth // n AS epoch, nth % n AS i, '9:' || lang || ':' || (nth // n)::VARCHAR AS key FROM a), {models.walked('b')}
SELECT draw, lang, epoch, doc_id FROM walked JOIN i USING (lang) WHERE r = x""")
def r22_mixed_order(spark, sf_dir):
    """Three thousand draws from three languages by weight, each in epochs of its own."""
    return blends.mixed_order(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", WEIGHTS, 3000, 9, period=100)


@query(f"WITH e AS (SELECT event_id, event_id // 50 AS part, event_type FROM events), l AS (SELECT part, event_type, event_type || ':' || part AS sample, floor({ROLL.format(seed=3, key="(event_type || ':' || part)")} * 4)::INT AS rank FROM (SELECT DISTINCT part, event_type FROM e)), r AS (SELECT *, row_number() OVER (PARTITION BY rank, event_type ORDER BY part) - 1 AS place FROM l) SELECT run, tm AS time, r.* FROM r, (VALUES ('first', TIMESTAMP '2024-01-02 03:04:05'), ('second', TIMESTAMP '2024-01-03 00:00:00')) t(run, tm)")
def i04_appended_log(spark, sf_dir):
    """Two runs in one access log, the first of them written twice."""
    t = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).alias("part"), "event_type").distinct()
    log, path = corpora.access_log(t, "part", "event_type", 4, 3), scratch(spark, "log")
    for run, time in (("first", "2023-01-01 00:00:00"), ("second", "2024-01-03 00:00:00"), ("first", "2024-01-02 03:04:05")):
        blends.append_log(log, path, run, time)
    return blends.read_log(spark, path).select("run", "time", "part", "event_type", "sample", "rank", "place")
