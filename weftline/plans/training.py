"""Queries of the token, packing, variant and draw operators over views of the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import sequences as S
from weftline.functions import tokens as T
from weftline.operators import matrix, packing, scores
from weftline.plans.basics import query
from weftline.plans.biology import AMINO, CODONS, ROLL, SEQS, acts, seqs, table
from weftline.sources import records

IDS = f"ids AS (SELECT doc_id, source, list_transform({CODONS}, lambda c: 5 + 16 * (instr('ACGT', c[1]) - 1) + 4 * (instr('ACGT', c[2]) - 1) + instr('ACGT', c[3]) - 1) AS ids FROM seqs)"
TEXT = "array_to_string({}, ',')"
LANES = "items AS (SELECT source, doc_id % 16 AS lane, doc_id, length(seq)::BIGINT AS n FROM seqs)"
PACKED = """packed AS (SELECT source, lane, doc_id, b AS batch, greatest(f, b * 4096) - f AS start, least(t, (b + 1) * 4096) - f AS stop, greatest(f, b * 4096) - b * 4096 AS at
FROM (SELECT *, t - n AS f FROM (SELECT *, (sum(n) OVER (PARTITION BY source, lane ORDER BY doc_id))::BIGINT AS t FROM items WHERE n > 0)), unnest(range(f // 4096, (t - 1) // 4096 + 1)) u(b))"""
SITES = "sites AS (SELECT doc_id, seq, (doc_id * 7919 % (length(seq) // 3))::INT AS place, doc_id % 3 AS base, substr('ACGT', (1 + doc_id % 4)::INT, 1) AS alt FROM seqs WHERE length(seq) >= 3)"


def packed(spark, sf_dir):
    items = seqs(spark, sf_dir).select("source", (F.col("doc_id") % 16).alias("lane"), "doc_id", F.length("seq").cast("long").alias("n"))
    return packing.split_pack(items, ["source", "lane"], "doc_id", "n", 4096)


def sites(spark, sf_dir):
    """A variant in each sequence: the codon's place, the base in it, the alternate."""
    t = seqs(spark, sf_dir).filter(F.length("seq") >= 3)
    place = (F.col("doc_id") * 7919 % F.floor(F.length("seq") / 3)).cast("int")
    return t.select("doc_id", "seq", place.alias("place"), (F.col("doc_id") % 3).cast("int").alias("base"), F.substring(F.lit("ACGT"), (1 + F.col("doc_id") % 4).cast("int"), F.lit(1)).alias("alt"))


@query(f"WITH {SEQS}, {IDS} SELECT doc_id, len(ids)::INT AS n, {TEXT.format('ids')} AS ids FROM ids")
def p06_codon_ids(spark, sf_dir):
    """Codons as token ids."""
    return seqs(spark, sf_dir).select("doc_id", T.codon_ids(F.col("seq")).alias("x")).select("doc_id", F.size("x").alias("n"), T.joined(F.col("x")).alias("ids"))


@query(f"WITH {SEQS} SELECT doc_id, {TEXT.format('list_append(list_transform(range(1, length(seq) + 1), lambda i: ascii(substr(seq, i::INT, 1))), 0)')} AS ids FROM seqs")
def p09_byte_ids(spark, sf_dir):
    """Characters as codes, with an end token."""
    return seqs(spark, sf_dir).select("doc_id", T.joined(T.byte_ids(F.col("seq"))).alias("ids"))


@query(f"WITH {SEQS}, {IDS} SELECT doc_id, {TEXT.format('list_concat([0], ids[1:126], [1], list_transform(range(126 - least(126, len(ids))), lambda x: 3))')} AS ids, (2 + least(126, len(ids)))::INT AS attended FROM ids")
def m01_framed(spark, sf_dir):
    """Special tokens, truncation and padding to 128."""
    t = seqs(spark, sf_dir).select("doc_id", T.framed(T.codon_ids(F.col("seq")), 128).alias("x"))
    return t.select("doc_id", T.joined(F.col("x")).alias("ids"), F.size(F.filter("x", lambda v: v != T.PAD)).alias("attended"))


@query(f"WITH {SEQS}, {IDS}, h AS (SELECT doc_id, list_transform(ids, lambda x, i: {{'x': x, 'h': ('0x' || substr(md5('42|' || doc_id::VARCHAR || '|' || (i - 1)::VARCHAR), 1, 13))::BIGINT}}) AS a FROM ids), r AS (SELECT doc_id, list_transform(a, lambda e: {{'x': e.x, 'o': 5 + e.h % 64, 'r': (e.h >> 12) % 1048576}}) AS a FROM h) SELECT doc_id, {TEXT.format('list_transform(a, lambda e: CASE WHEN e.r < 125829 THEN 4 WHEN e.r < 141557 THEN e.o ELSE e.x END)')} AS input, {TEXT.format('list_transform(a, lambda e: CASE WHEN e.r < 157286 THEN e.x ELSE -100 END)')} AS labels FROM r")
def m02_masked(spark, sf_dir):
    """Masked-token inputs and labels."""
    t = seqs(spark, sf_dir).select("doc_id", T.masked(T.codon_ids(F.col("seq")), F.col("doc_id"), 42).alias("x"))
    return t.select("doc_id", T.joined(F.col("x.input")).alias("input"), T.joined(F.col("x.label")).alias("labels"))


@query(f"WITH {SEQS}, {IDS} SELECT doc_id, {TEXT.format('CASE WHEN len(ids) > 0 THEN list_append(ids[2:], 3) ELSE ids END')} AS labels FROM ids")
def e07_next_labels(spark, sf_dir):
    """Next-token labels."""
    return seqs(spark, sf_dir).select("doc_id", T.codon_ids(F.col("seq")).alias("x")).select("doc_id", T.joined(T.next_labels(F.col("x"), T.PAD)).alias("labels"))


@query("SELECT doc_id, length(regexp_replace(text, '[^ACGTacgt]', '', 'g'))::INT AS kept, length(text)::INT AS n FROM documents WHERE text IS NOT NULL")
def m05_genomic_labels(spark, sf_dir):
    """How many labels of a text stay when only nucleotides count."""
    t = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", T.genomic_labels(T.byte_ids(F.col("text"), None)).alias("x"))
    return t.select("doc_id", F.size(F.filter("x", lambda v: v != T.IGNORED)).alias("kept"), F.size("x").alias("n"))


@query(f"WITH {SEQS}, t AS (SELECT doc_id, seq, '|d__' || CASE WHEN ('0x' || substr(md5('5|' || doc_id::VARCHAR || '|d'), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.3 THEN coalesce(lang, 'None') ELSE 'None' END || ';s__' || CASE WHEN ('0x' || substr(md5('5|' || doc_id::VARCHAR || '|s'), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.3 THEN coalesce(source, 'None') ELSE 'None' END || '|' AS tag FROM seqs) SELECT doc_id, tag, coalesce(list_aggregate(list_transform(range(0, length(seq), 200 - length(tag)), lambda s: tag || substr(seq, (s + 1)::INT, (200 - length(tag))::INT)), 'string_agg', ''), '') AS text FROM t")
def p14_p15_tags(spark, sf_dir):
    """Lineage tags with dropout, put before each stretch."""
    tag = T.lineage_tag({"d": F.col("lang"), "s": F.col("source")}, F.col("doc_id"), 5, 0.3)
    return seqs(spark, sf_dir).select("doc_id", "seq", tag.alias("tag")).select("doc_id", "tag", T.inject_tag(F.col("seq"), F.col("tag"), 200).alias("text"))


@query(f"WITH {SEQS}, {SITES}, c AS (SELECT doc_id, place, substr(seq, 3 * place + 1, 3) AS ref_codon, base, alt FROM sites), d AS (SELECT *, substr(ref_codon, 1, base::INT) || alt || substr(ref_codon, base::INT + 2) AS alt_codon FROM c), e AS (SELECT *, (SELECT {AMINO} FROM (SELECT ref_codon AS c)) AS ref_aa, (SELECT {AMINO} FROM (SELECT alt_codon AS c)) AS alt_aa FROM d) SELECT doc_id, place, ref_codon, alt_codon, ref_aa, alt_aa, CASE WHEN ref_aa = '*' THEN 'in_stop' WHEN alt_aa = '*' THEN 'nonsense' WHEN ref_aa = alt_aa THEN 'synonymous' ELSE 'missense' END AS class FROM e")
def p20_p25_variant_class(spark, sf_dir):
    """Reference and alternate codons of a variant, and its class; later classes override earlier ones."""
    ref = F.substring(F.col("seq"), 3 * F.col("place") + 1, F.lit(3))
    t = sites(spark, sf_dir).withColumn("ref_codon", ref)
    t = t.withColumn("alt_codon", F.concat(F.substring(F.col("ref_codon"), F.lit(1), F.col("base")), "alt", F.substring(F.col("ref_codon"), F.col("base") + 2, F.lit(3))))
    t = t.withColumns({"ref_aa": S.amino_acid(F.col("ref_codon")), "alt_aa": S.amino_acid(F.col("alt_codon"))})
    kind = F.when(F.col("ref_aa") == "*", "in_stop").when(F.col("alt_aa") == "*", "nonsense").when(F.col("ref_aa") == F.col("alt_aa"), "synonymous").otherwise("missense")
    return t.select("doc_id", "place", "ref_codon", "alt_codon", "ref_aa", "alt_aa", kind.alias("class"))


@query(f"WITH {SEQS}, {SITES}, w AS (SELECT doc_id, seq, place, greatest(0, least(place - 8, length(seq) // 3 - 16))::INT AS first FROM sites) SELECT doc_id, first, place - first AS relative, substr(seq, 3 * first + 1, (3 * least(16, length(seq) // 3 - first))::INT) AS context FROM w")
def p22_context(spark, sf_dir):
    """Sixteen codons around a variant, clamped at both ends."""
    n = F.floor(F.length("seq") / 3).cast("int")
    t = sites(spark, sf_dir).withColumns({"n": n, "first": F.greatest(F.lit(0), F.least(F.col("place") - 8, n - 16))})
    return t.select("doc_id", "first", (F.col("place") - F.col("first")).alias("relative"), F.substring(F.col("seq"), 3 * F.col("first") + 1, 3 * F.least(F.lit(16), F.col("n") - F.col("first"))).alias("context"))


@query(f"WITH {SEQS}, n AS (SELECT doc_id, length(seq) AS n FROM seqs) SELECT doc_id, k::INT AS window_no, (k * 94)::INT AS start, least(k * 94 + 126, n)::INT AS stop FROM n, unnest(range(0, 1 + ceil(greatest(n - 126, 0) / 94)::BIGINT)) t(k)")
def i05_token_windows(spark, sf_dir):
    """Windows of 128 tokens, two of them special, that overlap by 32."""
    return packing.token_windows(seqs(spark, sf_dir), "doc_id", F.length("seq"), 128, 2, 32)


@query(f"WITH {SEQS}, {LANES}, {PACKED} SELECT * FROM packed")
def i15_split_pack(spark, sf_dir):
    """Packed rows of 4096 that are filled exactly."""
    return packed(spark, sf_dir)


@query(f"WITH {SEQS}, t AS (SELECT doc_id, length(seq)::BIGINT AS n, (ceil(length(seq) / 8) * 8)::BIGINT AS c, sum((ceil(length(seq) / 8) * 8)::BIGINT) OVER (ORDER BY doc_id) AS t FROM seqs WHERE seq <> ''), p AS (SELECT *, t - c AS f, unnest(range((t - c)::BIGINT // 4096, (t - 1)::BIGINT // 4096 + 1)) AS batch FROM t) SELECT doc_id, batch, (greatest(f, batch * 4096) - f)::BIGINT AS start, least(least(t, (batch + 1) * 4096) - f, n)::BIGINT AS stop, (greatest(f, batch * 4096) - batch * 4096)::BIGINT AS at FROM p")
def i15_padded_pack(spark, sf_dir):
    """All sequences in one lane, each piece padded to a multiple of 8; 4100 hold 4096."""
    items = seqs(spark, sf_dir).select("doc_id", F.length("seq").cast("long").alias("n"))
    return packing.split_pack(items, [], "doc_id", "n", 4100, 8)


@query(f"""WITH RECURSIVE {SEQS}, items AS (SELECT doc_id, least(length(seq), 4090)::BIGINT AS n, (ceil(least(length(seq), 4090) / 16) * 16)::BIGINT AS padded, row_number() OVER (ORDER BY doc_id) AS rn FROM seqs),
r AS (SELECT *, 0::BIGINT AS batch, padded AS used FROM items WHERE rn = 1 UNION ALL SELECT i.*, r.batch + (r.used + i.padded > 4096 OR r.used = 4096)::INT, CASE WHEN r.used + i.padded > 4096 OR r.used = 4096 THEN i.padded ELSE r.used + i.padded END FROM r JOIN items i ON i.rn = r.rn + 1)
SELECT doc_id, n, padded, batch FROM r WHERE batch < (SELECT max(batch) FROM r) OR (SELECT max(used) FROM r WHERE batch = (SELECT max(batch) FROM r)) = 4096""")
def i15_whole_pack(spark, sf_dir):
    """Whole sequences, all in one lane, in batches of 4096 with multiples of 16; an open last batch goes."""
    items = seqs(spark, sf_dir).select("doc_id", F.least(F.length("seq"), F.lit(4090)).cast("long").alias("n"))
    return packing.whole_pack(items, [], "doc_id", "n", 4096, 16)


@query(f"WITH {SEQS}, {LANES}, {PACKED} SELECT source, lane, batch, '0,' || string_agg((packed.at + stop - start)::VARCHAR, ',' ORDER BY packed.at) AS cu_seq_lens, max(stop - start) AS longest, (1024 - sum(stop - start)::BIGINT % 1024) % 1024 AS padding FROM packed GROUP BY ALL")
def i16_i17_flattened(spark, sf_dir):
    """Sequence bounds of packed rows, and the padding to a multiple of 1024."""
    return packing.flattened(packed(spark, sf_dir), ["source", "lane"], 1024).withColumn("cu_seq_lens", T.joined(F.col("cu_seq_lens")))


@query(f"WITH {SEQS}, {LANES}, {PACKED} SELECT source, lane, batch, round(1 - sum(stop - start) / (count(*) * max(stop - start)), 9) AS waste FROM packed GROUP BY ALL")
def a29_padding_waste(spark, sf_dir):
    """What padding would waste in each batch."""
    return packing.padding_waste(packed(spark, sf_dir), ["source", "lane"]).withColumn("waste", F.round("waste", 9))


@query("SELECT source, lang, min_by(doc_id, (md5('3:1|' || doc_id::VARCHAR), doc_id)) AS doc_id FROM documents GROUP BY ALL")
def r15_one_per_group(spark, sf_dir):
    """One document of each source and language per epoch."""
    return packing.one_per_group(table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id", 3, 1)


@query(f"WITH t AS (SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)), k AS (SELECT lang, count(*) AS k FROM t WHERE toxic = 1 GROUP BY lang), r AS (SELECT r::INT AS repeat, lang, doc_id, row_number() OVER (PARTITION BY r, lang ORDER BY {ROLL.format(seed=9, key='(r::VARCHAR || chr(58) || doc_id::VARCHAR)')}, doc_id) AS n FROM t, unnest(range(0, 3)) u(r) WHERE toxic = 0) SELECT repeat, lang, doc_id FROM r JOIN k USING (lang) WHERE n <= k")
def r19_matched_controls(spark, sf_dir):
    """As many controls as cases in each language, three times."""
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("toxic is not null")
    return packing.matched_controls(t, "lang", F.col("toxic") == 1, "doc_id", 3, 9)


@query(f"WITH {SEQS}, n AS (SELECT doc_id, length(seq) AS n FROM seqs), e AS (SELECT min(n) AS lo, max(n) AS hi FROM n), b AS (SELECT doc_id, least(floor((n - lo) / greatest((hi - lo) / 10, 1e-9)), 9)::INT AS bin FROM n, e), r AS (SELECT bin, doc_id, row_number() OVER (PARTITION BY bin ORDER BY {ROLL.format(seed=4, key='doc_id')}, doc_id) AS r FROM b) SELECT bin, doc_id FROM r WHERE r <= 9 + (bin < 5)::INT")
def r13_length_stratified(spark, sf_dir):
    """95 sequences from ten bins of length."""
    return packing.length_stratified(seqs(spark, sf_dir).withColumn("n", F.length("seq")), "doc_id", "n", 95, 10, 4)


@query("WITH v AS (SELECT label, i - 1 AS feature, greatest(embedding[i]::DOUBLE, 0)::DECIMAL(18,6) AS value FROM embeddings, unnest(range(1, 65)) t(i)) SELECT label, feature::INT AS feature, count(*) AS members, round(sum(value)::DOUBLE / count(*), 6) AS centroid FROM v GROUP BY ALL")
def a26_centroids(spark, sf_dir):
    """The centre of each cluster."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    t = acts(spark, sf_dir).join(e, "vec_id").groupBy("label", "feature").agg(F.count("*").alias("members"), F.sum("value").alias("s"))
    return t.select("label", "feature", "members", F.round(F.col("s").cast("double") / F.col("members"), 6).alias("centroid"))


@query("WITH r AS (SELECT o_orderpriority AS fold, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS a, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS b FROM orders) SELECT fold, round(corr(a, b), 6) AS spearman FROM r GROUP BY fold")
def t07_spearman(spark, sf_dir):
    """Rank correlation per fold, ties averaged."""
    t = scores.spearman(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", "o_orderpriority")
    return t.select(F.col("o_orderpriority").alias("fold"), F.round("spearman", 6).alias("spearman"))


@query("WITH x AS (SELECT lang, n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), g AS (SELECT lang, s, sum(y)::BIGINT AS p, count(*) AS n FROM x GROUP BY ALL), c AS (SELECT lang, s, p, (sum(p) OVER w)::DOUBLE / sum(n) OVER w AS prec, sum(p) OVER (PARTITION BY lang) AS positives FROM g WINDOW w AS (PARTITION BY lang ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), a AS (SELECT *, p * (prec + coalesce(lag(prec) OVER (PARTITION BY lang ORDER BY s DESC), 1)) / 2 AS area FROM c) SELECT lang, CASE WHEN max(positives) > 0 THEN round(sum(area) / max(positives), 6) END AS pr_auc FROM a GROUP BY lang")
def t05_pr_auc(spark, sf_dir):
    """Area under precision and recall, per language."""
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("quality is not null")
    return scores.pr_auc(t, "n_chars", "quality", "lang").withColumn("pr_auc", F.round("pr_auc", 6))


@query(f"SELECT event_id, floor({ROLL.format(seed=2, key='event_id')} * 12)::INT AS rank FROM events")
def r21_rank_shards(spark, sf_dir):
    """Events dealt to twelve readers."""
    return packing.rank_shards(table(spark, sf_dir, "events").select("event_id"), "event_id", 12, 2)


@query(f"WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders), d AS (SELECT d AS draw, floor({ROLL.format(seed=6, key='d')} * (SELECT count(*) FROM orders))::BIGINT AS row_index FROM range(0, 5000) t(d)) SELECT draw, row_index, o_orderkey FROM d JOIN i USING (row_index)")
def r10_resampled(spark, sf_dir):
    """Five thousand draws of orders with replacement."""
    rows = matrix.dense_index(table(spark, sf_dir, "orders"), "o_orderkey")
    return packing.resampled(rows, "row_index", 5000, 6).select("draw", "row_index", "o_orderkey")


@query("SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts, event_type AS metric, event_id % 1000 AS iteration, value AS reading FROM events WHERE value IS NOT NULL")
def s23_metric_lines(spark, sf_dir):
    """Log lines to metrics; the lines are written from the events."""
    t = table(spark, sf_dir, "events").filter("value is not null")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" - INFO - "), "event_type", F.lit(" iteration="), (F.col("event_id") % 1000).cast("string"), F.lit(" value="), F.col("value").cast("string"))
    return records.parse_metrics(t.select("event_id", line.alias("value")), keep=["event_id"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_suppkey % 90)::INT AS start, (l_suppkey % 90 + 1 + l_partkey % 9)::INT AS stop FROM lineitem")
def p29_positions(spark, sf_dir):
    """Position texts to half-open intervals; the texts are written from line items."""
    t = table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("<"), (F.col("l_suppkey") % 90 + 1).cast("string"), F.lit(".."), (F.col("l_suppkey") % 90 + 1 + F.col("l_partkey") % 9).cast("string"))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", records.position(text).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "p.start", "p.stop")
