"""The registered queries of this subpackage, thin over the operators, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.llm import language_id, toxicity
from weftline.llm.collocations import collocations
from weftline.llm.decontamination import decontaminate
from weftline.llm.jaccard_join import jaccard_join
from weftline.llm.line_dedup import line_dedup
from weftline.llm.mixing import mix_sources
from weftline.llm.quality_rules import quality_rules
from weftline.llm.simhash_dedup import simhash_dedup
from weftline.llm.substring_dedup import substring_dedup
from weftline.llm.suffix_dedup import suffix_dedup
from weftline.llm.vector_codes import vector_codes
from weftline.llm.warc import archive_pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL equivalent."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 18, 1))) t(i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM late, unnest(range(20)) t(o)),
word AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n_kept, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op1_substring_dedup(spark, sf_dir):
    """Windows of 20 words that start earlier are removed."""
    return substring_dedup(table(spark, sf_dir, "documents"), k=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op10_suffix_array_dedup(spark, sf_dir):
    """Strings of 400 bytes that start elsewhere too are removed."""
    return suffix_dedup(table(spark, sf_dir, "documents"), k=400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('7|' || coalesce(doc_id::VARCHAR, '')) AS m FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
s1 AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS goal FROM s0),
s2 AS (SELECT *, (goal - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM s1 WINDOW w AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(CASE WHEN level * weight < cap THEN level END) OVER () AS final FROM s2),
s AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(final * weight, cap::DOUBLE)) AS target FROM s3),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS passes FROM s),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.passes, q.quota - q.passes * q.source_size - (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.m ROWS UNBOUNDED PRECEDING) - d.size) AS room FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, room)))::BIGINT AS taken FROM r""")
def op2_mix_sources(spark, sf_dir):
    """A mix of 150 % of all words, by weights 3, 1, 2."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 11, 2))) t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, ns, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)),
hit AS (SELECT DISTINCT doc_id, n, i, item_id FROM dw JOIN bw USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hit, unnest(range(13)) t(o) WHERE o < n GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op3_decontamination(spark, sf_dir):
    """Documents that hold 13-word windows of benchmark items."""
    t = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13)
    return t.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query()
def op3_near_passages(spark, sf_dir):
    """The same with benchmark items that documents hold but for up to two words in thirteen."""
    t = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13)
    return t.select("doc_id", "n_hit", "items", F.coalesce(F.size("near"), F.lit(0)).alias("n_near"), "near_items", "contaminated")


@query(r"""
WITH l AS (SELECT doc_id, p, line, trim(line, E' \t\n\x0b\x0c\r') AS k FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents)),
k AS (SELECT *, translate(k, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.p, k.line, c.key IS NOT NULL AND k.doc_id < c.top AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""")
def op6_line_dedup(spark, sf_dir):
    """Lines of 40 code points that five documents hold stay in one."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""")
def op9_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose 5-word shingles have similarity 0.8."""
    return jaccard_join(table(spark, sf_dir, "documents"), n=5, percent=80).select("doc_id", "n_shingles", "component_id")


@query(r"""
WITH d AS (SELECT doc_id, lang, t, octet_length(encode(t)) AS bytes, length(t) AS chars, regexp_replace(t, '[^\x00-\x7F]', '', 'g') AS ascii, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS times FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 6, 1))) t(i))),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM win, unnest(range(8)) t(o) WHERE times > 1 GROUP BY doc_id),
cl AS (SELECT doc_id, lang, bytes, ascii, chars, list_transform(['[^a-z]', '[^A-Z]', '[^0-9]', '[^\x20\x09\x0B-\x0D]', '[^\x0A]', '[^.,;:!?''"()-]', '[^#*$%&|<>]'], lambda p: length(regexp_replace(ascii, p, '', 'g'))) AS n FROM d),
cn AS (SELECT doc_id, lang, bytes, unnest(range(10)) AS k, unnest(list_concat(n, [length(ascii) - list_sum(n), bytes - chars, chars - length(ascii)])) AS n FROM cl),
cr AS (SELECT ref, k, n / greatest(1, sum(n) OVER (PARTITION BY ref)) AS q FROM (SELECT lang AS ref, k, sum(n) AS n FROM cn WHERE lang IS NOT NULL GROUP BY ALL)),
pair AS (SELECT doc_id, ref FROM d JOIN (SELECT DISTINCT lang AS ref FROM d WHERE lang IS NOT NULL) r ON d.lang IS NULL OR d.lang = ref),
cp AS (SELECT doc_id, ref, n / greatest(1, bytes) AS p, q FROM pair JOIN cr USING (ref) JOIN cn USING (doc_id, k)),
word AS (SELECT doc_id, lang, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM d),
wn AS (SELECT *, sum(n) OVER (PARTITION BY ref) AS total FROM (SELECT lang AS ref, word, count(*) AS n FROM word WHERE lang IS NOT NULL GROUP BY ALL)),
wr AS (SELECT ref, word, n / total AS q FROM wn WHERE n >= total * 0.002::DOUBLE),
own AS (SELECT doc_id, word, count(*) AS n FROM word GROUP BY ALL),
wc AS (SELECT doc_id, ref, coalesce(own.n, 0) AS n, q FROM pair JOIN wr USING (ref) LEFT JOIN own USING (doc_id, word)),
ws AS (SELECT pair.doc_id, pair.ref, coalesce(sum(n), 0) AS n, coalesce(sum(q), 0) AS q FROM pair LEFT JOIN wc USING (doc_id, ref) GROUP BY ALL),
wp AS (SELECT doc_id, ref, n / greatest(1, len(w)) AS p, q FROM (SELECT * FROM wc UNION ALL SELECT doc_id, ref, len(w) - n, CASE WHEN ref IN (SELECT ref FROM wn) THEN 1 - q ELSE 0 END FROM ws JOIN d USING (doc_id)) JOIN d USING (doc_id)),
far AS (SELECT doc_id, ref, sqrt(greatest(0, least(1, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS x FROM (SELECT doc_id, ref || '|c' AS ref, p, q FROM cp UNION ALL SELECT doc_id, ref || '|w', p, q FROM wp) GROUP BY ALL),
near AS (SELECT c.doc_id, min_by(c.x, (c.x + o.x, pair.ref)) AS cd, min_by(o.x, (c.x + o.x, pair.ref)) AS wd FROM pair JOIN far c ON c.doc_id = pair.doc_id AND c.ref = pair.ref || '|c' JOIN far o ON o.doc_id = pair.doc_id AND o.ref = pair.ref || '|w' GROUP BY c.doc_id),
base AS (SELECT doc_id, bytes, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base LEFT JOIN near USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce((bytes >= 300 AND cd > 0.25) OR (n_words >= 60 AND wd > 0.5), false) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM f""")
def op7_quality_rules(spark, sf_dir):
    """Base rules, then divergence from the language's histograms."""
    t = quality_rules(table(spark, sf_dir, "documents"))
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


@query(r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""")
def op8_warc(spark, sf_dir):
    """Archives written and read back, through their merged capture index."""
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def remainder(k: int):
    """crc32 of the id's text modulo k; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % k


@query()
def op4_toxicity(spark, sf_dir):
    """Toxicity of restored texts, learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.score(docs, model, (remainder(5) == 0).alias("held_out"))


@query()
def op5_language_id(spark, sf_dir):
    """Language by a byte network, learned outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, remainder(3) != 1)
    return language_id.identify(docs, model, (remainder(3) == 1).alias("held_out"))


@query()
def op11_simhash_dedup(spark, sf_dir):
    """Components of documents whose fingerprints of 3-word shingles differ in 3 bits or fewer."""
    return simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query(r"""
WITH piece AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
f AS (SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f FROM w, unnest(range(1, 5)) s(k), unnest(range(1, greatest(len(w) - k + 2, 1))) t(i) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
inside AS (SELECT lang, p[i:i + m - 1] AS p, max(f) AS longer FROM cand, unnest(range(2, k)) s(m), unnest(range(1, k - m + 2)) t(i) GROUP BY ALL),
kept AS (SELECT cand.* FROM cand LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * f),
cut AS (SELECT kept.lang, kept.p, kept.f AS a, c, l.f AS l, r.f AS r, (2000000::HUGEINT * kept.f) // (l.f + r.f) AS score FROM kept, unnest(range(1, k)) s(c) JOIN f l ON l.lang = kept.lang AND l.p = kept.p[1:c] JOIN f r ON r.lang = kept.lang AND r.p = kept.p[c + 1:]),
best AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, arg_min((l, r, score), score * 8 + c) AS m FROM cut GROUP BY ALL),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY m[3] DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, m[1]::BIGINT AS l, m[2]::BIGINT AS r, m[3]::BIGINT AS score FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""")
def op12_collocations(spark, sf_dir):
    """The first 2,000 phrases of each language by the score of their weakest cut."""
    return collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, j, v[4 * j + 1:4 * j + 4] AS x FROM k, unnest(range(16)) t(j)),
i AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 64),
c0 AS (SELECT j, e, x AS c FROM p JOIN i USING (vec_id)),
a0 AS (SELECT vec_id, label, j, x, min(((x[1] - c[1]) * (x[1] - c[1]) + (x[2] - c[2]) * (x[2] - c[2]) + (x[3] - c[3]) * (x[3] - c[3]) + (x[4] - c[4]) * (x[4] - c[4])) * 64 + e) AS m FROM p JOIN c0 USING (j) GROUP BY ALL),
c1 AS (SELECT j, e, coalesce(m, c) AS c FROM c0 LEFT JOIN (SELECT j, m % 64 AS e, [((sum(x[1]) - (sum(x[1]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT, ((sum(x[2]) - (sum(x[2]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT, ((sum(x[3]) - (sum(x[3]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT, ((sum(x[4]) - (sum(x[4]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT] AS m FROM a0 GROUP BY ALL) USING (j, e)),
a1 AS (SELECT vec_id, label, j, x, min(((x[1] - c[1]) * (x[1] - c[1]) + (x[2] - c[2]) * (x[2] - c[2]) + (x[3] - c[3]) * (x[3] - c[3]) + (x[4] - c[4]) * (x[4] - c[4])) * 64 + e) AS m FROM p JOIN c1 USING (j) GROUP BY ALL),
c2 AS (SELECT j, e, coalesce(m, c) AS c FROM c1 LEFT JOIN (SELECT j, m % 64 AS e, [((sum(x[1]) - (sum(x[1]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT, ((sum(x[2]) - (sum(x[2]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT, ((sum(x[3]) - (sum(x[3]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT, ((sum(x[4]) - (sum(x[4]) % count(*) + count(*)) % count(*)) // count(*))::BIGINT] AS m FROM a1 GROUP BY ALL) USING (j, e)),
a2 AS (SELECT vec_id, label, j, x, min(((x[1] - c[1]) * (x[1] - c[1]) + (x[2] - c[2]) * (x[2] - c[2]) + (x[3] - c[3]) * (x[3] - c[3]) + (x[4] - c[4]) * (x[4] - c[4])) * 64 + e) AS m FROM p JOIN c2 USING (j) GROUP BY ALL),
r AS (SELECT vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY j) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, e)) FROM c2) AS codebooks_sha256 FROM r""")
def op13_vector_codes(spark, sf_dir):
    """Codes of 16 parts of each vector, from codebooks of 64 entries after two rounds."""
    return vector_codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
