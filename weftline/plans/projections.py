"""Queries of row-wise operators: strands, residues, token types, checks, ids, casts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import sequences as S
from weftline.functions import tokens as T
from weftline.operators import matrix, sampling
from weftline.plans.basics import query
from weftline.plans.biology import AMINO, CODONS, EXPR, ROLL, SEQS, VARIANTS, expr, seqs, table, variants
from weftline.plans.training import IDS, SITES, TEXT, sites
from weftline.sources import annotations, tables

AA = f"(SELECT {AMINO} FROM (SELECT c AS c))"


@query(f"WITH {SEQS} SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS strict, CASE WHEN {ROLL.format(seed=21, key='doc_id')} < 0.3 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS maybe FROM seqs")
def p02_p13_strands(spark, sf_dir):
    """The strict reverse complement, and a reverse complement with probability 0.3."""
    s = F.col("seq")
    return seqs(spark, sf_dir).select("doc_id", S.strict_reverse_complement(F.lower(s)).alias("strict"), F.when(sampling.roll(F.col("doc_id"), 21) < 0.3, S.reverse_complement(s)).otherwise(s).alias("maybe"))


@query(f"WITH {SEQS}, {IDS}, a AS (SELECT doc_id, list_transform({CODONS}, lambda c: instr('{S.RESIDUES}', {AMINO}) - 1) AS aa FROM seqs) SELECT doc_id, {TEXT.format('aa')} AS residues, {TEXT.format('list_concat([0], list_transform(aa, lambda x: x + 1), [0])')} AS types FROM a")
def p08_amino_ids(spark, sf_dir):
    """Residue ids of the codons, and the types of the tokens between CLS and SEP."""
    t = seqs(spark, sf_dir)
    row = F.concat(F.array(F.lit(T.CLS)), T.codon_ids(F.col("seq")), F.array(F.lit(T.SEP)))
    return t.select("doc_id", T.joined(S.amino_ids(F.col("seq"))).alias("residues"), T.joined(T.token_types(row)).alias("types"))


@query("SELECT doc_id, 'S' || doc_id AS sample FROM documents")
def p17_sample_ids(spark, sf_dir):
    """Sample ids out of longer names; the names are written from the documents."""
    name = F.concat(F.coalesce("source", F.lit("A")), F.lit("__EXT-S"), F.col("doc_id").cast("string"), F.lit("__C"))
    return table(spark, sf_dir, "documents").select("doc_id", S.sample_id(name).alias("sample"))


@query(f"WITH {SEQS} SELECT doc_id, {TEXT.format('list_append(list_transform(range(1, length(seq) + 1), lambda i: ascii(substr(seq, i::INT, 1))), 0)')} AS ids FROM seqs")
def p18_upper_ids(spark, sf_dir):
    """Tokens of lower-case letters made upper case."""
    return seqs(spark, sf_dir).select("doc_id", T.joined(T.upper_ids(T.byte_ids(F.lower("seq")))).alias("ids"))


@query("SELECT doc_id, source AS origin, n_chars AS n_chars_total, lang AS written_in FROM documents")
def p19_standard_names(spark, sf_dir):
    """Columns with standard names."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docId"), F.col("source").alias("SRC"), F.col("n_chars").alias("nChars Total"), F.col("lang").alias("Written-in"))
    return tables.standard_names(t, {"SRC": "origin"})


@query(f"WITH {SEQS}, v AS (SELECT seq, (doc_id % 200)::INT AS p, source, lang FROM seqs) SELECT unnest(['length', 'position', 'null_source', 'null_lang']) AS check, unnest([count(*) FILTER (length(seq) % 3 <> 0), count(*) FILTER (p >= length(seq) // 3), count(*) FILTER (source IS NULL), count(*) FILTER (lang IS NULL)]) AS rows FROM v")
def p21_validated(spark, sf_dir):
    """How many rows break each rule of an output table."""
    t = seqs(spark, sf_dir).withColumn("p", (F.col("doc_id") % 200).cast("int"))
    return tables.validated(t, "seq", "p", "source", "lang")


@query(f"WITH {SEQS}, {SITES} SELECT doc_id, place, place < 62 AS within, place >= 62 AND place < length(seq) // 3 AS centring, length(seq) // 3 <= 62 AS whole FROM sites WHERE place < 126")
def p23_p24_context_bounds(spark, sf_dir):
    """Variants whose codon lies in the wider context, and how each lies in the narrow one."""
    n, p = F.floor(F.length("seq") / 3), F.col("place")
    return sites(spark, sf_dir).filter("place < 126").select("doc_id", "place", (p < 62).alias("within"), ((p >= 62) & (p < n)).alias("centring"), (n <= 62).alias("whole"))


@query(f"WITH {VARIANTS} SELECT event_id, chrom || '_' || pos || '_' || substr('ACGT', (1 + event_id % 4)::INT, 1) || '_' || substr('ACGT', (1 + alt)::INT, 1) || '_h1' AS id, 'T' || event_id AS tx FROM variants WHERE event_id % 3 > 0")
def p26_variant_ids(spark, sf_dir):
    """Ids of single-base variants, and transcript names without version; every third row is an insertion and goes."""
    base = F.substring(F.lit("ACGT"), (1 + F.col("event_id") % 4).cast("int"), F.lit(1))
    alt = F.substring(F.lit("ACGT"), (1 + F.col("alt")).cast("int"), F.lit(1))
    t = variants(spark, sf_dir).withColumns({"r": base, "a": F.when(F.col("event_id") % 3 == 0, F.concat(alt, alt)).otherwise(alt), "tx": F.concat(F.lit("T"), F.col("event_id").cast("string"), F.lit(".7"))})
    t = t.filter((F.length("r") == 1) & (F.length("a") == 1))
    return t.select("event_id", S.variant_id(F.col("chrom"), F.col("pos"), F.col("r"), F.col("a"), F.lit("h1")).alias("id"), S.unversioned(F.col("tx")).alias("tx"))


FIELDS = """entry AS (SELECT l_orderkey AS entry, k, CASE l_returnflag WHEN 'A' THEN 'DOMAIN' WHEN 'N' THEN 'HELIX' ELSE 'REGION' END || CASE WHEN l_linestatus = 'O' THEN ':b' || l_partkey % 5 ELSE '' END AS concept, (l_suppkey % 90)::INT AS start, (l_suppkey % 90 + 1 + l_partkey % 9)::INT AS stop
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem)),
span AS (SELECT entry, concept, start, stop, row_number() OVER (PARTITION BY concept ORDER BY entry, k) AS domain FROM entry WHERE stop <= 80)"""


def fields(spark, sf_dir):
    """``entry, text``: an annotation text for each order."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("entry")).agg(F.sort_array(F.collect_list(line)).alias("x"))

    def text(v):
        kind = F.when(v["l_returnflag"] == "A", "DOMAIN").when(v["l_returnflag"] == "N", "HELIX").otherwise("REGION")
        start = v["l_suppkey"] % 90 + 1
        note = F.when(v["l_linestatus"] == "O", F.concat(F.lit('; /note="b'), (v["l_partkey"] % 5).cast("string"), F.lit('"'))).otherwise("")
        return F.concat(kind, F.lit(" "), start.cast("string"), F.lit(".."), (start + v["l_partkey"] % 9).cast("string"), note, F.lit('; /evidence="E"'))

    return t.select("entry", F.array_join(F.transform("x", text), "; ").alias("text"))


@query(f"WITH {FIELDS} SELECT * FROM span")
def p30_annotation_spans(spark, sf_dir):
    """Annotation texts to spans, each the next instance of its concept."""
    return annotations.spans(fields(spark, sf_dir), "entry", "text", F.lit(80))


@query(f"WITH {FIELDS} SELECT entry, concept, p::INT AS place, max(domain) AS domain FROM span, unnest(range(start, stop)) t(p) GROUP BY ALL")
def p30_annotated_places(spark, sf_dir):
    """The instance that labels each place; later spans overwrite earlier ones."""
    return annotations.places(annotations.spans(fields(spark, sf_dir), "entry", "text", F.lit(80)), "entry")


@query("SELECT p_partkey, 'GO:' || p_partkey AS term, p_name AS name, regexp_extract(p_brand, '^([^0-9]*)', 1) AS prefix FROM part")
def p32_term_texts(spark, sf_dir):
    """Term ids and names out of texts, and prefixes of genes; the texts are written from the parts."""
    text = F.concat("p_name", F.lit(" [GO:"), F.col("p_partkey").cast("string"), F.lit("] more"))
    return table(spark, sf_dir, "part").select("p_partkey", S.term_id(text).alias("term"), S.term_name(text).alias("name"), S.gene_prefix(F.col("p_brand")).alias("prefix"))


@query(f"WITH {SEQS} SELECT doc_id, {TEXT.format('list_concat([-100], list_transform(range(1, length(seq) + 1), lambda i: [0, 1, 2, -100][instr(chr(65) || chr(67) || chr(71) || chr(84), substr(seq, i::INT, 1))]), [-100])')} AS three, {TEXT.format('list_concat([-100], list_transform(range(1, length(seq) + 1), lambda i: [1, 4, 7, -100][instr(chr(65) || chr(67) || chr(71) || chr(84), substr(seq, i::INT, 1))]), [-100])')} AS eight FROM seqs")
def p33_structure_labels(spark, sf_dir):
    """Labels of secondary structure, of three and of eight classes; the states are written from the letters."""
    s = F.translate("seq", "ACGT", "HEC~")
    return seqs(spark, sf_dir).select("doc_id", T.joined(T.structure_labels(s, T.THREE_STATES)).alias("three"), T.joined(T.structure_labels(s, T.EIGHT_STATES)).alias("eight"))


@query(f"WITH {SEQS} SELECT doc_id, substr(seq, 1, (doc_id % 40)::INT) AS five, substr(seq, (doc_id % 40 + 1)::INT, 60) AS coding, substr(seq, (doc_id % 40 + 61)::INT) AS three FROM seqs")
def p34_untranslated(spark, sf_dir):
    """A transcript cut into its three parts."""
    t = seqs(spark, sf_dir).select("doc_id", S.untranslated(F.col("seq"), (F.col("doc_id") % 40).cast("int"), F.lit(60)).alias("x"))
    return t.select("doc_id", "x.five", "x.coding", "x.three")


@query(f"WITH {EXPR} SELECT max(abs(v - trunc(v))) AS largest, count(*) FILTER (abs(v - trunc(v)) > 0.4) AS beyond, CASE WHEN max(value) < 256 THEN 'uint8' WHEN max(value) < 65536 THEN 'uint16' ELSE 'uint32' END AS fits FROM (SELECT value, (value / 8)::DECIMAL(18, 6)::DOUBLE AS v FROM expr)")
def p35_p36_types(spark, sf_dir):
    """What a cast of the values to integers would lose, and the least unsigned type that holds them."""
    t = expr(spark, sf_dir).withColumn("v", (F.col("value") / 8).cast("decimal(18,6)").cast("double"))
    return matrix.cast_losses(t, "v", "int", 0.4).crossJoin(matrix.least_unsigned(t, "value"))
