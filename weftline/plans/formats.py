"""Queries that write a format from the driver tables and read it back: scans, sinks, streams, with SQL of what should come back."""

from __future__ import annotations


from pyspark.sql import functions as F

from weftline.functions import sequences as S
from weftline.operators import matrix, transcripts
from weftline.plans.basics import query
from weftline.plans.biology import ACTS, EXONS, SEQS, VARIANTS, acts, exons, seqs, table, variants
from weftline.plans.corpora import GREEDY
from weftline.sources import annotations, clinical, fasta, outputs, records, tables
from weftline.storage import scratch
from weftline.streaming import carried, feature_stream, ingest, packing_stream


def written(spark, name, write) -> str:
    """A new path under the shared folder, after ``write`` has filled it."""
    path = scratch(spark, name)
    write(path)
    return path


def rows(spark, sf_dir):
    return seqs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("seq_id"), "source", "seq")


def fasta_files(spark, sf_dir) -> str:
    return written(spark, "x.fasta", lambda p: fasta.write_fasta(rows(spark, sf_dir), p, width=80, description="source"))


@query(f"WITH {SEQS} SELECT 'd' || doc_id AS seq_id, coalesce(source, '') AS description, seq FROM seqs WHERE length(seq) BETWEEN 30 AND 2000")
def s01_k01_fasta(spark, sf_dir):
    """Sequences written and read back within bounds of length."""
    return fasta.read_fasta(spark, fasta_files(spark, sf_dir), 30, 2000)


@query("SELECT 'd' || doc_id || coalesce(' ' || source, '') AS seq_id FROM documents")
def s01_whole_headers(spark, sf_dir):
    """The whole header as id."""
    return fasta.read_fasta(spark, fasta_files(spark, sf_dir), whole_header=True).select("seq_id")


@query("SELECT source, (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR AS key FROM documents")
def s02_catalogue(spark, sf_dir):
    """Rows with repeated ids, keyed by place."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return fasta.catalogue(d, "source", allow_duplicates=True, order="doc_id").select("source", "key")


@query("SELECT count(*) AS n FROM documents")
def s03_record_count(spark, sf_dir):
    """How many records the files hold."""
    return fasta.count_records(spark, fasta_files(spark, sf_dir))


@query(f"WITH {EXONS} SELECT 'c' || chrom AS chrom, 'CDS' AS feature, s::INT AS start, e::INT AS \"end\", CASE WHEN tx % 2 = 1 THEN '-' ELSE '+' END AS strand, 't' || tx AS transcript, 'g ' || chrom AS gene FROM exons")
def s04_gtf(spark, sf_dir):
    """Annotation lines read back."""
    e = exons(spark, sf_dir)
    t, c = F.col("tx").cast("string"), F.col("chrom").cast("string")
    line = F.concat_ws("\t", F.concat(F.lit("c"), c), F.lit("src"), F.lit("CDS"), (F.col("s") + 1).cast("string"), F.col("e").cast("string"), F.lit("."), F.when(F.col("tx") % 2 == 1, "-").otherwise("+"), F.lit("."), F.concat(F.lit('gene_id "g '), c, F.lit('"; transcript_id "t'), t, F.lit('";')))
    lines = e.select(line.alias("value")).unionByName(spark.range(1).select(F.lit("# a comment").alias("value")))
    found = fasta.read_gtf(spark, written(spark, "gtf", lambda p: lines.write.text(p)))
    return found.select("chrom", "feature", "start", "end", "strand", F.col("attributes")["transcript_id"].alias("transcript"), F.col("attributes")["gene_id"].alias("gene"))


@query(f"WITH {SEQS} SELECT 'd' || doc_id AS id, seq AS sequence, lang FROM seqs WHERE length(seq) // 3 BETWEEN 5 AND 200")
def s05_codon_table(spark, sf_dir):
    """A table of coding sequences; its columns are found by name."""
    t = seqs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("gene"), F.col("seq").alias("cds"), "lang")
    path = written(spark, "codons.csv", lambda p: t.write.option("header", True).csv(p))
    return records.read_codon_csv(spark, path, min_codons=5, max_codons=200)


@query(f"WITH {SEQS} SELECT doc_id::VARCHAR AS id, (doc_id * 0.5::DOUBLE) AS value, seq AS ref_seq, 'test' AS split FROM seqs WHERE doc_id % 4 = 1 AND seq <> ''")
def s06_benchmark(spark, sf_dir):
    """One split of a labelled benchmark; U is read as T."""
    t = seqs(spark, sf_dir).filter("seq != ''").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 0.5).alias("value"), S.transcribe(F.col("seq")).alias("ref_seq"), F.when(F.col("doc_id") % 4 == 1, "test").otherwise("train").alias("split"))
    return tables.read_benchmark(spark, written(spark, "b.csv", lambda p: t.write.option("header", True).csv(p)), "test")


@query("SELECT 'a.csv' AS file, count(*) AS rows, '' AS missing FROM part UNION ALL SELECT 'b.csv', count(*), 'value,split' FROM supplier")
def s07_lacking_columns(spark, sf_dir):
    """Files and the columns that they lack."""
    base = scratch(spark, "download")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value"), F.col("p_name").alias("split")).write.option("header", True).csv(f"{base}/a.csv")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).write.option("header", True).csv(f"{base}/b.csv")
    return clinical.lacking(spark, {f"{base}/a.csv": ("id", "value", "split"), f"{base}/b.csv": ("id", "value", "split")})


@query("SELECT 'P' || p_partkey AS entry, 'DOMAIN' AS feature, 'DOMAIN ' || (p_size + 1) || '..' || (p_size + 9) || '; /note=\"' || p_type || '\"' AS text FROM part UNION ALL SELECT 'P' || p_partkey, 'HELIX', 'HELIX ' || p_size FROM part WHERE p_partkey % 3 > 0")
def s08_feature_table(spark, sf_dir):
    """Feature columns of a protein table as rows."""
    p, z = F.col("p_partkey"), F.col("p_size")
    domain = F.concat(F.lit("DOMAIN "), (z + 1).cast("string"), F.lit(".."), (z + 9).cast("string"), F.lit('; /note="'), "p_type", F.lit('"'))
    t = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), p.cast("string")).alias("Entry"), F.col("p_name").alias("Protein names"), domain.alias("Domain [FT]"), F.when(p % 3 > 0, F.concat(F.lit("HELIX "), z.cast("string"))).alias("Helix"))
    path = written(spark, "features.tsv", lambda x: t.write.option("sep", "\t").option("header", True).option("quote", "").csv(x))
    return annotations.read_features(spark, path, "entry")


@query(f"WITH {SEQS} SELECT doc_id AS entry, codons, residues, 'REGION' AS concept, 2 AS start, 5 AS stop, (row_number() OVER (ORDER BY doc_id)) AS domain FROM (SELECT doc_id, (length(seq) // 3)::INT AS codons, (length(seq) // 3)::INT AS residues FROM seqs WHERE length(seq) >= 15)")
def s09_codon_features(spark, sf_dir):
    """Annotated tables whose codons and residues lie one to one."""
    t = seqs(spark, sf_dir).filter("length(seq) >= 15").select(F.col("doc_id").alias("Entry"), F.col("seq").alias("Codon sequence"), S.translate(F.col("seq")).alias("Sequence"), F.lit("REGION 3..5").alias("Region"))
    path = written(spark, "codons.tsv", lambda x: t.write.option("sep", "\t").option("header", True).option("quote", "").csv(x))
    f = annotations.read_features(spark, path, "entry", "codon_sequence", "sequence").withColumn("entry", F.col("entry").cast("long"))
    f = f.filter(F.length("codon_sequence").between(3 * F.length("sequence"), 3 * F.length("sequence") + 2))
    spans = annotations.spans(f.withColumn("n", F.length("sequence")), "entry", "text", F.col("n"))
    return spans.join(f.select("entry", F.size(S.codons(F.col("codon_sequence"))).alias("codons"), F.length("sequence").alias("residues")), "entry").select("entry", "codons", "residues", "concept", "start", "stop", "domain")


@query(f"WITH {SEQS} SELECT 'd' || doc_id AS record_id, seq AS sequence, translate(seq, 'ACGT', 'HE~C') AS structure FROM seqs WHERE seq <> ''")
def s10_structures(spark, sf_dir):
    """Four-line records."""
    t = seqs(spark, sf_dir).filter("seq != ''")
    block = F.concat_ws("\n", F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.length("seq").cast("string"), "seq", F.translate("seq", "ACGT", "HE.C"), F.lit(""))
    return tables.read_structures(spark, written(spark, "records", lambda p: t.select(block.alias("value")).write.text(p)))


@query("SELECT count(*) AS rows, true AS same FROM nation")
def s11_checksums(spark, sf_dir):
    """Files whose checksum is that of what was written."""
    t = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("\n")).alias("text"))
    path = written(spark, "sums", lambda p: t.select("n_nationkey", F.rtrim("text", F.lit("\n")).alias("value")).repartition(5, "n_nationkey").write.partitionBy("n_nationkey").text(p))
    found = tables.checksums(spark, path).withColumn("n_nationkey", F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int"))
    t = t.join(found, "n_nationkey", "left").agg(F.count("*").alias("rows"), F.bool_and(F.coalesce(F.sha2("text", 256) == F.col("sha256"), F.lit(False))).alias("same"))
    return t


@query(f"WITH {SEQS} SELECT 'd' || doc_id AS id, seq AS sequence, unnest(['csv', 'fasta']) AS kind FROM seqs WHERE seq <> ''")
def s12_inputs(spark, sf_dir):
    """Inputs of two formats, told by their suffix."""
    t = rows(spark, sf_dir).filter("seq != ''")
    a = written(spark, "in.csv", lambda p: t.select(F.col("seq_id").alias("id"), F.col("seq").alias("sequence")).write.option("header", True).csv(f"{p}/x.csv"))
    b = written(spark, "in.fa", lambda p: fasta.write_fasta(t, f"{p}/x.fasta"))
    return clinical.read_input(spark, f"{a}/x.csv").withColumn("kind", F.lit("csv")).unionByName(clinical.read_input(spark, f"{b}/x.fasta").withColumn("kind", F.lit("fasta")))


@query(f"WITH {VARIANTS} SELECT 'chr' || chrom AS chrom, pos, 'A' AS ref, substr('ACGT', (alt + 1)::INT, 1) AS alt, event_id / 4 AS score FROM variants WHERE chrom IN (3, 7)")
def s13_variant_files(spark, sf_dir):
    """Headerless variant files of two chromosomes as one table."""
    v = variants(spark, sf_dir).select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("c"), F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "pos", F.lit("A").alias("ref"), F.substring(F.lit("ACGT"), (F.col("alt") + 1).cast("int"), F.lit(1)).alias("alt"), (F.col("event_id") / 4).alias("score"))
    path = written(spark, "variants", lambda p: v.write.partitionBy("c").option("sep", "\t").csv(p))
    return clinical.read_variants(spark, f"{path}/c=chr3", f"{path}/c=chr7")


@query("SELECT 'chr' || user_id % 22 AS chrom, event_id AS pos, 'A' AS ref, 'G' AS alt, 'chr' || user_id % 22 || '_' || event_id || '_A_G' AS id, event_type AS significance FROM events WHERE event_id % 3 > 0 AND event_id % 2 = 0 AND event_id % 5 > 0")
def s14_summary_variants(spark, sf_dir):
    """Reviewed single-base variants of one assembly."""
    k = F.col("event_id")
    t = table(spark, sf_dir, "events").select(F.when(k % 3 > 0, "single nucleotide variant").otherwise("Deletion").alias("Type"), F.when(k % 2 == 0, "GRCh38").otherwise("GRCh37").alias("Assembly"), (F.col("user_id") % 22).cast("string").alias("Chromosome"), k.alias("PositionVCF"), F.lit("A").alias("ReferenceAlleleVCF"), F.lit("G").alias("AlternateAlleleVCF"), F.when(k % 5 == 0, "no assertion criteria provided").otherwise("reviewed by expert panel").alias("ReviewStatus"), F.col("event_type").alias("ClinicalSignificance"))
    return clinical.summary_variants(t, "single nucleotide variant", "GRCh38").select("chrom", "pos", "ref", "alt", "id", "significance")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem SEMI JOIN (SELECT p_partkey FROM part WHERE p_size % 4 IN (1, 2)) p ON p_partkey = l_partkey")
def s15_census_variants(spark, sf_dir):
    """Sample rows of the genes that a census lists."""
    census = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 4).alias("tier"))
    return clinical.census_variants(table(spark, sf_dir, "lineitem"), census, "l_partkey", "tier", (1, 2)).select("l_orderkey", "l_linenumber", "l_partkey")


def assemblies(spark, sf_dir) -> str:
    c = table(spark, sf_dir, "customer")
    line = F.concat_ws("\t", F.concat(F.lit("GCF_"), F.col("c_custkey").cast("string"), F.lit(".1")), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "reference genome").otherwise("na"), "c_name")
    lines = spark.createDataFrame([("##  See the notes",), ("#assembly_accession\ttaxid\trefseq_category\tname",)], "value string").unionByName(c.select(line.alias("value")))
    return written(spark, "assemblies", lambda p: lines.write.text(p))


@query("SELECT 'GCF_' || c_custkey || '.1' AS assembly, c_nationkey::VARCHAR AS taxid, c_name AS name FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def s17_assemblies(spark, sf_dir):
    """Reference genomes of an assembly list, less listed taxa."""
    gone = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("taxid"))
    t = clinical.read_assemblies(spark, assemblies(spark, sf_dir), gone)
    return t.select(F.col("assembly_accession").alias("assembly"), "taxid", "name")


@query(f"WITH {SEQS}, c AS (SELECT doc_id, 'GCF_' || doc_id % 6 || '.1' AS assembly, doc_id % 6 AS a, 'ATG' || left(regexp_replace(seq, 'TAA|TAG|TGA', '', 'g'), 6) || 'AAATAA' AS cds FROM seqs WHERE length(seq) >= 60), v AS (SELECT * FROM c WHERE length(cds) % 3 = 0 AND substr(cds, 4, 3) NOT IN ('TAA', 'TAG', 'TGA') AND substr(cds, 7, 3) NOT IN ('TAA', 'TAG', 'TGA')) SELECT assembly, 'g' || a % 2 AS \"group\", a AS taxid, min('d' || doc_id) AS seq_id, cds FROM v GROUP BY ALL")
def s18_coding_rows(spark, sf_dir):
    """Valid coding sequences of genome files, each once in its assembly."""
    q = F.concat(F.lit("ATG"), F.substring(F.regexp_replace("seq", "TAA|TAG|TGA", ""), 1, 6), F.lit("AAATAA"))
    t = seqs(spark, sf_dir).filter("length(seq) >= 60").select((F.col("doc_id") % 6).alias("a"), F.concat(F.lit("lcl|d"), F.col("doc_id").cast("string")).alias("seq_id"), q.alias("seq"))
    lines = t.select(F.concat(F.lit("GCF_"), F.col("a").cast("string"), F.lit(".1")).alias("file"), F.concat(F.lit(">"), "seq_id", F.lit(" [gene]\n"), "seq").alias("value"))
    path = written(spark, "genomes", lambda p: lines.repartition(6, "file").write.partitionBy("file").text(p))
    cut = spark.read.option("lineSep", ">").text(path).select("value", F.input_file_name().alias("path")).filter(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^\s*(\S+)", 1)
    found = cut.select("path", head.alias("seq_id"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("seq"))
    about = spark.range(6).select(F.concat(F.lit("GCF_"), F.col("id").cast("string"), F.lit(".1")).alias("assembly"), F.concat(F.lit("g"), (F.col("id") % 2).cast("string")).alias("group"), F.col("id").alias("taxid"))
    return clinical.coding_rows(found, about, "path")


@query("SELECT c_custkey, c_name, 'n=' || c_nationkey AS folder FROM customer")
def s20_file_tree(spark, sf_dir):
    """All files below a folder, with where each row lies."""
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n"), (F.col("c_nationkey") % 3).alias("m"))
    path = written(spark, "tree", lambda p: t.write.partitionBy("m", "n").json(p))
    return clinical.read_tree(spark, path, "c_custkey long, c_name string").select("c_custkey", "c_name", F.split_part("file", F.lit("/"), F.lit(1)).alias("folder"))


@query(f"WITH {SEQS} SELECT doc_id, seq FROM seqs")
def s21_tokenised(spark, sf_dir):
    """A tokenised table without its length column."""
    t = seqs(spark, sf_dir).select("doc_id", "seq", F.length("seq").alias("length"))
    return spark.read.parquet(written(spark, "tokens", lambda p: t.write.parquet(p))).drop("length")


@query(f"WITH {VARIANTS}, s AS (SELECT k % 25 AS chrom, k // 25 * 40 AS start, k // 25 * 40 + 30 AS stop, k * 0.25::DOUBLE AS v FROM (SELECT p_partkey AS k FROM part)) SELECT event_id, chrom, pos, max(v) AS score FROM variants LEFT JOIN s USING (chrom) WHERE true GROUP BY event_id, chrom, pos HAVING false UNION ALL SELECT a.event_id, a.chrom, a.pos, (SELECT max(v) FROM s WHERE s.chrom = a.chrom AND a.pos >= s.start AND a.pos < s.stop) FROM variants a")
def s27_site_scores(spark, sf_dir):
    """Scores of bases, looked up in a table of spans."""
    k = F.col("p_partkey")
    spans = table(spark, sf_dir, "part").select((k % 25).alias("chrom"), (F.floor(k / 25) * 40).alias("start"), (F.floor(k / 25) * 40 + 30).alias("end"), (k * 0.25).alias("v"))
    return clinical.site_scores(variants(spark, sf_dir).select("event_id", "chrom", "pos"), spans, "chrom", "pos", F.col("v"))


@query(f"WITH {SEQS} SELECT seq AS sequence, (doc_id % 3)::INT AS label FROM seqs")
def s28_labelled_lines(spark, sf_dir):
    """Labelled sequences as JSON lines."""
    t = seqs(spark, sf_dir).select(F.col("seq").alias("sequence"), (F.col("doc_id") % 3).cast("int").alias("label"))
    return records.read_labelled_jsonl(spark, written(spark, "labelled", lambda p: t.write.json(p)))


@query(f"WITH {SEQS} SELECT 'd' || doc_id AS id, seq AS prompt FROM seqs WHERE seq <> ''")
def k02_prompts(spark, sf_dir):
    """Sequence files to prompts."""
    t = rows(spark, sf_dir).filter("seq != ''").withColumn("seq", F.lower("seq"))
    source, target = written(spark, "p.fasta", lambda p: fasta.write_fasta(t, p)), scratch(spark, "prompts")
    records.fasta_to_jsonl(spark, source, target, upper=True)
    return spark.read.schema("id string, prompt string").json(target)


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 64)::INT AS shard FROM documents")
def k03_shards(spark, sf_dir):
    """Shards of 64 records."""
    d = matrix.dense_index(table(spark, sf_dir, "documents"), "doc_id")
    path = written(spark, "shards", lambda p: tables.write_shards(d, "row_index", 64, p))
    return spark.read.parquet(path).select("doc_id", F.col("shard").cast("int").alias("shard"))


@query("WITH k AS (SELECT o_orderkey, o_orderkey % 9 || '-' || o_orderkey AS key FROM orders WHERE o_orderkey % 4 = 0) SELECT key, o_totalprice AS price, o_orderstatus AS status, ((row_number() OVER (ORDER BY key) - 1) // 100)::BIGINT AS shard FROM k JOIN orders USING (o_orderkey)")
def k04_joined_parts(spark, sf_dir):
    """Samples put together from two parts, a hundred to a shard."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").withColumn("key", F.concat_ws(".", (F.col("o_orderkey") % 9).cast("string"), F.col("o_orderkey").cast("string")))
    t = outputs.joined_parts({"a": o.select("key", "o_totalprice"), "b": o.select("key", "o_orderstatus")}, "key", 100)
    return t.select("key", F.col("a.o_totalprice").alias("price"), F.col("b.o_orderstatus").alias("status"), "shard")


@query(f"WITH {EXONS} SELECT 'c' || tx % 5 AS chrom, CASE WHEN tx % 2 = 1 AND r = 1 THEN s - 3 ELSE s END AS start, CASE WHEN tx % 2 = 0 AND r = n THEN e + 3 ELSE e END AS \"end\", tx || '_' || r AS name, CASE WHEN tx % 2 = 1 THEN '-' ELSE '+' END AS strand FROM (SELECT tx, s, e, row_number() OVER (PARTITION BY tx ORDER BY s) AS r, count(*) OVER (PARTITION BY tx) AS n FROM exons)")
def k05_exon_bed(spark, sf_dir):
    """Transcripts as a table, and their exons as BED lines made of it."""
    t = transcripts.extended(exons(spark, sf_dir).withColumn("minus", F.col("tx") % 2 == 1), "tx", "s", "e", "minus")
    t = t.withColumns({"chrom": F.concat(F.lit("c"), (F.col("tx") % 5).cast("string")), "strand": F.when(F.col("minus"), "-").otherwise("+")})
    path = written(spark, "transcripts.tsv", lambda p: outputs.write_tsv(t, p))
    found = spark.read.option("sep", "\t").option("header", True).csv(path)
    bed = written(spark, "exons.bed", lambda p: outputs.write_tsv(outputs.exon_bed(found, "tx", "chrom", "starts", "ends", "strand"), p, header=False))
    return spark.read.schema("chrom string, start long, end long, name string, score int, strand string").option("sep", "\t").csv(bed).drop("score")


@query(f"WITH RECURSIVE {SEQS}, {GREEDY.format(limit=10**12, budget=5000)} SELECT source, stretch, doc_id, batch AS chunk, (sum(n) OVER (PARTITION BY source, stretch, batch ORDER BY doc_id))::BIGINT - n AS start, (sum(n) OVER (PARTITION BY source, stretch, batch ORDER BY doc_id))::BIGINT AS stop FROM r")
def k06_token_chunks(spark, sf_dir):
    """Token chunks with an index of their rows."""
    t = seqs(spark, sf_dir).select("source", F.floor(F.col("doc_id") / 1000).alias("stretch"), "doc_id", F.length("seq").cast("long").alias("n"))
    return outputs.token_chunks(t, ["source", "stretch"], "doc_id", "n", 5000)


@query(f"WITH {ACTS} SELECT feature::INT AS feature, r::INT AS rank, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value DESC, vec_id) AS r FROM acts WHERE value > 0) WHERE r <= 8 AND feature % 3 = 1")
def k08_k10_k14_ranked(spark, sf_dir):
    """Ranked examples, written by ranges of features, read back for the live ones."""
    top = matrix.top_rows(acts(spark, sf_dir), "vec_id", 8).select("feature", "rank", "vec_id")
    path = written(spark, "ranked", lambda p: outputs.write_ranked(top, p, "feature", "rank", 4))
    live = acts(spark, sf_dir).select("feature").distinct().filter("feature % 3 = 1")
    return outputs.live_rows(spark.read.parquet(path), live, "feature")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents")
def k11_merged_predictions(spark, sf_dir):
    """Rows that readers took in turn, back in their order."""
    i = F.col("row_index")
    t = matrix.dense_index(table(spark, sf_dir, "documents"), "doc_id")
    t = t.select("doc_id", (F.floor(i / 8) % 3).alias("rank"), F.floor(i / 24).alias("batch"), (i % 8).alias("at"))
    found = spark.read.parquet(written(spark, "ranks", lambda p: t.write.partitionBy("rank").parquet(p)))
    return found.select("doc_id", outputs.merged_place(F.col("rank"), F.col("batch"), F.col("at"), 3, 8).alias("place"))


@query("SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer")
def k15_id_map(spark, sf_dir):
    """Names to dense places, through a file of JSON lines."""
    c = table(spark, sf_dir, "customer")
    path = written(spark, "map", lambda p: outputs.id_map(c, "c_custkey").write.json(p))
    return spark.read.schema("c_custkey long, place long").json(path).join(c, "c_custkey").select("c_name", "place")


@query(f"WITH {SEQS} SELECT 'd' || doc_id AS seq_id, seq FROM seqs WHERE length(seq) >= 30")
def z01_z04_followed_files(spark, sf_dir):
    """Files that a stream took up in two runs, the second resumed from the first one's checkpoint; each once."""
    t = rows(spark, sf_dir)
    source, target, mark = (scratch(spark, x) for x in ("stream", "target", "mark"))
    for k in range(2):
        part = t.filter(F.crc32("seq_id") % 2 == k)
        part.select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), "seq").alias("value")).write.mode("append").text(source)
        ingest.follow_fasta(spark, source, target, mark, min_length=30).awaitTermination()
    return spark.read.parquet(target).select("seq_id", "seq")


@query(f"WITH {ACTS} SELECT feature::INT AS feature, count(*) AS n, round(avg(value::DOUBLE), 6) AS mean, round(var_pop(value::DOUBLE), 6) AS variance, max(value) AS top FROM acts GROUP BY feature")
def z02_followed_stats(spark, sf_dir):
    """Feature statistics kept up over arriving activations."""
    a = acts(spark, sf_dir)
    source, parts, mark = (scratch(spark, x) for x in ("acts", "parts", "mark"))
    a.repartition(3, "vec_id").write.parquet(source)
    feature_stream.follow(spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(source), parts, mark).awaitTermination()
    t = feature_stream.merge(spark.read.parquet(parts))
    return t.select("feature", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "top")


@query("SELECT event_id FROM events")
def z03_shuffled_batches(spark, sf_dir):
    """Shuffled batches of a stream: every event once; a batch too large fails the job."""
    e = table(spark, sf_dir, "events").select("event_id")
    source, target, mark = (scratch(spark, x) for x in ("events", "batches", "mark"))
    e.repartition(4, "event_id").write.parquet(source)
    packing_stream.follow_shuffled(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(source), target, mark, "event_id", 5, 32).awaitTermination()
    t = spark.read.parquet(target)
    large = t.groupBy("trigger", "batch").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    fine = F.when(F.col("most") > 32, F.raise_error(F.lit("a batch of over 32 rows")).cast("boolean")).otherwise(F.lit(True))
    return t.crossJoin(F.broadcast(large.filter(fine))).select("event_id")  # one row


@query("SELECT b AS batch, least(32, (SELECT count(*) FROM events) - 32 * b) AS n FROM range(0, (SELECT ceil(count(*) / 32)::BIGINT FROM events)) t(b)")
def z03_buffered_shuffle(spark, sf_dir):
    """Batches of 32 events from a buffer of 500 that outlives micro-batches: how many different events each batch has."""
    e = table(spark, sf_dir, "events").select("event_id")
    source, target, mark = (scratch(spark, x) for x in ("events", "batches", "mark"))
    e.repartition(4, "event_id").write.parquet(source)
    carried.follow_buffered(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source), target, mark, "event_id", 5, 32, 500).awaitTermination()
    carried.finish_buffered(spark, target, "event_id long", "event_id", 5, 32)
    return spark.read.parquet(target).groupBy("batch").agg(F.countDistinct("event_id").alias("n"))


@query(f"WITH {SEQS} SELECT 'all' AS lane, sum(length(seq))::BIGINT AS tokens, ceil(sum(length(seq)) / 512)::BIGINT AS batches FROM seqs")
def z05_packed_lane(spark, sf_dir):
    """A stream packed into batches of 512 tokens in one lane of all rows."""
    t = seqs(spark, sf_dir).select(F.lit("all").alias("lane"), "doc_id", F.length("seq").alias("n"))
    source, target, mark = (scratch(spark, x) for x in ("items", "pieces", "mark"))
    t.repartition(3, "doc_id").write.parquet(source)
    carried.follow_packed(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(source), target, mark, "lane", "doc_id", "n", 512).awaitTermination()
    p = spark.read.parquet(target)
    return p.groupBy("lane").agg(F.sum(F.col("stop") - F.col("start")).alias("tokens"), F.countDistinct("batch").alias("batches"))


@query(f"WITH {SEQS}, i AS (SELECT doc_id % 4 AS lane, doc_id, length(seq)::BIGINT AS n FROM seqs WHERE length(seq) > 0) SELECT lane::VARCHAR AS lane, sum(n)::BIGINT AS tokens, ceil(sum(n) / 512)::BIGINT AS batches FROM i GROUP BY lane")
def z05_packed_stream(spark, sf_dir):
    """A stream packed into batches of 512 tokens, the open batch carried on: what each lane took and filled."""
    t = seqs(spark, sf_dir).select((F.col("doc_id") % 4).alias("lane"), "doc_id", F.length("seq").alias("n"))
    source, target, mark = (scratch(spark, x) for x in ("items", "pieces", "mark"))
    t.repartition(3, "doc_id").write.parquet(source)
    pieces = packing_stream.packed_pieces(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(source), "lane", "doc_id", "n", 512)
    pieces.writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    p = spark.read.parquet(target)
    return p.groupBy("lane").agg(F.sum(F.col("stop") - F.col("start")).alias("tokens"), F.countDistinct("batch").alias("batches"))


@query("WITH l AS (SELECT date_trunc('second', ts) AS ts, event_type AS metric, value FROM events WHERE value IS NOT NULL) SELECT time_bucket(INTERVAL '10 minutes', ts)::TIMESTAMP AS start, metric, count(*) AS n, round(avg(value), 6) AS mean FROM l GROUP BY ALL")
def z06_metric_windows(spark, sf_dir):
    """Metrics in windows of event time, from lines of a log."""
    t = table(spark, sf_dir, "events").filter("value is not null")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" - INFO - "), "event_type", F.lit(" iteration="), F.col("event_id").cast("string"), F.lit(" value="), F.col("value").cast("string"))
    path = written(spark, "log", lambda p: t.select(line.alias("value")).write.text(p))
    target, mark = scratch(spark, "windows"), scratch(spark, "mark")

    def put(df, k):
        df.write.mode("overwrite").parquet(f"{target}/part={k}")

    ingest.metric_windows(spark.readStream.text(path), late="400 days").writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(target)
    last = found.agg(F.max("part").alias("part"))
    return found.join(F.broadcast(last), "part").select("start", "metric", "n", F.round("mean", 6).alias("mean"))  # one row
