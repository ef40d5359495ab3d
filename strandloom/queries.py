"""The registered queries over genomes and haplotypes derived from the driver's tables, and their SQL.

documents give the genome (letters T, C, A, G and N of each text), lineitem the mutations,
orders the segregating sites, events the reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dna, rng
from .operators import genome as G
from .operators import mutations as M
from .operators import vcf_sites as V
from .plans import models

HAPS = 8
SEED = 42


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chroms(spark: SparkSession, sf_dir: str, with_bases: bool = False) -> DataFrame:
    """The documents as chromosomes; with_bases leaves out those without any, before they are filtered."""
    d = read(spark, sf_dir, "documents")
    if with_bases:
        d = d.where(F.col("text").rlike("[TCAGNtcagn]"))
    return d.select(F.col("doc_id").alias("chrom_id"), F.concat(F.lit("doc "), F.col("doc_id"), F.lit(":"), "source", F.lit(";"), "lang").alias("name"), dna.filter_bases("text").alias("seq"))


def haps(spark: SparkSession) -> DataFrame:
    return spark.range(HAPS).select(F.col("id").cast("int").alias("hap_id"), F.concat(F.lit("hap"), "id").alias("name"))


def mutations(spark: SparkSession, sf_dir: str, genome: DataFrame) -> DataFrame:
    """lineitem rows as mutations; of overlapping ones within a haplotype the first stays."""
    n = read(spark, sf_dir, "documents").agg(F.count("*").alias("n_chroms"))
    rows = read(spark, sf_dir, "lineitem").join(F.broadcast(n)).select(
        (F.col("l_suppkey") % HAPS).cast("int").alias("hap_id"),
        (F.col("l_partkey") % F.col("n_chroms")).alias("chrom_id"),
        (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729).alias("key"),
        F.col("l_returnflag").alias("flag"),
        (1 + F.col("l_quantity").cast("int") % 5).alias("size"),
    )
    # lengths are counted once for each chromosome, not for each row of lineitem
    rows = rows.join(genome.select("chrom_id", "seq", F.length("seq").alias("n")), "chrom_id").where("n > 10")
    rows = rows.withColumn("old_pos", F.col("key") % F.col("n")).withColumn("base", F.substring(F.col("seq"), F.col("old_pos").cast("int") + 1, F.lit(1)))
    room = F.least(F.col("size"), F.col("n") - F.col("old_pos") - F.when(F.col("old_pos") == 0, 1).otherwise(0)).cast("int")
    alt = F.when(F.col("flag") == "A", F.translate("base", "TCAGN", "CAGTT")).when(F.col("flag") == "N", F.concat("base", F.substring(F.lit("GATTACA"), F.lit(1), F.col("size")))).otherwise("")
    rows = rows.select("hap_id", "chrom_id", "old_pos", F.when(F.col("flag") == "R", room).otherwise(1).alias("ref_len"), alt.alias("alt"))
    return without_overlap(rows)


def without_overlap(rows: DataFrame) -> DataFrame:
    """Rows whose interval begins after every interval before it in the same haplotype and chromosome."""
    w = Window.partitionBy("hap_id", "chrom_id").orderBy("a", "b", "old_pos", "ref_len", "alt")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return V.intervals(rows).withColumn("before", before).where("before IS NULL OR a > before").select("hap_id", "chrom_id", "old_pos", "ref_len", "alt")


GENOME = """
ref AS (SELECT doc_id AS chrom_id, 'doc ' || doc_id || ':' || source || ';' || lang AS name,
  regexp_replace(translate(text, 'tcagn', 'TCAGN'), '[^TCAGN]', '', 'g') AS seq FROM documents)
"""
MUTATIONS = (
    GENOME
    + """,
cand AS (SELECT (l_suppkey % 8)::INT AS hap_id, r.chrom_id, r.seq, l_returnflag AS flag,
    (1 + l_quantity::INT % 5)::INT AS size, (l_orderkey * 7919 + l_linenumber * 104729) % length(r.seq) AS old_pos
  FROM lineitem JOIN ref r ON r.chrom_id = l_partkey % (SELECT count(*) FROM documents) WHERE length(r.seq) > 10),
shaped AS (SELECT hap_id, chrom_id, old_pos,
    CASE WHEN flag = 'R' THEN least(size, length(seq) - old_pos - CASE WHEN old_pos = 0 THEN 1 ELSE 0 END) ELSE 1 END::INT AS ref_len,
    CASE flag WHEN 'A' THEN translate(seq[old_pos + 1], 'TCAGN', 'CAGTT') WHEN 'N' THEN seq[old_pos + 1] || substr('GATTACA', 1, size) ELSE '' END AS alt FROM cand),
spans AS (SELECT *, CASE WHEN alt = '' AND old_pos > 0 THEN old_pos - 1 ELSE old_pos END AS a,
    CASE WHEN alt = '' AND old_pos = 0 THEN ref_len ELSE old_pos + ref_len - 1 END AS b FROM shaped),
mut AS (SELECT * EXCLUDE (before) FROM (SELECT *, max(b) OVER (PARTITION BY hap_id, chrom_id ORDER BY a, b, old_pos, ref_len, alt
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans) WHERE before IS NULL OR a > before)
"""
)
SITES = (
    MUTATIONS
    + """,
edge AS (SELECT *, max(b) OVER (PARTITION BY chrom_id ORDER BY a, b, hap_id, old_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM mut),
isle AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom_id ORDER BY a, b, hap_id, old_pos ROWS UNBOUNDED PRECEDING) AS site FROM edge),
bound AS (SELECT chrom_id, site, min(a) AS s, max(b) AS e FROM isle GROUP BY ALL),
piece AS (SELECT i.chrom_id, i.site, hap_id, s, e, seq, old_pos, ref_len, alt,
    lead(old_pos) OVER (PARTITION BY i.chrom_id, i.site, hap_id ORDER BY old_pos) AS nxt,
    row_number() OVER (PARTITION BY i.chrom_id, i.site, hap_id ORDER BY old_pos) AS rn
  FROM isle i JOIN bound USING (chrom_id, site) JOIN ref USING (chrom_id)),
allele AS (SELECT chrom_id, site, hap_id, s, substr(any_value(seq), s + 1, e - s + 1) AS ref,
    string_agg(CASE WHEN rn = 1 THEN substr(seq, s + 1, old_pos - s) ELSE '' END || alt ||
      substr(seq, old_pos + ref_len + 1, greatest(coalesce(nxt, e + 1) - old_pos - ref_len, 0)), '' ORDER BY old_pos) AS alt
  FROM piece GROUP BY chrom_id, site, hap_id, s, e),
numbered AS (SELECT chrom_id, site, alt, row_number() OVER (PARTITION BY chrom_id, site ORDER BY min(hap_id)) AS n
  FROM allele WHERE alt <> ref GROUP BY chrom_id, site, alt),
called AS (SELECT a.*, coalesce(n.n, 0) AS n FROM allele a LEFT JOIN numbered n USING (chrom_id, site, alt)),
alts AS (SELECT chrom_id, site, string_agg(alt, ',' ORDER BY n) AS alts FROM numbered GROUP BY ALL),
shown AS (SELECT DISTINCT chrom_id, site, s, ref, alts FROM allele JOIN alts USING (chrom_id, site))
"""
)
RANDOM = "((('0x' || substr(md5({key}), 1, 12))::BIGINT + 1) / 281474976710658.0)"


def u_sql(stream: str, *key: str) -> str:
    return RANDOM.format(key=" || '|' || ".join([f"'{SEED}|{stream}'", *[f"({k})::VARCHAR" for k in key]]))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


# --- sequences ---


@query(f"WITH {GENOME} SELECT chrom_id, seq FROM ref")
def fasta_filter(spark, sf):
    return chroms(spark, sf).select("chrom_id", "seq")


@query(f"WITH {GENOME} SELECT chrom_id, length(seq) AS size FROM ref")
def chrom_sizes(spark, sf):
    return G.Genome(chroms(spark, sf)).sizes().select("chrom_id", "size")


@query(f"WITH {GENOME} SELECT chrom_id, length(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(length(seq), 0) AS gc FROM ref")
def gc_prop(spark, sf):
    return G.Genome(chroms(spark, sf)).shares("GC").select("chrom_id", F.col("share").alias("gc"))


@query(f"""WITH {GENOME}, w AS (SELECT chrom_id, seq, unnest(range(0, length(seq), 100)) AS p FROM ref)
SELECT chrom_id, p + 1 AS start, length(regexp_replace(substr(seq, p + 1, 100), '[^GC]', '', 'g')) / length(substr(seq, p + 1, 100)) AS gc FROM w""")
def gc_prop_window(spark, sf):
    return G.windows(chroms(spark, sf), 100).select("chrom_id", "start", dna.gc_share("seq").alias("gc"))


@query(f"WITH {GENOME} SELECT chrom_id, nt, length(regexp_replace(seq, '[^' || nt || ']', '', 'g')) / nullif(length(seq), 0) AS share FROM ref, unnest(['T', 'C', 'A', 'G', 'N']) AS x(nt)")
def nt_prop(spark, sf):
    rows = [F.struct(F.lit(b).alias("nt"), dna.share("seq", b).alias("share")) for b in "TCAGN"]
    return chroms(spark, sf).select("chrom_id", F.explode(F.array(*rows)).alias("x")).select("chrom_id", "x.nt", "x.share")


@query(f"WITH {GENOME} SELECT chrom_id, reverse(translate(seq, 'TCAG', 'AGTC')) AS rc FROM ref")
def rev_comp(spark, sf):
    return chroms(spark, sf).select("chrom_id", dna.reverse_complement("seq").alias("rc"))


@query(f"WITH {GENOME} SELECT chrom_id, regexp_replace(name, '[ :;=%,\\\\|/\"'']', '_', 'g') AS name FROM ref")
def clean_names(spark, sf):
    return G.Genome(chroms(spark, sf)).clean_names().chroms.select("chrom_id", "name")


@query(f"WITH {GENOME} SELECT chrom_id, string_split(name, ' ')[1] AS name FROM ref")
def name_cut(spark, sf):
    return chroms(spark, sf).select("chrom_id", dna.cut_name("name").alias("name"))


@query(f"WITH {GENOME} SELECT chrom_id, p // 80 AS line_no, substr(seq, p + 1, 80) AS line FROM (SELECT chrom_id, seq, unnest(range(0, length(seq), 80)) AS p FROM ref)")
def fasta_wrap(spark, sf):
    return chroms(spark, sf).select("chrom_id", F.posexplode(dna.wrapped("seq", 80)).alias("line_no", "line")).select("chrom_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"WITH {GENOME} SELECT row_number() OVER (ORDER BY length(seq) DESC, chrom_id) - 1 AS chrom_id, name, length(seq) AS size FROM ref WHERE length(seq) >= 600")
def filter_size(spark, sf):
    return G.Genome(chroms(spark, sf)).filter_size(600).sizes()


@query(f"""WITH {GENOME}, run AS (SELECT *, sum(length(seq)) OVER (ORDER BY length(seq) DESC, chrom_id ROWS UNBOUNDED PRECEDING) AS upto FROM ref)
SELECT row_number() OVER (ORDER BY length(seq) DESC, chrom_id) - 1 AS chrom_id, name, length(seq) AS size FROM run
WHERE upto - length(seq) < 0.8 * (SELECT sum(length(seq)) FROM ref)""")
def filter_prop(spark, sf):
    return G.Genome(chroms(spark, sf)).filter_share(0.8).sizes()


@query(f"WITH {GENOME} SELECT chrom_id, name, length(seq) AS size FROM ref WHERE chrom_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rm_chroms(spark, sf):
    g = chroms(spark, sf)
    gone = read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("chrom_id"))
    return G.Genome(g).remove(g.join(gone, "chrom_id", "left_semi").select("name")).sizes()


@query(f"""WITH {GENOME} SELECT chrom_id, name, seq FROM ref UNION ALL
SELECT (SELECT max(chrom_id) FROM ref) + 1 + item_id, 'item' || item_id, regexp_replace(translate(text, 'tcagn', 'TCAGN'), '[^TCAGN]', '', 'g') FROM benchmark""")
def add_chroms(spark, sf):
    more = read(spark, sf, "benchmark").select(F.col("item_id").alias("at"), F.concat(F.lit("item"), "item_id").alias("name"), dna.filter_bases("text").alias("seq"))
    return G.Genome(chroms(spark, sf)).add(more).chroms


@query(f"""WITH {GENOME}, m AS (SELECT *, CASE chrom_id WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 11 THEN 3 END AS o FROM ref)
SELECT chrom_id, name, seq FROM m WHERE o IS NULL UNION ALL
SELECT 7, string_agg(name, '__' ORDER BY o), string_agg(seq, '' ORDER BY o) FROM m WHERE o IS NOT NULL""")
def merge_chroms(spark, sf):
    g = chroms(spark, sf)
    named = {r["chrom_id"]: r["name"] for r in g.where(F.col("chrom_id").isin(3, 7, 11)).select("chrom_id", "name").collect()}
    return G.Genome(g).merge([named[7], named[3], named[11]]).chroms


@query(f"WITH {GENOME} SELECT 0::BIGINT AS chrom_id, 'MERGE' AS name, md5(string_agg(seq, '' ORDER BY {u_sql('merge', 'chrom_id')}, chrom_id)) AS digest FROM ref")
def merge_all_hash(spark, sf):
    return G.Genome(chroms(spark, sf)).merge_all(SEED).chroms.select("chrom_id", "name", F.md5("seq").alias("digest"))


@query(f"WITH {GENOME} SELECT count(*) AS n_chroms, sum(length(seq))::BIGINT AS total_size, min(length(seq)) AS least, max(length(seq)) AS most FROM ref")
def genome_summary(spark, sf):
    n = dna.size("seq")
    return chroms(spark, sf).agg(F.count("*").alias("n_chroms"), F.sum(n).alias("total_size"), F.min(n).alias("least"), F.max(n).alias("most"))


@query(f"WITH {GENOME} SELECT r.chrom_id, 'part_' || p.p_name AS name FROM ref r JOIN part p ON p.p_partkey = r.chrom_id + 1")
def set_names_join(spark, sf):
    p = read(spark, sf, "part").select((F.col("p_partkey") - 1).alias("chrom_id"), F.concat(F.lit("part_"), "p_name").alias("name"))
    named = chroms(spark, sf).join(p, "chrom_id", "left_semi")
    return G.Genome(named).set_names(p).chroms.select("chrom_id", "name")


@query(f"WITH {GENOME} SELECT max(try_cast(regexp_extract(regexp_replace(name, ':.*', ''), '([0-9]+)$', 1) AS BIGINT)) + 1 AS next_number FROM ref")
def auto_names(spark, sf):
    g = chroms(spark, sf).withColumn("name", F.regexp_replace("name", ":.*", ""))
    return G.Genome(g).next_number().select("next_number")


@query(f"""WITH {GENOME} SELECT chrom_id, string_agg(CASE WHEN c <> 'N' THEN c ELSE
  CASE WHEN u <= 0.4 THEN 'T' WHEN u <= 0.7 THEN 'C' WHEN u <= 0.9 THEN 'A' ELSE 'G' END END, '' ORDER BY i) AS seq
FROM (SELECT chrom_id, i, seq[i + 1] AS c, {u_sql('n', 'chrom_id', 'i')} AS u FROM (SELECT chrom_id, seq, unnest(range(length(seq))) AS i FROM ref))
GROUP BY chrom_id""")
def replace_ns(spark, sf):
    g = chroms(spark, sf).where(F.length("seq") > 0)
    return G.Genome(g).replace_ns([4, 3, 2, 1], SEED).chroms.select("chrom_id", "seq")


@query(f"""SELECT chrom_id, string_agg(CASE WHEN u <= 0.25 THEN 'T' WHEN u <= 0.5 THEN 'C' WHEN u <= 0.75 THEN 'A' ELSE 'G' END, '' ORDER BY i) AS seq
FROM (SELECT chrom_id, i, {u_sql('base', 'chrom_id', 'i')} AS u FROM (SELECT c_custkey AS chrom_id, unnest(range(1, 51 + c_custkey % 50)) AS i FROM customer)) GROUP BY chrom_id""")
def create_genome_hash(spark, sf):
    sizes = read(spark, sf, "customer").select(F.col("c_custkey").alias("chrom_id"), (50 + F.col("c_custkey") % 50).alias("size"))
    return G.simulated_bases(sizes, [1, 1, 1, 1], SEED)


# --- haplotypes ---


def _both(spark, sf):
    g = chroms(spark, sf)
    return g, mutations(spark, sf, g)


@query("SELECT h.hap_id::INT AS hap_id, 'hap' || h.hap_id || CASE WHEN d.k > 0 THEN '_dup' || d.k ELSE '' END AS name FROM range(8) h(hap_id), range(3) d(k) WHERE k = 0 OR h.hap_id % 4 = 1")
def dup_haps(spark, sf):
    from .operators.haplotypes import duplicated

    h = haps(spark)
    again = h.where("hap_id % 4 = 1")
    return h.unionByName(duplicated(again.unionByName(again), h)).select("hap_id", "name")


@query(f"WITH {MUTATIONS} SELECT hap_id, chrom_id, old_pos, ref_len, alt FROM mut WHERE hap_id NOT IN (2, 5)")
def rm_haps(spark, sf):
    from .operators.haplotypes import Haplotypes

    g, m = _both(spark, sf)
    kept = Haplotypes(G.Genome(g), haps(spark), m).remove(["hap2", "hap5"])
    return kept.mutations.select("hap_id", "chrom_id", "old_pos", "ref_len", "alt")


@query(f"""WITH {MUTATIONS} SELECT hap_id, chrom_id, old_pos, old_pos + coalesce(sum(length(alt) - ref_len) OVER (PARTITION BY hap_id, chrom_id ORDER BY old_pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_pos FROM mut""")
def mutation_new_pos(spark, sf):
    return M.with_new_pos(_both(spark, sf)[1]).select("hap_id", "chrom_id", "old_pos", "new_pos")


@query(f"""WITH {MUTATIONS} SELECT hap_id, chrom_id, (length(alt) - ref_len)::INT AS size_mod, old_pos, old_pos + coalesce(sum(length(alt) - ref_len) OVER (PARTITION BY hap_id, chrom_id ORDER BY old_pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS new_pos, alt AS nucleos FROM mut""")
def view_mutations(spark, sf):
    return M.with_new_pos(_both(spark, sf)[1]).select("hap_id", "chrom_id", "size_mod", "old_pos", "new_pos", F.col("alt").alias("nucleos"))


@query(f"""WITH {MUTATIONS} SELECT h.hap_id::INT AS hap_id, r.chrom_id, (length(r.seq) + coalesce(d, 0))::BIGINT AS size FROM range(8) h(hap_id) CROSS JOIN ref r
LEFT JOIN (SELECT hap_id, chrom_id, sum(length(alt) - ref_len) AS d FROM mut GROUP BY ALL) m ON m.hap_id = h.hap_id AND m.chrom_id = r.chrom_id""")
def hap_sizes(spark, sf):
    g, m = _both(spark, sf)
    return M.sizes(g, haps(spark), m)


@query(f"""WITH {MUTATIONS} SELECT chrom_id, min(size)::BIGINT AS min_size FROM (SELECT h.hap_id, r.chrom_id, length(r.seq) + coalesce(sum(length(alt) - ref_len), 0) AS size
FROM range(8) h(hap_id) CROSS JOIN ref r LEFT JOIN mut m ON m.hap_id = h.hap_id AND m.chrom_id = r.chrom_id GROUP BY h.hap_id, r.chrom_id, r.seq) GROUP BY chrom_id""")
def min_hap_size(spark, sf):
    g, m = _both(spark, sf)
    return M.sizes(g, haps(spark), m).groupBy("chrom_id").agg(F.min("size").alias("min_size"))


@query(f"""WITH {MUTATIONS}, p AS (SELECT hap_id, chrom_id, seq, old_pos, ref_len, alt, lead(old_pos) OVER w AS nxt, row_number() OVER w AS rn FROM mut JOIN ref USING (chrom_id) WINDOW w AS (PARTITION BY hap_id, chrom_id ORDER BY old_pos)),
full_seq AS (SELECT hap_id, chrom_id, string_agg(CASE WHEN rn = 1 THEN substr(seq, 1, old_pos) ELSE '' END || alt || substr(seq, old_pos + ref_len + 1, coalesce(nxt, length(seq)) - old_pos - ref_len), '' ORDER BY old_pos) AS s FROM p GROUP BY ALL)
SELECT h.hap_id::INT AS hap_id, r.chrom_id, coalesce(s, r.seq) AS seq FROM range(8) h(hap_id) CROSS JOIN ref r LEFT JOIN full_seq f ON f.hap_id = h.hap_id AND f.chrom_id = r.chrom_id""")
def hap_materialize(spark, sf):
    g, m = _both(spark, sf)
    return M.materialize(g, haps(spark), m)


@query(f"""WITH {MUTATIONS} SELECT CASE WHEN d = 0 THEN 'sub' WHEN d > 0 THEN 'ins' ELSE 'del' END AS kind, base AS ref_base,
CASE WHEN d = 0 THEN alt ELSE abs(d)::VARCHAR END AS detail, count(*) AS n FROM (SELECT length(alt) - ref_len AS d, alt, seq[old_pos + 1] AS base FROM mut JOIN ref USING (chrom_id)) GROUP BY ALL""")
def mutation_spectrum(spark, sf):
    g, m = _both(spark, sf)
    return M.spectrum(g, m)


# --- VCF ---


@query(f"WITH {MUTATIONS} SELECT hap_id, chrom_id, old_pos, a, b FROM mut")
def vcf_intervals(spark, sf):
    return V.intervals(_both(spark, sf)[1]).select("hap_id", "chrom_id", "old_pos", "a", "b")


@query(f"WITH {SITES} SELECT chrom_id, s + 1 AS pos, e + 1 AS last, count(*) AS n FROM isle JOIN bound USING (chrom_id, site) GROUP BY ALL")
def vcf_sites(spark, sf):
    return V.islands(_both(spark, sf)[1]).groupBy("chrom_id", (F.col("start") + 1).alias("pos"), (F.col("end") + 1).alias("last")).agg(F.count("*").alias("n"))


@query(f"WITH {SITES} SELECT chrom_id, s + 1 AS pos, hap_id, ref, alt FROM allele")
def vcf_alts(spark, sf):
    g, m = _both(spark, sf)
    return V.alleles(g, m).select("chrom_id", (F.col("start") + 1).alias("pos"), "hap_id", "ref", "alt")


@query(f"""WITH {SITES}, gt AS (SELECT x.chrom_id, x.site, string_agg(coalesce(c.n, 0)::VARCHAR, ',' ORDER BY h.hap_id) AS gts
FROM shown x CROSS JOIN range(8) h(hap_id) LEFT JOIN called c ON c.chrom_id = x.chrom_id AND c.site = x.site AND c.hap_id = h.hap_id GROUP BY ALL)
SELECT chrom_id, s + 1 AS pos, ref, alts, gts FROM shown JOIN gt USING (chrom_id, site)""")
def vcf_genotypes(spark, sf):
    g, m = _both(spark, sf)
    return V.genotypes(g, m, haps(spark)).select("chrom_id", "pos", "ref", F.concat_ws(",", "alts").alias("alts"), F.concat_ws(",", F.transform("gts", lambda x: x.cast("string"))).alias("gts"))


@query(f"""WITH {SITES}, gt AS (SELECT x.chrom_id, x.site, h.hap_id // 2 AS sample, string_agg(coalesce(c.n, 0)::VARCHAR, '|' ORDER BY h.hap_id) AS g
FROM shown x CROSS JOIN range(8) h(hap_id) LEFT JOIN called c ON c.chrom_id = x.chrom_id AND c.site = x.site AND c.hap_id = h.hap_id GROUP BY ALL)
SELECT chrom_id, s + 1 AS pos, ref, alts, string_agg(g, ' ' ORDER BY sample) AS gts FROM shown JOIN gt USING (chrom_id, site) GROUP BY chrom_id, s, ref, alts""")
def vcf_diploid(spark, sf):
    g, m = _both(spark, sf)
    sites = V.sample_genotypes(V.genotypes(g, m, haps(spark)), [[1, 2], [3, 4], [5, 6], [7, 8]])
    return sites.select("chrom_id", "pos", "ref", F.concat_ws(",", "alts").alias("alts"), F.concat_ws(" ", "gts").alias("gts"))


@query(f"""WITH {GENOME}, r AS (SELECT (o_custkey % 8)::INT AS hap_id, chrom_id, 1 + o_orderkey % (length(seq) - 8) AS pos, seq,
    1 + o_orderkey % 4 AS nr, substr('GATTACATGCA', (1 + o_custkey % 5)::INT, (1 + o_custkey % 6)::INT) AS alt FROM orders JOIN ref ON chrom_id = o_orderkey % (SELECT count(*) FROM documents) WHERE length(seq) > 20),
v AS (SELECT hap_id, chrom_id, pos, substr(seq, pos, nr) AS ref, alt FROM r),
k AS (SELECT *, length(ref) AS nr, length(alt) AS na FROM v WHERE ref <> alt),
s AS (SELECT *, unnest(range(CASE WHEN na > nr THEN nr - 1 ELSE least(nr, na) END)) AS i FROM k)
SELECT hap_id, chrom_id, pos - 1 + i AS old_pos, 1 AS ref_len, alt[i + 1] AS alt FROM s WHERE alt[i + 1] <> ref[i + 1] UNION ALL
SELECT hap_id, chrom_id, pos - 2 + nr, 1, substr(alt, nr) FROM k WHERE na > nr UNION ALL
SELECT hap_id, chrom_id, pos - 1 + na, (nr - na)::INT, '' FROM k WHERE na < nr""")
def vcf_record_explode(spark, sf):
    g = chroms(spark, sf)
    n = g.agg(F.count("*").alias("n_chroms"))
    o = read(spark, sf, "orders").join(F.broadcast(n)).select("o_orderkey", "o_custkey", (F.col("o_orderkey") % F.col("n_chroms")).alias("chrom_id"))
    r = o.join(g.where(F.length("seq") > 20), "chrom_id").select(
        (F.col("o_custkey") % HAPS).cast("int").alias("hap_id"), "chrom_id", (1 + F.col("o_orderkey") % (F.length("seq") - 8)).alias("pos"), "seq", "o_orderkey", "o_custkey")
    alt = F.substring(F.lit("GATTACATGCA"), (1 + F.col("o_custkey") % 5).cast("int"), (1 + F.col("o_custkey") % 6).cast("int"))
    ref = F.substring(F.col("seq"), F.col("pos").cast("int"), (1 + F.col("o_orderkey") % 4).cast("int"))
    return V.from_records(r.select("hap_id", "chrom_id", "pos", ref.alias("ref"), alt.alias("alt")))


@query(f"WITH {GENOME} SELECT r.chrom_id, p.page_id AS contig FROM ref r JOIN pages p ON regexp_replace(r.name, ':.*', '') = 'doc ' || p.page_id")
def contig_match(spark, sf):
    contigs = read(spark, sf, "pages").select(F.concat(F.lit("doc "), "page_id").alias("short"), F.col("page_id").alias("contig"))
    return chroms(spark, sf).select("chrom_id", F.regexp_replace("name", ":.*", "").alias("short")).join(contigs, "short").select("chrom_id", "contig")


# --- models ---


def _numbers(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query("SELECT i::INT AS length, round(0.2 * exp(-i) / sum(exp(-i)) OVER (), 10) AS rate FROM range(1, 9) t(i)")
def indel_rates_exp(spark, sf):
    return _numbers(spark, [(i + 1, round(float(r), 10)) for i, r in enumerate(models.indels(0.2, 8).rates)], "length int, rate double")


@query("SELECT i::INT AS length, round(0.3 * power(i * 10 / (10 - i + 1), -0.5) / sum(power(i * 10 / (10 - i + 1), -0.5)) OVER (), 10) AS rate FROM range(1, 11) t(i)")
def indel_rates_lavalette(spark, sf):
    return _numbers(spark, [(i + 1, round(float(r), 10)) for i, r in enumerate(models.indels(0.3, 10, a=0.5).rates)], "length int, rate double")


@query("""SELECT t::DOUBLE AS t, a AS from_base, b AS to_base, round(CASE WHEN a = b THEN 0.25 + 0.75 * exp(-4 * t / 3) ELSE 0.25 - 0.25 * exp(-4 * t / 3) END, 9) AS p
FROM unnest([0.1, 0.5, 1.0, 2.0]) x(t), unnest(['T', 'C', 'A', 'G']) y(a), unnest(['T', 'C', 'A', 'G']) z(b)""")
def pt_jc69(spark, sf):
    m = models.jc69(0.1)
    return _numbers(spark, [(t, dna.BASES[i], dna.BASES[j], round(float(m.transition(t)[i, j]), 9)) for t in (0.1, 0.5, 1.0, 2.0) for i in range(4) for j in range(4)], "t double, from_base string, to_base string, p double")


@query("""WITH k AS (SELECT t, exp(-4 * 0.5 * t / (0.25 + 2 * 0.5)) AS e1, exp(-2 * (0.25 + 0.5) * t / (0.25 + 2 * 0.5)) AS e2 FROM unnest([0.1, 0.5, 1.0, 2.0]) x(t))
SELECT t::DOUBLE AS t, a AS from_base, b AS to_base, round(CASE WHEN a = b THEN 0.25 + 0.25 * e1 + 0.5 * e2 WHEN a || b IN ('TC', 'CT', 'AG', 'GA') THEN 0.25 + 0.25 * e1 - 0.5 * e2 ELSE 0.25 - 0.25 * e1 END, 9) AS p
FROM k, unnest(['T', 'C', 'A', 'G']) y(a), unnest(['T', 'C', 'A', 'G']) z(b)""")
def pt_k80(spark, sf):
    m = models.k80(0.25, 0.5)
    return _numbers(spark, [(t, dna.BASES[i], dna.BASES[j], round(float(m.transition(t)[i, j]), 9)) for t in (0.1, 0.5, 1.0, 2.0) for i in range(4) for j in range(4)], "t double, from_base string, to_base string, p double")


#: Two transition rates and one of transversions, by the frequencies of the bases; scaled to one change per unit of time.
TN93_SQL = """WITH par AS (SELECT {t}::DOUBLE AS ft, {c}::DOUBLE AS fc, {a}::DOUBLE AS fa, {g}::DOUBLE AS fg, {a1}::DOUBLE AS a1, {a2}::DOUBLE AS a2, {b}::DOUBLE AS b),
scaled AS (SELECT *, ft + fc AS fy, fa + fg AS fr, 2 * (ft * fc * a1 + fa * fg * a2 + (ft + fc) * (fa + fg) * b) AS mean FROM par),
base AS (SELECT * FROM (VALUES (0, 'T'), (1, 'C'), (2, 'A'), (3, 'G')) v(i, base)),
x AS (SELECT x.t, i.i, j.i AS j, i.base AS from_base, j.base AS to_base, [ft, fc, fa, fg][j.i + 1] AS f, CASE WHEN j.i < 2 THEN fy ELSE fr END AS own, CASE WHEN j.i < 2 THEN fr ELSE fy END AS other,
  exp(-b / mean * x.t) AS e, exp(-((CASE WHEN j.i < 2 THEN fr * b + fy * a1 ELSE fy * b + fr * a2 END) / mean) * x.t) AS k
  FROM scaled, base i, base j, unnest([0.1, 0.5, 1.0, 2.0]) x(t))
SELECT t::DOUBLE AS t, from_base, to_base, round(CASE WHEN i // 2 <> j // 2 THEN f * (1 - e) WHEN i = j THEN f + f * other / own * e + (own - f) / own * k ELSE f + f * other / own * e - f / own * k END, 9) AS p FROM x"""


def _tn93_sql(t, c, a, g, a1, a2, b):
    return TN93_SQL.format(t=t, c=c, a=a, g=g, a1=a1, a2=a2, b=b)


def _transitions(spark, p, digits=9):
    """P(t) as rows; p gives the matrix of a time."""
    return _numbers(spark, [(t, dna.BASES[i], dna.BASES[j], round(float(m[i, j]), digits)) for t in (0.1, 0.5, 1.0, 2.0) for m in [p(t)] for i in range(4) for j in range(4)], "t double, from_base string, to_base string, p double")


PI = (0.1, 0.2, 0.3, 0.4)


@query(_tn93_sql(*PI, 1, 1, 1))
def pt_f81(spark, sf):
    return _transitions(spark, models.f81(PI).transition)


@query(_tn93_sql(*PI, 0.5, 0.5, 0.25))
def pt_hky85(spark, sf):
    return _transitions(spark, models.hky85(PI, 0.5, 0.25).transition)


@query(_tn93_sql(*PI, "(1 + 0.7 / 0.3) * 0.25", "(1 + 0.7 / 0.7) * 0.25", 0.25))
def pt_f84(spark, sf):
    return _transitions(spark, models.f84(PI, 0.25, 0.7).transition)


@query(_tn93_sql(*PI, 0.5, 0.8, 0.25))
def pt_tn93(spark, sf):
    return _transitions(spark, models.tn93(PI, 0.5, 0.8, 0.25).transition)


@query(_tn93_sql(*PI, 0.6, 0.9, 0.3))
def pt_gtr(spark, sf):
    """A general reversible model whose transversions have one rate, which has a closed form."""
    return _transitions(spark, models.gtr(PI, [0.6, 0.3, 0.3, 0.3, 0.3, 0.9]).transition)


@query(_tn93_sql(*PI, 1, 1, 1))
def pt_unrest(spark, sf):
    """Unrestricted rates that are in truth the frequencies of the target, so that their equilibrium must be found."""
    return _transitions(spark, models.unrest([[0 if i == j else PI[j] for j in range(4)] for i in range(4)]).transition)


@query(_tn93_sql(*PI, 0.5, 0.8, 0.25).replace(", 9)", ", 6)"))
def pt_squaring(spark, sf):
    """P(t) by repeated squaring, as where the rates have no real eigenvalues; thirty squarings leave some seven digits."""
    m = models.tn93(PI, 0.5, 0.8, 0.25)
    return _transitions(spark, lambda t: models.transition_by_squaring(m.q, t), 6)


@query("""SELECT base, round(f, 9) AS frequency, round(f / (0.1 * 0.9 + 0.2 * 0.8 + 0.3 * 0.7 + 0.4 * 0.6) * (1 - f) / f, 9) AS rate
FROM (VALUES ('T', 0.1::DOUBLE), ('C', 0.2::DOUBLE), ('A', 0.3::DOUBLE), ('G', 0.4::DOUBLE)) v(base, f)""")
def equilibrium_rates(spark, sf):
    """Frequencies found from unrestricted rates, and how fast each base changes."""
    m = models.unrest([[0 if i == j else PI[j] for j in range(4)] for i in range(4)])
    return _numbers(spark, [(dna.BASES[i], round(float(m.pi[i]), 9), round(float(m.rates_by_base()[i]), 9)) for i in range(4)], "base string, frequency double, rate double")


@query("""WITH cut AS (SELECT i::INT AS i, CASE WHEN i = 0 THEN 1 ELSE ((1 - i / 6) * (1 - ln(1 - i / 6))) END AS low, CASE WHEN i = 5 THEN 0 ELSE (1 - (i + 1) / 6) * (1 - ln(1 - (i + 1) / 6)) END AS high FROM range(6) r(i))
SELECT i, round(6 * (low - high), 6) AS rate FROM cut""")
def discrete_gamma(spark, sf):
    """Six classes of a Gamma distribution of shape 1, which is exponential."""
    return _numbers(spark, [(i, round(float(x), 6)) for i, x in enumerate(models.discrete_gamma(1.0, 6))], "i int, rate double")


@query("""WITH w AS (SELECT base, f, 0.1 AS r, [0.1, 0.2, 0.3, 0.4] AS pis FROM (VALUES (0, 0.1::DOUBLE), (1, 0.2::DOUBLE), (2, 0.3::DOUBLE), (3, 0.4::DOUBLE)) v(base, f)),
m AS (SELECT 0.1 * 0.9 + 0.2 * 0.8 + 0.3 * 0.7 + 0.4 * 0.6 AS mean),
e AS (SELECT base, j::INT AS event, CASE WHEN j < 4 THEN CASE WHEN j = base THEN 0 ELSE pis[j + 1] / mean END ELSE 0.25 * 0.1 * exp(-((j - 4) % 2 + 1)) / (exp(-1) + exp(-2)) END AS x FROM w, m, range(8) t(j))
SELECT base::INT AS base, event, round(x / sum(x) OVER (PARTITION BY base), 9) AS weight FROM e""")
def event_weights(spark, sf):
    """Chances of each substitution, insertion and deletion of one or two bases, by base."""
    indels = models.indels(0.1, 2)
    w = models.event_weights(models.f81(PI), indels, indels)
    return _numbers(spark, [(i, j, round(float(w[i, j]), 9)) for i in range(4) for j in range(8)], "base int, event int, weight double")


# --- segregating sites ---


SSITES = f"""WITH {GENOME}, n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT r.chrom_id, r.seq, floor((o_totalprice - floor(o_totalprice)) * length(r.seq))::BIGINT AS pos, o_orderkey AS site_id
  FROM orders, n JOIN ref r ON r.chrom_id = o_orderkey % n.n WHERE length(r.seq) > 0 AND o_totalprice > floor(o_totalprice)),
site AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom_id, pos ORDER BY site_id) AS rn FROM s) WHERE rn = 1)"""


def _ssites(spark, sf):
    from .operators.haplotypes import site_positions

    g = chroms(spark, sf)
    n = g.agg(F.count("*").alias("n_chroms"))
    share = F.col("o_totalprice") - F.floor("o_totalprice")
    sites = read(spark, sf, "orders").join(F.broadcast(n)).select((F.col("o_orderkey") % F.col("n_chroms")).alias("chrom_id"), F.col("o_orderkey").alias("site_id"), share.alias("pos")).where("pos > 0")
    return g, site_positions(sites, g.where(F.length("seq") > 0))


@query(SSITES + " SELECT chrom_id, site_id, pos FROM site")
def ssites_normalize(spark, sf):
    return _ssites(spark, sf)[1].select("chrom_id", "site_id", "pos")


@query(SSITES + f""", e AS (SELECT chrom_id, site_id, pos, seq[pos + 1] AS base, {u_sql('ssite', 'chrom_id', 'pos')} AS u FROM site)
SELECT (o_custkey % 8)::INT AS hap_id, e.chrom_id, pos AS old_pos, 1 AS ref_len, substr(replace('TCAG', base, ''), (1 + floor(u * 3))::INT, 1) AS alt
FROM e JOIN orders ON o_orderkey = site_id WHERE base IN ('T', 'C', 'A', 'G')""")
def ssites_mutations(spark, sf):
    from .operators.haplotypes import site_mutations

    g, sites = _ssites(spark, sf)
    carriers = read(spark, sf, "orders").select(F.col("o_orderkey").alias("site_id"), (F.col("o_custkey") % HAPS).cast("int").alias("hap_id"))
    return site_mutations(g, sites, carriers, models.jc69(1.0), None, None, SEED)


@query("""SELECT species, coalesce(theta_s, pi_s)::DOUBLE AS theta, Ne::DOUBLE AS n_e, subs::DOUBLE AS rate FROM (VALUES
('Agrobacterium tumefaciens', NULL, 0.2, 342.47, 2.92), ('Bacillus subtilis', 0.041, NULL, 61.19, 3.35), ('Escherichia coli', 0.071, NULL, 179.6, 2.0),
('Mesoplasma florum', 0.021, NULL, 1.07, 97.8), ('Pseudomonas aeruginosa', NULL, 0.033, 210.7, 0.79), ('Staphlyococcus epidermidis', 0.052, NULL, 35.14, 7.4),
('Vibrio cholerae', 0.11, NULL, 478.26, 1.15), ('Arabidopsis thaliana', 0.008, NULL, 0.29, 69.5), ('Caenorhabditis elegans', 0.003, NULL, 0.54, 14.5),
('Chlamydomonas reinhardtii', 0.032, NULL, 43.31, 3.8), ('Drosophila melanogaster', 0.018, NULL, 0.86, 51.65), ('Homo sapiens', 0.001, NULL, 0.02, 135.13),
('Mus musculus', NULL, 0.004, 1.77, 54.0), ('Paramecium tetraurelia', 0.008, NULL, 101.8, 0.19), ('Saccharomyces cerevisiae', 0.004, NULL, 7.78, 2.63)) v(species, theta_s, pi_s, Ne, subs)""")
def evo_rates_theta_all(spark, sf):
    from .sources.rates import evo_rates

    return evo_rates(spark).select("species", F.coalesce("theta_s", "pi_s").alias("theta"), F.col("Ne").alias("n_e"), F.col("subs").alias("rate"))


# --- reads ---


def _dealt(spark, sf):
    """A read for every event, of any document: 150 bases, or the whole of a shorter chromosome from its start."""
    g = chroms(spark, sf).withColumn("seq", F.coalesce("seq", F.lit("")))
    n = g.agg(F.count("*").alias("n_chroms"))
    k = F.col("event_id")
    e = read(spark, sf, "events").join(F.broadcast(n)).select("event_id", (F.col("user_id") % HAPS).cast("int").alias("hap_id"), (k % F.col("n_chroms")).alias("chrom_id"))
    return e.join(g, "chrom_id").withColumns({
        "start": F.floor(rng.uniform(SEED, "start", k) * F.greatest(F.length("seq") - 149, F.lit(1))).cast("long"),
        "strand": F.when(rng.uniform(SEED, "strand", k) < 0.5, "F").otherwise("R"),
    })


DEALT = f"""WITH {GENOME}, e AS (SELECT event_id, (user_id % 8)::INT AS hap_id, r.chrom_id, r.name, coalesce(r.seq, '') AS seq,
    floor({u_sql('start', 'event_id')} * greatest(length(coalesce(r.seq, '')) - 149, 1))::BIGINT AS start, CASE WHEN {u_sql('strand', 'event_id')} < 0.5 THEN 'F' ELSE 'R' END AS strand
  FROM events JOIN ref r ON r.chrom_id = event_id % (SELECT count(*) FROM documents))"""


@query(DEALT + " SELECT hap_id, chrom_id, count(*) AS n_reads FROM e GROUP BY ALL")
def read_allocation_all(spark, sf):
    return _dealt(spark, sf).groupBy("hap_id", "chrom_id").agg(F.count("*").alias("n_reads"))


@query(DEALT + " SELECT event_id, start, rpad(substr(seq, start + 1, 150), 150, 'N') AS fragment FROM e")
def read_fragments_all(spark, sf):
    return _dealt(spark, sf).select("event_id", "start", dna.padded_read("seq", "start", 150).alias("fragment"))


def _dealt_mates(spark, sf):
    """Mates from both ends of what there is of the fragment, each filled with N to 100."""
    from .operators.reads import mate_columns

    fragment = F.substring(F.col("seq"), F.col("start").cast("int") + 1, F.lit(150))
    return mate_columns(_dealt(spark, sf).withColumn("fragment", fragment), 100, matepair=False).withColumn("read", F.rpad("read", 100, "N"))


DEALT_MATES = DEALT + """, f AS (SELECT *, substr(seq, start + 1, 150) AS fragment FROM e),
m AS (SELECT event_id, name, start, 1 AS mate, strand, rpad(CASE WHEN strand = 'F' THEN substr(fragment, 1, 100) ELSE reverse(translate(right(fragment, 100), 'TCAG', 'AGTC')) END, 100, 'N') AS read FROM f UNION ALL
SELECT event_id, name, start, 2, CASE WHEN strand = 'F' THEN 'R' ELSE 'F' END, rpad(CASE WHEN strand = 'R' THEN substr(fragment, 1, 100) ELSE reverse(translate(right(fragment, 100), 'TCAG', 'AGTC')) END, 100, 'N') FROM f)"""


@query(DEALT_MATES + " SELECT event_id, mate, strand, read FROM m")
def mate_geometry_all(spark, sf):
    return _dealt_mates(spark, sf).select("event_id", "mate", "strand", "read")


@query(DEALT_MATES + " SELECT event_id, mate, '@REF-' || regexp_replace(name, '[ :;=%,\\\\|/\"'']', '_', 'g') || '-' || start || '-' || strand || '/' || mate || chr(10) || read || chr(10) || '+' || chr(10) || repeat('I', 100) AS record FROM m")
def fastq_records_all(spark, sf):
    head = dna.fastq_id(F.lit("REF"), dna.clean_name("name"), "start", "strand", "mate")
    return _dealt_mates(spark, sf).select("event_id", "mate", F.concat_ws("\n", head, "read", F.lit("+"), F.repeat(F.lit("I"), 100)).alias("record"))


@query("SELECT q::INT AS q, round(CASE WHEN q = 0 THEN 1.0 ELSE power(10, -q / 10) END, 12) AS p, chr((33 + q)::INT) AS c FROM range(0, 42) t(q)")
def phred(spark, sf):
    q = spark.range(42).select(F.col("id").cast("int").alias("q")).withColumn("p", F.round(dna.phred_probability("q"), 12))
    return q.select("q", "p", dna.phred_char("p").alias("c"))


@query("""SELECT n::INT AS read_length, CASE WHEN n <= 44 THEN 'GA1' WHEN n <= 75 THEN 'GA2' WHEN n <= 100 THEN 'HS20' WHEN n <= 150 THEN 'HS25' ELSE 'MSv1' END AS seq_sys FROM range(10, 251, 10) t(n)""")
def profile_top1(spark, sf):
    from .sources.profiles import default_system

    n = spark.range(10, 251, 10).select(F.col("id").cast("int").alias("read_length"))
    return default_system(n)


# --- without SQL: order-dependent folds and numerical simulation, tested by their properties ---


@query()
def edit_fold(spark, sf):
    """Edits in growing coordinates, one per order line, folded per haplotype and chromosome.

    Positions spread over the haplotype as edited so far, by modulo of its size.
    """
    g, m = _both(spark, sf)
    n = g.agg(F.count("*").alias("n_chroms"))
    rows = read(spark, sf, "lineitem").join(F.broadcast(n)).select(
        (F.col("l_suppkey") % HAPS).cast("int").alias("hap_id"), (F.col("l_partkey") % F.col("n_chroms")).alias("chrom_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq_no"),
        F.when(F.col("l_returnflag") == "A", "sub").when(F.col("l_returnflag") == "N", "ins").otherwise("del").alias("kind"),
        (F.col("l_orderkey") * 104729 + F.col("l_linenumber") * 7919).alias("pos"), F.when(F.col("l_returnflag") == "A", "G").otherwise("ACA").alias("text"), F.lit(2).alias("n"))
    return M.edit(g.withColumn("seq", F.coalesce("seq", F.lit(""))), m, rows, wrap=True)


def _bases(spark, sf):
    """The documents as a genome, without those that have no bases, which can have neither mutations nor reads."""
    return G.Genome(chroms(spark, sf, with_bases=True))


@query()
def evolve_tree(spark, sf):
    from .operators.haplotypes import Phylo, create_haplotypes
    from .sources.newick import parse

    tree = parse("((a:0.1,b:0.1):0.05,(c:0.07,d:0.07):0.08);")
    h = create_haplotypes(_bases(spark, sf), Phylo([tree]), models.hky85([0.1, 0.2, 0.3, 0.4], 0.5, 0.25, gamma_shape=1.0, invariant=0.1), models.indels(0.1), models.indels(0.1), seed=SEED)
    return h.mutations


def _named(spark, sf):
    return _bases(spark, sf).chroms.select(F.lit("REF").alias("hap"), F.col("name").alias("chrom"), "seq")


@query()
def illumina_reads(spark, sf):
    """A pair of reads for every event."""
    from .operators.reads import illumina

    return illumina(_named(spark, sf), 2 * read(spark, sf, "events").count(), seed=SEED)


@query()
def pacbio_reads(spark, sf):
    """A long read for every event."""
    from .operators.reads import pacbio

    return pacbio(_named(spark, sf), read(spark, sf, "events").count(), seed=SEED)
