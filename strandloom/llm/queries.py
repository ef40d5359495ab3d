"""The queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, pii, quality
from .audio import align_with_members, fingerprints
from .decontaminate import find_leaks
from .jaccard import jaccard_join
from .line_dedup import dedup_lines
from .piece_fst import round_trips
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .token_store import digests, read_tokens, write_tokens


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return common.prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "op1")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return digests(read_tokens(spark, path))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find_personal_data(docs, pii.fit(docs)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = round_trips(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return trips.select("doc_id", "n_pieces", "ids_crc32", "round_trip", F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    joined = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return leaks.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), span=200)
    n = F.aggregate(F.transform("spans", lambda x, j: F.when(j % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return cut.select("doc_id", "n_bytes", n.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")


def op10_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no sound, so each page's bytes are taken as 8-bit PCM of 1,000 samples a second.

    Frames of 256 samples are then as long as 2,048 at 8 kHz, and tell pitch classes
    apart from 66 Hz on; a page of median length has some 30 positions.
    """
    media = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("sound"))
    return align_with_members(fingerprints(media, "page_id", "sound", rate=1000, frame=256, hop=64), id_col="page_id")


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_personal_data": op2_personal_data,
    "op3_quality": op3_quality,
    "op4_pieces": op4_pieces,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_chroma_alignment": op10_chroma_alignment,
}

#: Lines of each document, hashed in threes; all but the first occurrence of a window take their lines away.
OP5_SQL = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM docs),
wide AS (SELECT doc_id, p, line,
    line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
ranked AS (SELECT doc_id, p, line,
    win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS later FROM wide),
marked AS (SELECT doc_id, p, line,
    bool_or(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM ranked),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
    CASE WHEN d.text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

#: Words as arrays; windows of ten words, or a whole shorter item; joined as lists.
OP6_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM iw WHERE len(w) > 0)),
spot AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM item))),
hit AS (SELECT doc_id, item_id, s.n, p FROM spot s JOIN item i ON s.win = i.win AND s.n = i.n),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Distinct shingles, an inverted index for the overlaps, and the closure of the links.
OP8_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, least(len(w), 3) AS k, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS p FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) USING (doc_id)
"""

#: All windows of 200 bytes, as hex digits; runs of repeated starts; what lies between them.
OP9_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM d)),
again AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w WHERE s IN (SELECT s FROM again)),
run AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS r FROM hit),
span AS (SELECT doc_id, r, min(p) AS a, max(p) + 200 AS b FROM run GROUP BY ALL),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f FROM span),
cut AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept,
    sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(from_hex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op9_suffix_dedup": OP9_SQL,
}
