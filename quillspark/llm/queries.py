"""The contract queries of the subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._tables import fold, table
from quillspark.llm.ann import nearest
from quillspark.llm.collocations import collocations
from quillspark.llm.decontamination import find_contamination
from quillspark.llm.minhash_dedup import near_duplicates
from quillspark.llm.mixing import mix_documents
from quillspark.llm.packing import pack_documents
from quillspark.llm.quality_classifier import classify
from quillspark.llm.quality_rules import judge_quality
from quillspark.llm.sharding import shard_documents
from quillspark.llm.substring_dedup import remove_repeats
from quillspark.llm.toxicity import add_toxicity
from quillspark.llm.url_filters import RULES, SOFT, STRICT, filter_urls
from quillspark.llm.whitening import whiten


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs, shards=16).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge_quality(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    scored = classify(docs, labels, "quality", where=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", F.col("is_kept").alias("kept"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = add_toxicity(docs, labels, "toxic", where=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), top=2000)


def _url_sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, rules, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules, strict=True))
    hit = lambda term: f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    strict, soft = " OR ".join(map(hit, STRICT)), " + ".join(f"{hit(t)}::INT" for t in SOFT)
    return f"""
    WITH u AS (
      SELECT page_id, coalesce({lower.format('url')}, '') AS low,
        {lower.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages)
    SELECT page_id, host, path, CASE {rule} END AS rule,
      CASE {verdict} WHEN {strict} OR {soft} >= 2 THEN 'block' ELSE 'allow' END AS verdict
    FROM u"""


MIX_SQL = """
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('11|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS digest
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || digest[1:13])::BIGINT + 1) / 4503599627370496.0::DOUBLE)
      / greatest(0.05::DOUBLE, 1.0::DOUBLE - 20.0::DOUBLE * (length(t) - length(translate(t, '#*$%&|<>!', ''))) / greatest(length(t), 1)) AS k
  FROM base),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM keyed GROUP BY source),
capped AS (SELECT *, source_size * 3.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST) AS place FROM sources),
levels AS (
  SELECT a.*, (SELECT (sum(b.source_size) - sum(CASE WHEN b.place < a.place THEN b.cap ELSE 0 END)) / sum(CASE WHEN b.place >= a.place THEN b.w END) FROM capped b) AS level
  FROM capped a),
targets AS (
  SELECT source, source_size, least(cap, w * (SELECT arg_min(level, place) FROM levels WHERE cap / w >= level)) AS target FROM levels),
run AS (
  SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY k) - sum(size) OVER (PARTITION BY k.source, k) AS before,
    sum(size) OVER (PARTITION BY k.source ORDER BY k) AS upto, count(*) OVER (PARTITION BY k.source, k) AS n
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN upto < target - epochs * source_size THEN size
    WHEN before < target - epochs * source_size THEN least(size, floor((target - epochs * source_size - before) / n)) ELSE 0 END)::BIGINT AS taken
FROM run"""


REPEATS_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS t FROM p),
twice AS (SELECT t FROM h GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM h JOIN twice USING (t)),
words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)"""

LEAKS_SQL = r"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0),
pattern AS (SELECT DISTINCT item, least(len(ws), 10) AS m, array_to_string(ws[i:i + 9], ' ') AS t FROM p),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
s AS (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM pattern) WHERE len(ws) >= m),
hit AS (SELECT r, i, m, item FROM (SELECT r, i, m, array_to_string(ws[i:i + m - 1], ' ') AS t FROM s) JOIN pattern USING (m, t)),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + m)) AS j FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""

PHRASES_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
sizes AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, g, count(*) AS c FROM (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM s) GROUP BY ALL HAVING count(*) >= 30),
k AS (SELECT lang, m, g, c AS a, string_split(g, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
cuts AS (
  SELECT k.lang, k.g, k.m, a, k, l.c AS l, r.c AS r, (2000000 * a::HUGEINT) // (l.c + r.c) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.g = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = k.lang AND r.g = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, c, m, string_split(g, ' ') AS ws, unnest(range(2, m)) AS j FROM f WHERE m > 2),
part AS (SELECT lang, c, ws, j, unnest(range(1, m - j + 2)) AS i FROM inner_),
within_ AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS g, max(c) AS c FROM part GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN within_ USING (lang, g) WHERE within_.c IS NULL OR 100 * within_.c < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ann": op2_ann,
    "op3_sharding": op3_sharding,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_mixing": op6_mixing,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_url_filters": op9_url_filters,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_decontamination": op12_decontamination,
    "op13_collocations": op13_collocations,
}

ORACLE = {"op1_substring_dedup": REPEATS_SQL, "op6_mixing": MIX_SQL, "op9_url_filters": _url_sql(), "op12_decontamination": LEAKS_SQL, "op13_collocations": PHRASES_SQL}
