"""Section queries: hygiene, identifiers, statistics and tables of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.operators import render
from quire.operators import sections as so
from quire.plans.common import SECTIONS, query, sections
from quire.session import table

TITLES = "CASE seq % 40 WHEN 0 THEN 'Index' WHEN 1 THEN 'acknowledgements' WHEN 2 THEN ' List of Figures ' WHEN 3 THEN 'Indexing Strategies' WHEN 4 THEN 'front matter' ELSE docid END"
_MATTER_SQL = f"(?i)^\\s*({'|'.join(fx.MATTER)})\\s*$"


@query(f"WITH {SECTIONS}, titled AS (SELECT book_id, seq, {TITLES} AS title FROM sections) SELECT book_id, seq, title FROM titled WHERE NOT regexp_matches(title, '{_MATTER_SQL}')")
def front_matter_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections(spark, sf_dir).withColumn("title", F.expr(TITLES)).withColumn("path", F.array("book_id", "title"))
    return so.drop_front_matter(rows).select("book_id", "seq", "title")


@query(f"WITH {SECTIONS} SELECT book_id, seq, docid, length(text) AS n_chars FROM sections WHERE length(text) >= 200")
def min_chars_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.at_least(sections(spark, sf_dir)).select("book_id", "seq", "docid", F.length("text").cast("long").alias("n_chars"))


NOISY = "concat('  12 ', chr(10), 'Page 3 of 9', chr(10), text, '   ', chr(10), 'xiv', chr(10), 'CHAPTER 4', chr(10), 'exam-', chr(10), 'ple A-', chr(10), 'B', chr(10), chr(10), chr(10), chr(10), 'end', chr(13), chr(10))"


@query(f"""WITH noisy AS (SELECT doc_id, {NOISY} AS t FROM documents),
lines AS (SELECT doc_id, list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]'), lambda x: regexp_replace(x, '[\\s\\x1c-\\x1f]+$', '')) AS ls FROM noisy),
kept AS (SELECT doc_id, array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '(?i)^\\s*(\\d+|[ivxlc]+|chapter \\d+|page \\d+ of \\d+)\\s*$')), chr(10)) AS t FROM lines),
done AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '-\\n([a-z])', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g') AS t FROM kept)
SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM done""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = table(spark, sf_dir, "documents").select("doc_id", fx.clean_text(F.expr(NOISY.replace("chr(", "char("))).alias("t"))
    return noisy.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


DISAMBIGUATED = f"""{SECTIONS}, counted AS (SELECT *, count(*) OVER (PARTITION BY book_id, docid) > 1 AS was_fixed FROM sections),
named AS (SELECT book_id, seq, CASE WHEN was_fixed THEN array_to_string(path, ' > ') ELSE docid END AS docid, was_fixed, path, text FROM counted),
ranked AS (SELECT *, row_number() OVER (PARTITION BY book_id, docid ORDER BY seq) AS n FROM named),
unique_sections AS (SELECT book_id, seq, CASE WHEN n > 1 THEN docid || ' [' || n || ']' ELSE docid END AS docid, was_fixed, path, text FROM ranked)"""


@query(f"WITH {DISAMBIGUATED} SELECT book_id, seq, docid, was_fixed FROM unique_sections")
def docid_disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.disambiguate(sections(spark, sf_dir)).select("book_id", "seq", "docid", "was_fixed")


@query("""WITH leaves AS (SELECT 'b' || (c_nationkey % 4) AS book_id, c_custkey AS seq, CAST(c_custkey // 2 AS VARCHAR) AS leaf_id,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '  ' || c_mktsegment || '   x' || (c_custkey % 3) END AS title FROM customer),
named AS (SELECT *, coalesce(nullif(trim(regexp_replace(coalesce(title, leaf_id), '\\s+', ' ', 'g')), ''), leaf_id) AS t FROM leaves),
ranked AS (SELECT *, row_number() OVER (PARTITION BY book_id, t ORDER BY seq) AS n FROM named),
suffixed AS (SELECT *, CASE WHEN n > 1 THEN t || ' [' || n || ']' ELSE t END AS d FROM ranked)
SELECT book_id, seq, leaf_id, last_value(d) OVER (PARTITION BY book_id, leaf_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS docid FROM suffixed""")
def title_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit("   x"), (F.col("c_custkey") % 3).cast("string")))
    leaves = table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), (F.col("c_nationkey") % 4).cast("string")).alias("book_id"), F.col("c_custkey").alias("seq"), F.floor(F.col("c_custkey") / 2).cast("string").alias("leaf_id"), title.alias("title"))
    return so.leaf_titles(leaves).select("book_id", "seq", "leaf_id", "docid")


RENDERED = f"""{SECTIONS},
depths AS (SELECT book_id, seq, d, path[1:d] AS prefix FROM sections, (SELECT unnest([1, 2, 3]) AS d)),
firsts AS (SELECT book_id, prefix, d, min(seq) AS seq FROM depths GROUP BY ALL),
full_toc AS (SELECT book_id, string_agg(repeat('  ', d - 1) || prefix[d], chr(10) ORDER BY seq, d) AS toc FROM firsts GROUP BY 1),
cut_toc AS (SELECT book_id, string_agg(repeat('  ', d - 1) || CASE WHEN length(prefix[d]) > 48 THEN rtrim(substr(prefix[d], 1, 47)) || '…' ELSE prefix[d] END, chr(10) ORDER BY seq, d) AS toc FROM firsts GROUP BY 1),
capped_toc AS (SELECT book_id, string_agg(repeat('  ', d - 1) || prefix[d], chr(10) ORDER BY seq, d) AS toc FROM firsts WHERE d <= 2 GROUP BY 1),
leaf_firsts AS (SELECT book_id, docid, min(seq) AS seq FROM sections GROUP BY ALL),
leaf_toc AS (SELECT book_id, string_agg(docid, chr(10) ORDER BY seq) AS toc FROM leaf_firsts GROUP BY 1)"""


def _told(rendered: DataFrame) -> DataFrame:
    return rendered.select("book_id", F.length("toc").cast("long").alias("n_chars"), fx.est_tokens(F.col("toc")).alias("tokens"), F.md5("toc").alias("digest"))


def _toc_sql(name: str) -> str:
    return f"WITH {RENDERED} SELECT book_id, length(toc) AS n_chars, CAST(floor(length(toc) / 3.8::DOUBLE) AS INTEGER) AS tokens, md5(toc) AS digest FROM {name}"


@query(_toc_sql("full_toc"))
def render_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(render.full(sections(spark, sf_dir)))


@query(_toc_sql("leaf_toc"))
def render_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(render.leaves_only(sections(spark, sf_dir)))


@query(_toc_sql("cut_toc"))
def render_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(render.truncated(sections(spark, sf_dir)))


@query(_toc_sql("capped_toc"))
def render_depth_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(render.depth_capped(sections(spark, sf_dir), 2))


@query(f"""WITH {RENDERED}, tries AS (
  SELECT book_id, 0 AS prio, 'full' AS strategy, toc FROM full_toc UNION ALL SELECT book_id, 1, 'truncated', toc FROM cut_toc
  UNION ALL SELECT book_id, 2, 'leaves_only', toc FROM leaf_toc UNION ALL SELECT book_id, 3, 'depth_capped_3', toc FROM full_toc),
costed AS (SELECT *, CAST(floor(length(toc) / 3.8::DOUBLE) AS INTEGER) AS tokens FROM tries),
chosen AS (SELECT book_id, coalesce(min(prio) FILTER (WHERE tokens <= 700), 3) AS prio FROM costed GROUP BY 1),
tried AS (SELECT c.book_id, string_agg(c.strategy || '=' || c.tokens, ',' ORDER BY c.prio) AS attempts FROM costed c JOIN chosen h ON h.book_id = c.book_id AND c.prio <= h.prio GROUP BY 1),
leaves AS (SELECT book_id, count(*) AS n FROM sections GROUP BY 1)
SELECT c.book_id, c.strategy, c.tokens, c.strategy = 'full' AS lossless, CASE WHEN c.tokens > 700 THEN false END AS fits, n AS addressable_leaves, 100.0::DOUBLE AS recall_ceiling, attempts, md5(toc) AS digest
FROM costed c JOIN chosen h ON h.book_id = c.book_id AND h.prio = c.prio JOIN tried t ON t.book_id = c.book_id JOIN leaves l ON l.book_id = c.book_id""")
def fit_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = F.array_join(F.transform("attempts", lambda x: F.concat_ws("=", x["name"], x["tokens"].cast("string"))), ",")
    return render.fit_toc(sections(spark, sf_dir), 700).select("book_id", "strategy", "tokens", "lossless", "fits", "addressable_leaves", "recall_ceiling", attempts.alias("attempts"), F.md5("toc").alias("digest"))


@query(f"""WITH {RENDERED} SELECT s.book_id, count(*) AS n_leaves, max(len(path)) AS max_depth, round(avg(len(path)), 2) AS mean_depth, CAST(floor(avg(length(text))) AS BIGINT) AS mean_chars,
  list_sort(list(length(text)))[CAST(count(*) // 2 AS INTEGER) + 1] AS median_chars, count(*) FILTER (WHERE length(text) < 200) AS empty_sections,
  round(100.0::DOUBLE * count(*) FILTER (WHERE length(text) < 200) / count(*), 1) AS empty_pct, count(*) - count(DISTINCT docid) AS duplicate_titles, max(length(toc)) AS toc_prompt_chars
FROM sections s JOIN full_toc f ON f.book_id = s.book_id GROUP BY 1""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return so.corpus_stats(sections(spark, sf_dir))


@query(f"""WITH {DISAMBIGUATED}, raw AS (SELECT book_id, count(*) AS leaves_raw, count(*) - count(DISTINCT docid) AS dup_titles_before FROM sections GROUP BY 1),
kept AS (SELECT book_id, count(*) AS leaves_kept, count(*) - count(DISTINCT docid) AS dup_titles_after FROM unique_sections GROUP BY 1)
SELECT book_id, leaves_raw, leaves_kept, leaves_raw - leaves_kept AS dropped, dup_titles_before, dup_titles_after FROM raw JOIN kept USING (book_id)""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = sections(spark, sf_dir)
    return so.manifest(raw, so.disambiguate(raw)).select("book_id", "leaves_raw", "leaves_kept", "dropped", "dup_titles_before", "dup_titles_after")


@query("SELECT p_partkey, rtrim(ltrim(regexp_replace(lower(p_name || '  (' || p_brand || ') -- ' || p_type || '!'), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), '-')[1:48] AS slug FROM part")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit("  ("), "p_brand", F.lit(") -- "), "p_type", F.lit("!"))
    return table(spark, sf_dir, "part").select("p_partkey", fx.slug(name).alias("slug"))


@query("""WITH v AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'MISTRAL_MODEL' WHEN 1 THEN 'API_KEY' ELSE 'mistral_model' END AS name, '  ' || c_name || ' ' AS value FROM customer)
SELECT c_custkey, CASE WHEN name IN ('MISTRAL_MODEL', 'MISTRAL_API', 'MIXTRAL_MODEL', 'MIXTRAL_API') THEN name || '=' || value ELSE name || '=<redacted len=' || length(trim(value)) || '>' END AS shown FROM v""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, "MISTRAL_MODEL").when(k == 1, "API_KEY").otherwise("mistral_model")
    return table(spark, sf_dir, "customer").select("c_custkey", fx.redact(name, F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("shown"))
