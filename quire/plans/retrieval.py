"""Retrieval queries: BM25, tries, metrics and significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import words
from quire.operators import bm25, metrics, reports, significance, trie
from quire.plans.common import RANKINGS, SECTIONS, SYSTEMS, benchmark_queries, query, rankings, sections
from quire.session import materialize, table

BM25 = f"""{SECTIONS},
queries AS (SELECT b.book_id, CAST(item_id AS VARCHAR) AS qid, text FROM benchmark, (SELECT DISTINCT source AS book_id FROM documents) b),
toks AS (SELECT book_id, seq, regexp_extract_all(lower(docid || chr(10) || array_to_string(path, ' > ') || chr(10) || text), '[a-z0-9]+') AS w FROM sections),
terms AS (SELECT book_id, seq, len(w) AS dl, unnest(w) AS term FROM toks),
postings AS (SELECT book_id, seq, dl, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT book_id, count(*) AS n, avg(len(w)) AS avgdl FROM toks GROUP BY 1),
dfs AS (SELECT book_id, term, count(*) AS df FROM postings GROUP BY 1, 2),
raw_idf AS (SELECT d.book_id, term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM dfs d JOIN sizes s ON s.book_id = d.book_id),
means AS (SELECT book_id, avg(idf) AS mean_idf FROM raw_idf GROUP BY 1),
weights AS (SELECT r.book_id, term, CASE WHEN idf < 0 THEN 0.25::DOUBLE * mean_idf ELSE idf END AS idf FROM raw_idf r JOIN means m ON m.book_id = r.book_id),
asked AS (SELECT book_id, qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM queries),
counted AS (SELECT book_id, qid, term, count(*) AS qtf FROM asked GROUP BY ALL),
scored AS (
  SELECT c.book_id, c.qid, p.seq, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM counted c JOIN weights w ON w.book_id = c.book_id AND w.term = c.term JOIN postings p ON p.book_id = c.book_id AND p.term = c.term JOIN sizes s ON s.book_id = c.book_id GROUP BY ALL),
every AS (SELECT q.book_id, q.qid, s.seq, s.docid, round(coalesce(x.score, 0), 9) AS score FROM queries q JOIN sections s ON s.book_id = q.book_id LEFT JOIN scored x ON x.book_id = q.book_id AND x.qid = q.qid AND x.seq = s.seq),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id, qid ORDER BY score DESC, seq) AS INTEGER) AS rank FROM every),
top AS (SELECT book_id, qid, rank, seq, docid, round(score, 6) AS score FROM ranked WHERE rank <= 3)"""


@query(f"WITH {BM25} SELECT * FROM top")
def bm25_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.search(sections(spark, sf_dir), benchmark_queries(spark, sf_dir), 3, bm25.index_text(sections(spark, sf_dir)))
    return found.withColumn("score", F.round("score", 6))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """seq, item_id: docs (seq, text) that hold an item's part word for word.

    A text that holds the part holds its inner words; runs of five of them meet by an equi-join, ids only, and what meets is compared. Only parts of
    fewer than seven words are held against every text."""
    split = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    parts = items.withColumn("_w", split(F.col("part"))).withColumn("_key", F.when(F.size("_w") >= 7, F.xxhash64(F.array_join(F.slice("_w", 2, 5), " "))))
    run = F.transform(F.sequence(F.lit(1), F.size("_w") - 4), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, 5), " ")))
    runs = docs.withColumn("_w", split(F.col("text"))).filter(F.size("_w") >= 5).select("seq", F.explode(F.array_distinct(run)).alias("_key"))
    met = runs.join(parts.filter("_key is not null").select("_key", "item_id", "part"), "_key").select("seq", "item_id", "part").distinct()
    long = met.join(docs, "seq").filter(F.contains("text", "part")).select("seq", "item_id")
    short = parts.filter("_key is null").select("item_id", "part").join(docs, F.contains("text", "part")).select("seq", "item_id")
    return long.unionByName(short)


@query(f"""WITH {BM25}, holders AS (SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
gold AS (SELECT s.book_id, CAST(item_id AS VARCHAR) AS qid, s.docid FROM holders h JOIN sections s ON s.seq = h.doc_id),
hits AS (SELECT g.book_id, g.qid, min(t.rank) AS rank FROM gold g LEFT JOIN top t ON t.book_id = g.book_id AND t.qid = g.qid AND t.docid = g.docid GROUP BY 1, 2)
SELECT count(*) AS n_queries, round(100 * avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 2) AS r1, round(100 * avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 2) AS r3,
  round(100 * avg(CASE rank WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1 / log2(3::DOUBLE) WHEN 3 THEN 0.5 ELSE 0 END), 2) AS ndcg3, count(*) AS answered FROM hits""")
def bm25_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's gold is the first document that holds it word for word; ranked among its own book."""
    rows, items = sections(spark, sf_dir), table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    holders = containing(docs, items.select("item_id", F.col("text").alias("part"))).groupBy("item_id").agg(F.min("seq").alias("seq"))
    gold = holders.join(rows.select("seq", "book_id", "docid"), "seq").select("book_id", F.col("item_id").cast("string").alias("qid"), "docid")
    runs = bm25.run(rows, benchmark_queries(spark, sf_dir), 3, bm25.index_text(rows))
    return metrics.evaluate(runs, gold, [])


TRIE = """seqs AS (SELECT DISTINCT 'b' || (p_size % 5) AS book_id, list_transform(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda w: length(w)) AS toks FROM part),
cuts AS (SELECT DISTINCT book_id, toks[1:k] AS prefix FROM seqs, (SELECT unnest(range(0, 4)) AS k)),
asked AS (SELECT * FROM cuts UNION SELECT DISTINCT book_id, list_append(prefix, 99) FROM cuts)"""


def _trie(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    toks = F.transform(words(F.concat_ws(" ", "p_name", "p_type")), lambda w: F.length(w))
    seqs = table(spark, sf_dir, "part").select(F.concat(F.lit("b"), (F.col("p_size") % 5).cast("string")).alias("book_id"), toks.alias("toks")).distinct()
    cuts = seqs.select("book_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("toks", F.lit(1), k))).alias("prefix")).distinct()
    return seqs, cuts.union(cuts.select("book_id", F.concat("prefix", F.array(F.lit(99))))).distinct()


@query(f"""WITH {TRIE}, steps AS (SELECT DISTINCT book_id, toks[1:k] AS prefix, toks[k + 1] AS nxt FROM seqs, (SELECT unnest(range(0, 40)) AS k) WHERE k < len(toks)),
found AS (SELECT a.book_id, a.prefix, string_agg(CAST(nxt AS VARCHAR), ',' ORDER BY nxt) AS nexts FROM asked a LEFT JOIN steps s ON s.book_id = a.book_id AND s.prefix = a.prefix GROUP BY 1, 2)
SELECT book_id, array_to_string(prefix, ',') AS prefix, coalesce(nexts, '') AS nexts FROM found""")
def trie_next_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return trie.next_tokens(*_trie(spark, sf_dir)).select("book_id", join("prefix").alias("prefix"), join("nexts").alias("nexts"))


@query(f"WITH {TRIE} SELECT a.book_id, array_to_string(a.prefix, ',') AS prefix, EXISTS (SELECT 1 FROM seqs s WHERE s.book_id = a.book_id AND s.toks = a.prefix) AS is_complete FROM asked a")
def trie_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return trie.complete(*_trie(spark, sf_dir)).select("book_id", join("prefix").alias("prefix"), "is_complete")


@query(f"WITH {TRIE} SELECT book_id, count(DISTINCT toks) AS n FROM seqs GROUP BY 1")
def trie_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.size(_trie(spark, sf_dir)[0])


METRICS = """count(*) AS n_queries, round(100 * avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 2) AS r1, round(100 * avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 2) AS r3,
  round(100 * avg(CASE rank WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1 / log2(3::DOUBLE) WHEN 3 THEN 0.5 ELSE 0 END), 2) AS ndcg3, count(*) FILTER (WHERE answered) AS answered"""
HALLUCINATED = "round(100.0::DOUBLE * count(*) FILTER (WHERE answered AND NOT top_valid) / greatest(1, count(*) FILTER (WHERE answered)), 4) AS hallucination_rate"


def _by_system(spark: SparkSession, sf_dir: str, by: list[str], with_valid: bool = True) -> DataFrame:
    predictions, gold, valid = rankings(spark, sf_dir, held=True)
    return metrics.evaluate(predictions, gold, by, valid if with_valid else None, SYSTEMS)


@query(f"WITH {RANKINGS} SELECT system, {METRICS} FROM judged GROUP BY 1")
def recall_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_system(spark, sf_dir, ["system"], False)


@query(f"WITH {RANKINGS} SELECT system, book_id, {METRICS}, {HALLUCINATED} FROM judged GROUP BY 1, 2")
def hallucination_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_system(spark, sf_dir, ["system", "book_id"])


@query(f"WITH {RANKINGS}, per_book AS (SELECT system, book_id, {METRICS}, {HALLUCINATED} FROM judged GROUP BY 1, 2) SELECT system, round(avg(r1), 2) AS macro_r1, round(avg(r3), 2) AS macro_r3, round(avg(ndcg3), 2) AS macro_ndcg3 FROM per_book GROUP BY 1")
def macro_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro(_by_system(spark, sf_dir, ["system", "book_id"]), ["r1", "r3", "ndcg3"], ["system"])


ORPHANS = """questions AS (SELECT 'b' || (o_custkey % 7) AS book_id, o_custkey AS leaf_id FROM orders),
leaves AS (SELECT DISTINCT 'b' || (c_custkey % 7) AS book_id, c_custkey AS leaf_id FROM customer WHERE c_acctbal > 1000),
counted AS (SELECT q.book_id, count(*) FILTER (WHERE l.leaf_id IS NULL) AS orphans, count(*) AS total FROM questions q LEFT JOIN leaves l ON l.book_id = q.book_id AND l.leaf_id = q.leaf_id GROUP BY 1)"""


def _questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    book = lambda c: F.concat(F.lit("b"), (F.col(c) % 7).cast("string")).alias("book_id")
    leaves = table(spark, sf_dir, "customer").filter("c_acctbal > 1000").select(book("c_custkey"), F.col("c_custkey").alias("leaf_id"))
    return table(spark, sf_dir, "orders").select(book("o_custkey"), F.col("o_custkey").alias("leaf_id")), leaves


@query(f"WITH {ORPHANS} SELECT * FROM counted")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.orphans(*_questions(spark, sf_dir))


@query(f"WITH {RANKINGS}, per_book AS (SELECT system, book_id, {METRICS} FROM judged GROUP BY 1, 2) SELECT system, book_id, round(r1 * n_queries / (n_queries + 17), 2) AS r1_all, round(r3 * n_queries / (n_queries + 17), 2) AS r3_all, round(ndcg3 * n_queries / (n_queries + 17), 2) AS ndcg3_all FROM per_book")
def metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over 17 more published queries than have a section."""
    found = materialize(_by_system(spark, sf_dir, ["system", "book_id"], False), "metrics")
    return metrics.over_published(found, found.select("system", "book_id", (F.col("n_queries") + 17).alias("published")), ["system", "book_id"])


SCORES = f"""{RANKINGS}, scores AS (SELECT system, sys_seq, book_id || ':' || qid AS qid, CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM judged),
paired AS (SELECT a.system AS a, b.system AS b, a.qid, a.score AS sa, b.score AS sb FROM scores a JOIN scores b ON a.qid = b.qid AND a.sys_seq < b.sys_seq),
summed AS (SELECT a, b, count(*) AS n_queries, round(100 * avg(sa), 2) AS mean_a, round(100 * avg(sb), 2) AS mean_b, round(100 * avg(sa - sb), 2) AS observed_diff, count(*) FILTER (WHERE sa <> sb) AS n_discordant, sum(sa - sb) AS net FROM paired GROUP BY 1, 2)"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, gold, _ = rankings(spark, sf_dir, held=True)
    return significance.pairs(metrics.per_query(predictions, gold, ["system", "sys_seq", "book_id", "qid"], systems=SYSTEMS), ["book_id", "qid"])


@query(f"WITH {SCORES} SELECT * FROM summed")
def pairwise_discordant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significance.summary(_paired(spark, sf_dir))


EXACT = f"""{SCORES}, tails AS (SELECT a, b, n_discordant AS m, abs(net) AS d, unnest(range(0, n_discordant + 1)) AS k FROM summed),
summed_p AS (SELECT a, b, CASE WHEN max(m) = 0 THEN 1.0::DOUBLE ELSE least(1.0, sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) - m * ln(2::DOUBLE))) FILTER (WHERE abs(2 * k - m) >= d)) END AS p FROM tails GROUP BY 1, 2)"""


@query(f"WITH {EXACT} SELECT s.*, round(p, 6) AS p_value, p < 0.05 AS significant FROM summed s JOIN summed_p USING (a, b)")
def exact_permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significance.exact(_paired(spark, sf_dir))


@query(f"""WITH {SCORES}, drawn AS (
  SELECT a, b, sa - sb AS d, block, CAST('0x' || substr(md5('42:' || block || ':' || qid), 1, 15) AS BIGINT) AS h FROM paired, (SELECT unnest(range(0, 167)) AS block) WHERE sa <> sb),
totals AS (SELECT a, b, block, {", ".join(f"sum(CASE WHEN (h >> {j}) & 1 = 1 THEN d ELSE -d END) AS t{j}" for j in range(60))} FROM drawn GROUP BY 1, 2, 3),
counted AS (SELECT t.a, t.b, sum({" + ".join(f"CASE WHEN block * 60 + {j} < 10000 AND abs(t{j}) >= abs(net) - 1e-9 THEN 1 ELSE 0 END" for j in range(60))}) AS hits FROM totals t JOIN summed s ON s.a = t.a AND s.b = t.b GROUP BY 1, 2)
SELECT s.*, round(coalesce((hits + 1) / 10001.0::DOUBLE, 1.0), 4) AS p_value, coalesce((hits + 1) / 10001.0::DOUBLE, 1.0) < 0.05 AS significant FROM summed s LEFT JOIN counted c ON c.a = s.a AND c.b = s.b""")
def monte_carlo_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significance.monte_carlo(_paired(spark, sf_dir))


@query()
def seeded_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significance.seeded(_paired(spark, sf_dir))


@query(f"""WITH {EXACT} SELECT a, b, rpad(a || ' vs ' || b, 26, ' ') || lpad(printf('%+.2f', observed_diff), 9, ' ') || lpad(printf('%.4f', round(p, 6)), 9, ' ') || '  ' ||
  CASE WHEN p < 0.05 THEN 'SIGNIFICANT' ELSE 'not significant — consistent with noise' END AS line FROM summed s JOIN summed_p USING (a, b)""")
def comparison_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.comparison_lines(significance.exact(_paired(spark, sf_dir)))


@query(f"""WITH {EXACT}, shown AS (SELECT a, b, rpad(a || ' vs ' || b, 26, ' ') || lpad(printf('%+.2f', observed_diff), 9, ' ') || lpad(printf('%.4f', round(p, 6)), 9, ' ') || '  ' ||
  CASE WHEN p < 0.05 THEN 'SIGNIFICANT' ELSE 'not significant — consistent with noise' END AS line FROM summed s JOIN summed_p USING (a, b))
SELECT CAST(row_number() OVER (ORDER BY a, b) + 1 AS INTEGER) AS at, line FROM shown
UNION ALL SELECT 0, rpad('comparison', 26, ' ') || lpad('diff', 9, ' ') || lpad('p', 9, ' ') || '  verdict' UNION ALL SELECT 1, repeat('-', 62)""")
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.comparison_report(significance.exact(_paired(spark, sf_dir)))


@query()
def constrained_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beam search over titles' word lengths with a scorer that prefers tokens near the query's words' lengths."""
    rows = sections(spark, sf_dir)
    seqs = rows.select("book_id", "docid", F.transform(words(F.col("docid")), lambda w: F.length(w)).alias("toks")).filter(F.size("toks") > 0)
    return trie.beam_search(seqs, benchmark_queries(spark, sf_dir), near_lengths, 3)


def near_lengths(text: str, prefix: tuple[int, ...], nexts: list[int]) -> list[float]:
    own = [len(w) for w in text.split()] or [0]
    return [-abs(own[len(prefix) % len(own)] - t) for t in nexts]


@query(f"WITH {ORPHANS} SELECT sum(orphans) AS orphans, sum(total) AS total, round(100.0::DOUBLE * sum(orphans) / sum(total), 2) AS orphan_pct FROM counted")
def orphan_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.orphan_rates(metrics.orphans(*_questions(spark, sf_dir)))


@query(f"""WITH {RANKINGS}, asked AS (SELECT DISTINCT qid FROM gold WHERE CAST(qid AS BIGINT) % 4 <> 0),
old AS (SELECT DISTINCT system, qid FROM predictions WHERE sys_seq < 2 OR CAST(qid AS BIGINT) % 2 = 0), n AS (SELECT count(*) AS n_queries FROM asked)
SELECT system, count(*) AS n_shared, max(n_queries) AS n_queries FROM old JOIN asked USING (qid), n GROUP BY 1 HAVING count(*) >= 0.8 * max(n_queries)""")
def shared_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, gold, _ = rankings(spark, sf_dir)
    old = predictions.filter("sys_seq < 2 OR cast(qid as long) % 2 = 0").select("system", "qid")
    return metrics.shared_coverage(gold.filter("cast(qid as long) % 4 <> 0").select("qid"), old)


@query(f"""WITH {RANKINGS}, pairs AS (SELECT g.book_id, g.qid FROM gold g WHERE CAST(g.qid AS BIGINT) % 3 = 0)
SELECT count(*) AS n_queries, count(*) FILTER (WHERE qid IN (SELECT qid FROM predictions)) AS n_answered FROM pairs""")
def split_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold restricted to a split, and how many of it have predictions."""
    predictions, gold, _ = rankings(spark, sf_dir)
    kept = gold.join(gold.filter("cast(qid as long) % 3 = 0").select("qid"), "qid", "left_semi")
    answered = predictions.select("qid", F.lit(True).alias("a")).distinct()
    return kept.join(answered, "qid", "left").agg(F.count("*").alias("n_queries"), F.count("a").alias("n_answered"))


@query(f"""WITH {RANKINGS}, hits AS (SELECT system, sys_seq, book_id || ':' || qid AS qid, CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM judged)
SELECT a.system AS a, b.system AS b, 3 AS k, count(*) AS n_queries, count(*) FILTER (WHERE a.score <> b.score) AS n_discordant, round(100 * avg(a.score - b.score), 2) AS observed_diff
FROM hits a JOIN hits b ON a.qid = b.qid AND a.sys_seq < b.sys_seq GROUP BY 1, 2""")
def compare_systems_at_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, gold, _ = rankings(spark, sf_dir)
    return metrics.compare(predictions, gold, 3, SYSTEMS).select("a", "b", "k", "n_queries", "n_discordant", "observed_diff")
