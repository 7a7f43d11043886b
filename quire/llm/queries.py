"""Queries over the ten operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, imatch, language, lm_score, mixing, quality, secrets_scan, simhash, suffix_dedup, token_counts
from quire.session import ship, small_batches, table

SPECIAL = {"<|endoftext|>": 50256}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: the text, the declared language (lang) and the host (source); they have no address."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train_text_model(docs), text=F.col("text"), declared=F.col("lang"), host=F.col("source"))


def op1_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages: text, declared markup language, address suffix, and host priors smoothed through the domain; the text model is that of documents."""
    pages = table(spark, sf_dir, "pages")
    return language.identify(pages, language.train_text_model(table(spark, sf_dir, "documents")), id_col="page_id", **language.page_columns(F.col("html"), F.col("url")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: quality of every whole text, learnt from labels outside the held fold."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: I-Match fingerprints of every whole text and of its edited copy."""
    docs = table(spark, sf_dir, "documents")
    model = imatch.IMatch(imatch.lexicon(docs, docs.count()))
    return imatch.edited_fingerprints(docs, model)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents against every item of benchmark: passages within the error budget."""
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: every whole text under the model of those whose crc32(doc_id) mod 7 isn't 2."""
    return lm_score.score_texts(table(spark, sf_dir, "documents"), quality.remainder("doc_id", 7) == 2)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: fingerprint and component of every whole text."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: draws of every source's documents by the tempered weights."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: spans of secrets of every whole text, base and Markov."""
    return secrets_scan.scan_digest(table(spark, sf_dir, "documents"), secrets_scan.MarkovPair.train(secrets_scan.labelled_samples()))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: tokens of every whole text."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIAL)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: bytes of every whole text that repeat an earlier document's."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's columns that SQL can express: lengths and digests of the edited texts."""
    return op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op5_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's columns that SQL can express: the fold, the counts and the unigram base."""
    return op5_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def op8_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's columns that SQL can express: the base patterns' spans."""
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with this package on the executors, and small Arrow batches for the session (see small_batches)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: shipped(f) for f in (op1_language_id, op1_language_id_pages, op2_quality, op3_fingerprints, op4_decontaminate, op5_lm_score, op6_simhash, op7_mixing, op8_secret_scan, op9_token_counts, op10_suffix_dedup, op3_edits, op5_base, op8_base)}

#: op10: windows as strings of hexadecimal digits, so that they are bytes.
OP10_SQL = """WITH docs AS (SELECT doc_id, row_number() OVER () AS row_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT row_id, doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM (SELECT row_id, doc_id, h, unnest(range(0, n - 49)) AS p FROM docs WHERE n >= 50)),
firsts AS (SELECT *, min(doc_id) OVER (PARTITION BY w) AS first_id FROM windows),
hits AS (SELECT row_id, p FROM firsts WHERE first_id < doc_id),
marked AS (SELECT row_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY row_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new_span FROM hits),
numbered AS (SELECT row_id, p, sum(new_span) OVER (PARTITION BY row_id ORDER BY p) AS span FROM marked),
spans AS (SELECT row_id, span, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY 1, 2),
gaps AS (
  SELECT row_id, coalesce(lag(b) OVER (PARTITION BY row_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT d.row_id, coalesce(max(s.b), 0), any_value(d.n) FROM docs d LEFT JOIN spans s USING (row_id) GROUP BY 1),
kept AS (SELECT g.row_id, string_agg(substr(d.h, 2 * g.a + 1, 2 * (g.b - g.a)), '' ORDER BY g.a) AS k FROM gaps g JOIN docs d USING (row_id) GROUP BY 1),
counted AS (SELECT row_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(k.k)) AS kept_sha256
FROM docs d JOIN kept k USING (row_id) LEFT JOIN counted c USING (row_id)"""

#: op7: the exponent by bisection, then the same hashes, quotas, blocks and orders.
OP7_SQL = """WITH RECURSIVE trimmed AS (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '[\\x09-\\x0D]', ' ', 'g')) AS x FROM documents),
counted AS (SELECT doc_id, source, coalesce('s' || source, '') AS key, CAST(CASE WHEN x = '' THEN 0 ELSE len(regexp_split_to_array(x, ' +')) END AS BIGINT) AS n FROM trimmed),
totals AS (SELECT key, CAST(sum(n) AS BIGINT) AS t FROM counted GROUP BY 1),
whole AS (SELECT greatest(1, sum(t)) AS w FROM totals),
shares AS (SELECT key, t / CAST(w AS DOUBLE) AS p FROM totals, whole WHERE t > 0),
goal AS (SELECT 0.95::DOUBLE * ln(count(*)) AS target, count(*) AS c FROM shares),
flat(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT i, lo, hi, (SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM shares) >= (SELECT target FROM goal) AS ok FROM flat WHERE i < 40)),
rare(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT i, lo, hi, (SELECT max(pow(p, (lo + hi) / 2 - 1)) / sum(pow(p, (lo + hi) / 2)) FROM shares) > 4 AS ok FROM rare WHERE i < 40)),
warm AS (SELECT CASE WHEN (SELECT c FROM goal) < 2 OR (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) FROM shares) >= (SELECT target FROM goal) THEN 1.0::DOUBLE ELSE (SELECT lo FROM flat WHERE i = 40) END AS a),
chosen AS (SELECT CASE WHEN (SELECT c FROM goal) < 2 OR (SELECT max(pow(p, a - 1)) / sum(pow(p, a)) FROM shares) <= 4 THEN a ELSE least(1.0, (SELECT lo FROM rare WHERE i = 40) + pow(2.0, -40)) END AS alpha FROM warm),
norm AS (SELECT coalesce(sum(pow(p, alpha)), 1.0) AS z FROM shares, chosen),
weighted AS (SELECT key, t, w, CASE WHEN t > 0 THEN pow(t / CAST(w AS DOUBLE), alpha) / z ELSE 0.0 END AS weight FROM totals, whole, chosen, norm),
quotas AS (SELECT *, CAST(floor(weight * w + 1e-6) AS BIGINT) AS q, least(65536, greatest(1, CAST(ceil(t / 65536.0::DOUBLE) AS BIGINT))) AS nb FROM weighted),
plan AS (SELECT *, CASE WHEN t > 0 THEN q // t ELSE 0 END AS whole_epochs FROM quotas),
placed AS (SELECT c.*, CAST(CAST('0x' || substr(md5(concat_ws(':', '17', c.key, coalesce(CAST(doc_id AS VARCHAR), '-'))), 1, 8) AS BIGINT) % nb AS INTEGER) AS block FROM counted c JOIN plan p ON p.key = c.key),
blocks AS (SELECT key, block, sum(n) AS bt FROM placed GROUP BY 1, 2),
dealt AS (SELECT b.key, b.block, b.bt, p.*  EXCLUDE (key), CAST(unnest(range(0, whole_epochs + 1)) AS INTEGER) AS epoch FROM blocks b JOIN plan p ON p.key = b.key),
started AS (SELECT *, coalesce(sum(bt) OVER (PARTITION BY key, epoch ORDER BY CAST('0x' || substr(md5(concat_ws(':', '17', key, CAST(epoch AS VARCHAR), CAST(block AS VARCHAR))), 1, 8) AS BIGINT), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM dealt),
stood AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY key, block ORDER BY CAST('0x' || substr(md5(concat_ws(':', '17', 'doc', coalesce(CAST(doc_id AS VARCHAR), '-'))), 1, 8) AS BIGINT), doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)
SELECT d.doc_id, d.source, d.n AS n_tokens, round(s.weight, 9) AS weight, s.epoch, d.block, round(CASE WHEN q > 0 THEN (s.epoch * s.t + start + before) / CAST(q AS DOUBLE) ELSE 0.0 END, 9) AS at
FROM stood d JOIN started s ON s.key = d.key AND s.block = d.block WHERE s.epoch < whole_epochs OR start + before + d.n <= q - whole_epochs * t"""

OP3_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
n AS (SELECT doc_id, x, length(x) AS n, coalesce(lead(x) OVER (ORDER BY doc_id DESC), first_value(x) OVER (ORDER BY doc_id DESC)) AS y FROM t)
SELECT doc_id, n AS n_chars, sha256(substr(x, 1, n - n // 3) || substr(y, 1, n // 3)) AS edited_sha256 FROM n"""

#: The remainder of crc32(doc_id) by bits: the digits' codes, then eight shifts for each.
FOLD = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

OP5_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce({FOLD} % 7 = 2, false) AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '') AS toks FROM documents),
each AS (SELECT row_id, held_out, unnest(toks) AS w FROM docs),
counts AS (SELECT w, count(*) AS c FROM each WHERE NOT held_out GROUP BY 1),
totals AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM counts),
scored AS (SELECT row_id, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1.0::DOUBLE) / (n + v + 1))) AS base FROM each LEFT JOIN counts USING (w), totals GROUP BY 1)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, round(base, 4) AS base_score FROM docs JOIN scored USING (row_id), totals"""

_ASSIGN = """(?i:password|passwd|secret|token|api_?key)[\\x22\\x27]?\\x20*[:=]\\x20*[\\x22\\x27]?([A-Za-z0-9+/_.=-]+)"""
#: Matches are marked in the text by two characters, and their places summed up from the pieces between.
OP8_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS x FROM documents),
kinds AS (SELECT * FROM (VALUES (0, 'assign', '{_ASSIGN}'), (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+')) AS k(k, kind, p)),
pieces AS (
  SELECT row_id, 0 AS k, string_split(regexp_replace(x, '({_ASSIGN})', chr(63742) || '\\1' || chr(63743), 'g'), chr(63742)) AS ps FROM docs
  UNION ALL SELECT row_id, 1, string_split(regexp_replace(x, '(AKIA[A-Z0-9]+)', chr(63742) || '\\1' || chr(63743), 'g'), chr(63742)) FROM docs
  UNION ALL SELECT row_id, 2, string_split(regexp_replace(x, '([0-9a-f]+)', chr(63742) || '\\1' || chr(63743), 'g'), chr(63742)) FROM docs),
cut AS (SELECT row_id, k, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS piece FROM pieces),
placed AS (SELECT row_id, k, i, split_part(piece, chr(63743), 1) AS m, coalesce(sum(length(piece) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM cut),
spans AS (SELECT row_id, k, a, a + length(m) AS b FROM placed WHERE i > 1 AND CASE k WHEN 0 THEN length(regexp_extract(m, '{_ASSIGN}', 1)) >= 6 WHEN 1 THEN length(m) >= 20 ELSE length(m) >= 24 END),
told AS (SELECT row_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) AS s FROM spans JOIN kinds USING (k) GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256 FROM docs LEFT JOIN told USING (row_id)"""

#: Queries without an entry aren't expressible in SQL; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op7_mixing": OP7_SQL, "op10_suffix_dedup": OP10_SQL, "op3_edits": OP3_SQL, "op5_base": OP5_SQL, "op8_base": OP8_SQL}
