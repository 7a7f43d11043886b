"""Language identification (operator 1): Bayesian evidence fusion.

Evidence for a row's language: its whole text (a naive Bayes model over hashed byte trigrams), its declared markup
language, its address suffix, and a prior for its host. The text model is trained on a bounded sample of rows with a
label (`per_language` for each language that occurs, chosen by a hash of the id; more than `most_languages` are an error). What the text alone says
about all rows is then summed by declared language, suffix, host and domain in one grouped aggregation; from it come
P(declared | language), P(suffix | language) and the host priors, smoothed along global -> domain -> host, for every value
that occurs. Values of 1 / `most_hosts` of all rows or more (so at most `most_hosts` of a kind) are sent to all tasks; rarer
ones are joined to the rows that hold them by a shuffle of row numbers, without the texts. A last step fuses: log posterior =
prior + trigrams * dependence + declared + suffix.

A further hypothesis, "und", has equal trigrams. A row is rejected if "und" wins or the winner's posterior is below
`least_posterior`; texts without a trigram of letters (null and empty ones too) are judged by the rest of the evidence.
Missing evidence (null) says nothing. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import lean, utf8
from quire.session import materialize

BUCKETS = 1 << 16
#: ASCII letters in lower case, bytes of other characters as they are, anything else a space.
_FOLD = np.array([c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram at each byte, and whether it counts: within one text, and not of two spaces or more."""
    b = _FOLD[data].astype(np.uint32)
    b = np.concatenate([b, np.full(2, 32, np.uint32)])
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    counts = (b[:-2] == 32).astype(np.uint8) + (b[1:-1] == 32) + (b[2:] == 32) < 2
    for back in (1, 2):
        ends = offsets[1:] - back
        counts[ends[(ends >= 0) & (ends < len(counts))]] = False
    return ((code * np.uint32(2654435761)) >> 16).astype(np.uint16), counts


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # (languages + 1, BUCKETS) log probabilities; the last is "und"

    def loglik(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood (rows, hypotheses) of each whole text, and the number of its trigrams."""
        n = len(offsets) - 1
        out, number = np.zeros((n, len(self.table))), np.zeros(n, np.int64)
        step = 1 << 20  # bytes at a time, cut within texts too
        for lo in range(0, len(data), step):
            hi = min(len(data), lo + step)
            wide = data[lo : min(len(data), hi + 2)]
            first, last = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
            own = np.clip(offsets[first : last + 1] - lo, 0, None)
            bucket, counts = trigrams(wide, own)
            bucket, counts = bucket[: hi - lo], counts[: hi - lo]
            starts, rows = np.clip(own[:-1], 0, hi - lo), np.arange(first, last)
            keep = (np.diff(np.minimum(own, hi - lo)) > 0) & (starts < hi - lo)
            starts, rows = starts[keep], rows[keep]
            if len(starts):
                number[rows] += np.add.reduceat(counts.astype(np.int64), starts)
                for k, t in enumerate(self.table):
                    out[rows, k] += np.add.reduceat(np.where(counts, t[bucket], 0), starts)
        return out, number


def train_text_model(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = 1500, most_languages: int = 512, smoothing: float = 0.5) -> TextModel:
    """From about `per_language` labelled rows of each language that occurs; ValueError if there are more than `most_languages` (a table's memory is 256 KB each)."""
    counts = docs.filter(F.col(label_col).isNotNull()).groupBy(label_col).count().limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages in {label_col}; none is left out, raise most_languages")
    languages = sorted(r[0] for r in counts)
    if not languages:
        return TextModel([], np.full((1, BUCKETS), -np.log(BUCKETS), np.float32))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, per_language / r[1]))])
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.filter(hashed < share[F.col(label_col)]).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            data, offsets = utf8(b.column(1))
            bucket, counted = trigrams(data, offsets)
            for k, label in enumerate(b.column(0).to_pylist()):
                a, z = offsets[k], offsets[k + 1]
                if z - a > 2:
                    sums[label] = sums.get(label, 0) + np.bincount(bucket[a:z][counted[a:z]], minlength=BUCKETS)
        for label, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["label", "bucket", "n"])

    got = sample.mapInArrow(lean(count), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    table = np.full((len(languages) + 1, BUCKETS), smoothing)
    rows = np.searchsorted(np.array(languages), np.array(got.column("label").to_pylist(), dtype=str)) if len(got) else np.zeros(0, np.int64)
    table[rows, got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    table[-1] = 1
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


KINDS = ("declared", "suffix", "domain", "host")


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _rows(docs: DataFrame, text: Column, declared: Column, suffix: Column, domain: Column, host: Column, *more: Column) -> DataFrame:
    low = lambda c: F.lower(c.cast("string"))
    return docs.select(text.alias("_text"), low(declared).alias("_declared"), low(suffix).alias("_suffix"), low(domain).alias("_domain"), low(host).alias("_host"), *more)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def score_rows(rows: DataFrame, model: TextModel) -> DataFrame:
    """_rows() with the text's log likelihoods (ll) in place of the text. The one pass over the texts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    fields = rows.schema.fields[1:]

    def run(batches):
        for b in batches:
            ll, _ = shared.value.loglik(*utf8(b.column(0)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], _lists(ll)], names=[*(f.name for f in fields), "ll"])

    return rows.mapInArrow(lean(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ll array<double>"]))


def gather_evidence(scored: DataFrame, width: int, dependence: float) -> DataFrame:
    """kind, value, parent (a host's domain), p, n: sums of the text's posteriors by declared language, suffix, domain and host; summed inside tasks first."""

    def run(batches):
        sums: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(width))
        parent: dict[str, str] = {}

        def out():
            keys = list(sums)
            p = np.array([sums[k] for k in keys]).reshape(-1, width)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.string()), pa.array([parent.get(v) if k == "host" else None for k, v in keys], pa.string()), _lists(p)], names=["kind", "value", "parent", "p"])

        for b in batches:
            p = softmax(_vectors(b.column(4), width) * dependence) if b.num_rows else np.zeros((0, width))
            sums["all", ""] += p.sum(axis=0)
            for kind, column in zip(KINDS, b.columns[:4], strict=True):
                codes = column.dictionary_encode()
                at = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
                found = np.stack([np.bincount(at, p[:, k], len(codes.dictionary) + 1) for k in range(width)], axis=1)
                for j, value in enumerate(codes.dictionary.to_pylist()):
                    if value is not None:
                        sums[kind, value] += found[j]
            for h, d in set(zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if h is not None and d is not None:
                    parent[h] = d
            if len(sums) > 50_000:
                yield out()
                sums.clear()
                parent.clear()
        yield out()

    each = scored.select("_declared", "_suffix", "_domain", "_host", "ll").mapInArrow(lean(run), "kind string, value string, parent string, p array<double>")
    summed = each.groupBy("kind", "value").agg(F.max("parent").alias("parent"), F.array(*[F.sum(F.col("p")[k]) for k in range(width)]).alias("p"))
    return materialize(summed.withColumn("n", F.aggregate("p", F.lit(0.0), lambda a, x: a + x)), "language-evidence")


def log_evidence(summed: DataFrame, everything: np.ndarray, smoothing: float) -> DataFrame:
    """kind, value, n, e: log P(value | language) of every declared value and suffix, the log prior of every domain and host."""
    n, width = everything.sum(), len(everything)
    prior = (everything + 1) / (n + width)
    domains = summed.filter("kind = 'domain'").select(F.col("value").alias("parent"), F.col("p").alias("above"))
    hosts = summed.filter("kind = 'host'").join(domains, "parent", "left").select("kind", "value", "n", "p", "above")
    others = summed.filter("kind not in ('all', 'host')").select("kind", "value", "n", "p", F.lit(None).cast("array<double>").alias("above"))

    def run(batches):
        smooth = lambda c, above: (c + smoothing * above) / (c.sum(axis=1, keepdims=True) + smoothing)
        for b in batches:
            if not b.num_rows:
                continue
            c = _vectors(b.column(3), width)
            above = np.stack([prior if x is None else smooth(np.array([x]), prior)[0] for x in b.column(4).to_pylist()])
            given = np.array([k in ("declared", "suffix") for k in b.column(0).to_pylist()])[:, None]
            e = np.log(np.where(given, (c + 0.5 * prior) / (everything + 0.5), smooth(c, above)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _lists(e)], names=["kind", "value", "n", "e"])

    return materialize(hosts.unionByName(others).mapInArrow(lean(run), "kind string, value string, n double, e array<double>"), "language-logs")


def identify(docs: DataFrame, model: TextModel, *, text: Column, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, domain: Column | None = None, id_col: str = "doc_id", dependence: float = 0.25, least_posterior: float = 0.5, keep: bool = False, smoothing: float = 8.0, most_hosts: int = 4096) -> DataFrame:
    """id, language, posterior, text_language, accepted for every row; with keep, the accepted rows of docs themselves, all columns.

    One pass of the text model; sums, ids and log likelihoods are written or shuffled. With keep, a second reading leaves out the
    rows whose text and evidence (by two 64-bit hashes) are those of a rejected row.
    """
    none = F.lit(None).cast("string")
    sides = [none if c is None else c for c in (declared, suffix, domain, host)]
    width = len(model.table)
    marks = [F.xxhash64(F.lit(seed), *[x for c in (text, *sides) for x in (c.isNull(), c)]).alias(f"__quire_{seed}") for seed in (1, 2)]
    names = ["__quire_1", "__quire_2"] if keep else ["id"]
    more = marks if keep else [F.col(id_col).alias("id")]
    scored = materialize(score_rows(_rows(docs, text, *sides, *more), model).withColumn("_row", F.monotonically_increasing_id()), "language-rows")
    summed = gather_evidence(scored, width, dependence)
    everything = np.array([x or 0.0 for x in summed.filter("kind = 'all'").agg(*[F.sum(F.col("p")[k]) for k in range(width)]).first()])
    n = everything.sum()
    logs = log_evidence(summed, everything, smoothing)
    # at most most_hosts rows of each kind can hold such a share of all
    often = F.col("n") >= max(n / most_hosts, 1e-9)
    hot = {(x["kind"], x["value"]): np.array(x["e"]) for x in logs.filter(often).collect()}
    rare = logs.filter(~often).select("kind", "value", "e")
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, np.log((everything + 1) / (n + width)), hot))
    if rare.limit(1).count():
        pair = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(f"_{kind}").alias("value"))
        held = F.array(pair("declared"), pair("suffix"), F.when(F.col("_host").isNotNull(), pair("host")).otherwise(pair("domain")))
        each = scored.select("_row", F.explode(held).alias("v")).select("_row", "v.kind", "v.value").filter("value is not null")
        each = each.join(F.broadcast(logs.filter(often).select("kind", "value")), ["kind", "value"], "left_anti").join(rare, ["kind", "value"])
        scored = scored.join(each.groupBy("_row").agg(F.collect_list(F.struct("kind", "e")).alias("rare")), "_row", "left")
    else:
        scored = scored.withColumn("rare", F.lit(None).cast("array<struct<kind:string,e:array<double>>>"))

    def run(batches):
        languages, prior, often = shared.value
        labels, zero = np.array([*languages, "und"], object), np.zeros(width)
        for b in batches:
            if not b.num_rows:
                continue
            ll = _vectors(b.column(4), width)
            total = ll * dependence
            for k, (d, s, dom, h, own) in enumerate(zip(*(c.to_pylist() for c in (*b.columns[:4], b.column(5))), strict=True)):
                e = {x["kind"]: np.array(x["e"]) for x in own or ()}
                above = ("host", h) if h is not None else ("domain", dom)
                total[k] += e["declared"] if "declared" in e else often.get(("declared", d), zero)
                total[k] += e["suffix"] if "suffix" in e else often.get(("suffix", s), zero)
                total[k] += e[above[0]] if above[0] in e else often.get(above, prior)
            post = softmax(total)
            best = post.argmax(axis=1)
            sure = post[np.arange(len(post)), best]
            accepted = pa.array((best < len(languages)) & (sure >= least_posterior))
            yield pa.RecordBatch.from_arrays([*b.columns[6:], pa.array(labels[best], pa.string()), pa.array(np.round(sure, 9)), pa.array(labels[ll.argmax(axis=1)], pa.string()), accepted], names=[*names, "language", "posterior", "text_language", "accepted"])

    kind = ", ".join(f"`{x}` {scored.schema[x].dataType.simpleString()}" for x in names)
    decided = scored.select("_declared", "_suffix", "_domain", "_host", "ll", "rare", *names).mapInArrow(lean(run), f"{kind}, language string, posterior double, text_language string, accepted boolean")
    if not keep:
        return decided.withColumnRenamed("id", id_col)
    gone = materialize(decided.filter("not accepted").select(*names).distinct(), "language-rejected")
    return docs.select("*", *marks).join(gone, names, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def page_columns(html: Column, url: Column) -> dict[str, Column]:
    """The evidence of a web page: its text without markup, its declared language, its address's suffix, domain and host (null where there is none)."""
    blank = lambda c: F.when(c != "", c)
    host = blank(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[a-zA-Z]+;", " ")
    return {
        "text": text,
        "declared": blank(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))),
        "suffix": blank(F.regexp_extract(host, r"\.([^.]+)$", 1)),
        "domain": blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)),
        "host": host,
    }
