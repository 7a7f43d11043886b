"""Quality classifier (operator 2): a generalised additive model with pairwise interactions.

Features of a whole text (counts and shares; no id, label, language or source) are binned by quantiles. Cyclic
boosting visits one feature after the other, in each round, with a shallow tree of at most three leaves on the log
loss's gradients, and adds the leaves to that feature's lookup table. The pairs with the largest gain on what is left
are then boosted in the same way with trees of one cut on either feature, into two-way tables. A score is the
logistic of the intercept and the tables' entries: vectorised lookups and additions.

Learning uses a bounded sample of the labelled rows (`most_rows`, a hash of the id decides; about that many); features
are computed for all rows. Null texts count as empty. Null labels are not learnt from; of several labels of one id the largest counts.
Without labels of both kinds every score is the share of label 1, to a thousandth (0.5 without any). Null ids are held out; ids are never
an input. Repeated rows give repeated rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import lean, utf8
from quire.session import materialize

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "spaces", "symbols", "exclaims", "stops", "newlines", "distinct_words",
    "distinct_lines", "line_bytes", "short_words", "other_bytes", "distinct_pairs", "entropy", "longest_word",
)


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


CLASSES = [_class(x) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\v\f", b"#$%&*@^~|<>=+_\\{}[]/", b"!?", b".,;:", b"\n", bytes(range(128, 256)), b"abcdefghijklmnopqrstuvwxyz")]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    whole = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        counts = np.bincount(data[a:b], minlength=256)
        size = b - a
        upper, digits, spaces, symbols, exclaims, stops, newlines, other, lower = (counts[c].sum() / size for c in CLASSES)
        text = whole[a:b].lower()
        words, lines = text.split(), text.split(b"\n")
        m = len(words)
        lengths = [len(w) for w in words] or [0]
        share = counts[counts > 0] / size
        out[i] = (
            np.log1p(size), np.log1p(m), sum(lengths) / max(m, 1), upper / max(upper + lower, 1e-9), digits, spaces, symbols, exclaims, stops, newlines, len(set(words)) / max(m, 1),
            len(set(lines)) / len(lines), np.log1p(size / len(lines)), sum(x <= 3 for x in lengths) / max(m, 1), other, len(set(zip(words, words[1:], strict=False))) / max(m - 1, 1), -(share * np.log2(share)).sum(), np.log1p(max(lengths)),
        )
    return out


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for k in {k for p in self.pairs for k in p}}
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g, h, reg: float):
    return g / (h + reg)


def _tree(g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
    """Values for each bin of a tree of at most three leaves: the best cut, then the best second cut on either side."""

    def cut(lo: int, hi: int) -> tuple[float, int]:
        cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if hi - lo < 2:
            return 0.0, hi
        gain = cg[:-1] ** 2 / (ch[:-1] + reg) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + reg) - cg[-1] ** 2 / (ch[-1] + reg)
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    n = len(g)
    _, first = cut(0, n)
    left, right = cut(0, first), cut(first, n)
    second = left if left[0] >= right[0] else right
    bounds = sorted({0, first, second[1], n})
    out = np.zeros(n)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum(), reg)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on either side of a two-way histogram."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    p, q = g.shape
    if p < 2 or q < 2:
        return 0.0, np.zeros_like(g)
    corner = lambda c, a, b: (c[1:p, 1:q], c[1:p, q:] - c[1:p, 1:q], c[p:, 1:q] - c[1:p, 1:q], c[p, q] - c[1:p, q:] - c[p:, 1:q] + c[1:p, 1:q])
    gs, hs = corner(cg, p, q), corner(ch, p, q)
    gain = sum(x**2 / (y + reg) for x, y in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, q)), (slice(i + 1, p), slice(0, j + 1)), (slice(i + 1, p), slice(j + 1, q)))):
        out[rows, cols] = _leaf(gs[k][i, j], hs[k][i, j], reg)
    return float(gain[i, j] - cg[p, q] ** 2 / (ch[p, q] + reg)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, pair_bins: int = 12, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1, reg: float = 4.0) -> AdditiveModel:
    """Cyclic boosting on the log loss; deterministic."""
    n, d = x.shape
    share = float(y.mean()) if n else 0.5
    intercept = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    quantiles = lambda k, m: np.unique(np.quantile(x[:, k], np.linspace(0, 1, m + 1)[1:-1])) if n else np.zeros(0)
    edges, coarse = [quantiles(k, bins) for k in range(d)], [quantiles(k, pair_bins) for k in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not 0 < share < 1:
        return AdditiveModel(intercept, edges, tables, [], coarse, [])
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    total = np.full(n, intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(d):
            g, h = slopes()
            m = len(tables[k])
            step = rate * _tree(np.bincount(at[k], g, m), np.bincount(at[k], h, m), reg)
            tables[k] += step
            total += step[at[k]]
    cat = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]

    def two_way(i, j, g, h):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        flat = cat[i] * shape[1] + cat[j]
        return flat, np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(d), 2), key=lambda p: -_quadrants(*two_way(*p, g, h)[1:], reg)[0])
    chosen = ranked[:pairs]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(chosen):
            g, h = slopes()
            flat, hg, hh = two_way(i, j, g, h)
            step = rate * _quadrants(hg, hh, reg)[1]
            pair_tables[k] += step
            total += step.ravel()[flat]
    return AdditiveModel(intercept, edges, tables, chosen, coarse, pair_tables)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, f array<double> of every whole text. One pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            x = features(*utf8(b.column(1)))
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), f], names=["id", "f"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, f array<double>").withColumnRenamed("id", id_col)


def remainder(id_col: str, by: int):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(by))


def fit_on(table: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", folds: int = 5, held: int = 0, most_rows: int = 40_000) -> AdditiveModel:
    """A model from the labelled rows outside the held fold; about `most_rows` of them, chosen by a hash of the id."""
    own = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_y")).filter(remainder("_id", folds) != held)
    count = own.count()
    if count > most_rows:
        own = own.filter(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30)) < int(most_rows / count * (1 << 30)))
    got = table.join(own, F.col(id_col) == F.col("_id")).select("_id", "f", "_y").toArrow()
    y = got.column("_y").to_numpy()
    x = got.column("f").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, got.column("_id").to_numpy()))
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0, most_rows: int = 40_000) -> DataFrame:
    """id, held_out, score, predicted of every whole text."""
    table = materialize(feature_table(docs, id_col, text_col), "quality-features")
    model = fit_on(table, labels, label_col, id_col, folds, held, most_rows)

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["id", "score"])

    kind = table.schema[id_col].dataType.simpleString()
    scored = table.select(F.col(id_col).alias("id"), "f").mapInArrow(lean(run), f"id {kind}, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, (remainder(id_col, folds) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
