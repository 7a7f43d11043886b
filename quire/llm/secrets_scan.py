"""Secret scans (operator 8): base patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order Markov models over characters are trained from labelled samples: one from random strings (keys,
digests, tokens), one from ordinary identifiers. A run of key characters of `min_run` or more is a secret if the
log-likelihood ratio of the two models, over the whole run, exceeds `threshold` nats and `per_char` nats a character; random
letters and digits give about 1.6 nats each, so runs of fewer than `min_run` characters could seldom reach the threshold.
Otherwise its stretches are searched: maximum-sum segments of the same ratios, held to the same three values and, if they
pass, widened to whole words of letters and digits. The base patterns' spans always stay; what they leave of a run is
searched like a run.

Null and empty texts have no spans. Offsets are code points, end exclusive. Texts are scanned whole; repeated rows give
repeated rows; other columns are not read.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import batch, lean, utf8

#: The base patterns and the order of kinds.
ASSIGN = rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = rb"AKIA[A-Z0-9]+"
KINDS = ("assign", "access", "hex", "markov")
RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
HEX = b"0123456789abcdef"
#: Pieces of ordinary identifiers for the built-in samples.
PIECES = (
    "account action active address admin agent alert alias amount append archive array article asset async attach audit author backup balance batch begin "
    "binary block board body border branch bridge browser bucket buffer build button cache calendar callback cancel capture catalog category change channel "
    "chapter character check child choice claim class clean client clock close cluster code collect color column command comment common compare complete config "
    "connect console contact container content context control convert copy core count country create credit current custom data date debug decode default "
    "delete deliver depth describe design detail device dialog direct directory display distance document domain download draft drive edit element email enable "
    "encode engine entry error event example exchange execute export extension factory failure feature field file filter final finish first folder format "
    "forward frame function gateway general global graph group handle header health height helper history host identity image import index info initial input "
    "insert inside instance integer interface internal invoice item iterator journal keyboard label language large last launch layer layout leader left length "
    "level library license limit line link list listen load local location logger login lookup machine mail manager mapping margin market master match matrix "
    "maximum measure media member memory menu merge message method metric middle minimum mobile model module monitor month mount move name native network node "
    "normal notice number object offset open operator option order origin output owner package page panel parent parse part partner path pattern payment people "
    "percent period person phone picture pipeline place player plugin point policy pool position prefix price print private process product profile program "
    "project property protocol provider public query queue random range reader record region register release remote remove render repeat replace report request "
    "reset resource response result return review right role root route sample save scale schedule schema scope screen script search section select sender "
    "sequence server service session setting share shell signal simple single size source space split stack stage standard start state static station status "
    "step storage store stream string style subject submit success summary support switch symbol sync system table target task template terminal test text theme "
    "thread ticket time title tool topic total trace track transfer tree trigger type uniform unique unit update upload user utility valid value vector version "
    "video view visible volume weight widget width window worker world writer zone"
).split()
SYLLABLES = "an ar at con de der di en er es ex for ge ha he in is it la le li ma me ment na ne ni on or pa per pre pro que ra re ri ro sa se si sta ta te ter ti tion to tra un ur ver vi".split()


def labelled_samples(n: int = 6000, seed: int = 7) -> list[tuple[str, int]]:
    """Built-in labelled samples: (string, 1 if random); n of each label, the same at every size of input."""
    r = random.Random(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", digits + "abcdef", digits + "ABCDEF", upper + digits, lower + digits]
    out = [("".join(r.choices(a := r.choice(alphabets), k=r.randint(20, 64))), 1) for _ in range(n)]
    for _ in range(n):
        words = [r.choice(PIECES) if r.random() < 0.6 else "".join(r.choices(SYLLABLES, k=r.randint(2, 6))) for _ in range(r.randint(2, 6))]
        form = r.randrange(7)
        if form == 0:
            text = "_".join(words)
        elif form == 1:
            text = "-".join(words)
        elif form == 2:
            text = words[0] + "".join(x.title() for x in words[1:])
        elif form == 3:
            text = "_".join(words).upper()
        elif form == 4:
            text = "/".join(words)
        elif form == 5:
            text = "".join(words)
        else:
            text = "".join(words).upper()
        if r.random() < 0.25:
            text += r.choice(["", "_", "-"]) + str(r.randrange(10 ** r.randint(1, 4)))
        out.append((text, 0))
    return out


@dataclass
class MarkovPair:
    """log P(next | previous) under both models as one table of differences; 0 is the start and any other byte."""

    ratio: np.ndarray
    threshold: float
    per_char: float
    min_run: int = 12
    codes: np.ndarray = field(default_factory=lambda: _codes())

    @classmethod
    def train(cls, samples, smoothing: float = 0.5, threshold: float = 17.0, per_char: float = 0.6, min_run: int = 12) -> MarkovPair:
        """samples: (string, label) pairs; label 1 is random. Nulls and empty strings are left out."""
        codes, k = _codes(), len(RUN) + 1
        counts = np.full((2, k, k), smoothing)
        for text, label in samples:
            if text:
                c = codes[np.frombuffer(text.encode(), np.uint8)].astype(np.int64)
                np.add.at(counts[int(bool(label))], (np.r_[0, c[:-1]], c), 1)
        logp = np.log(counts / counts.sum(axis=2, keepdims=True))
        return cls((logp[1] - logp[0]), threshold, per_char, min_run)

    def score(self, run: bytes) -> float:
        c = self.codes[np.frombuffer(run, np.uint8)]
        return float(self.ratio[np.r_[0, c[:-1]], c].sum())

    def is_secret(self, run: bytes) -> bool:
        s = self.score(run)
        return s > self.threshold and s > self.per_char * len(run)

    def stretches(self, run: bytes) -> list[tuple[int, int]]:
        """Starts and ends of the secrets in a run: the whole of it, or its best-scoring stretches."""
        if len(run) < self.min_run:
            return []
        if self.is_secret(run):
            return [(0, len(run))]
        c = self.codes[np.frombuffer(run, np.uint8)]
        ratio = self.ratio[np.r_[0, c[:-1]], c]
        found = self._segments(ratio, 0.0) + self._segments(ratio, self.per_char)
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            while a > 0 and run[a - 1 : a].isalnum() and run[a : a + 1].isalnum():
                a -= 1
            while b < len(run) and run[b : b + 1].isalnum() and run[b - 1 : b].isalnum():
                b += 1
            if out and a < out[-1][1]:
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
        return out

    def _segments(self, ratio: np.ndarray, less: float) -> list[tuple[int, int]]:
        """Maximum-sum segments of ratio - less that pass; one ends where the sum is spent or has dropped by `threshold` from its top."""
        x = ratio - less
        sums = np.concatenate([[0.0], np.cumsum(x)])
        if (sums - np.minimum.accumulate(sums)).max() <= (self.threshold if not less else 0):
            return []
        out, at, values = [], 0, x.tolist()
        while at < len(values):
            total = top = 0.0
            start, end = at, at
            k = at
            while k < len(values):
                total += values[k]
                k += 1
                if total > top:
                    top, end = total, k
                elif total <= 0 or top - total >= self.threshold:
                    break
            if end - start >= self.min_run and (s := float(ratio[start:end].sum())) > self.threshold and s > self.per_char * (end - start):
                out.append((start, end))
            at = end if end > start else k
        return out


def _codes() -> np.ndarray:
    codes = np.zeros(256, np.int64)
    codes[np.frombuffer(RUN, np.uint8)] = np.arange(1, len(RUN) + 1)
    return codes


def _members(alphabet: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(alphabet, np.uint8)] = True
    return out


def long_runs(data: np.ndarray, offsets: np.ndarray, members: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes, at least that long, none across texts."""
    inside = members[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    stop[lasts] = inside[lasts]
    ends = np.flatnonzero(stop) + 1
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def scan_batch(data: np.ndarray, offsets: np.ndarray, model: MarkovPair) -> dict[int, list[tuple[int, int, int]]]:
    """Row -> spans (start, kind's number, end) in bytes from the text's start, sorted; rows without spans are left out."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    whole = data.tobytes()
    low = whole.lower()
    assign, access = re.compile(ASSIGN, re.IGNORECASE), re.compile(ACCESS)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if any(low.find(k, a, b) >= 0 for k in KEYWORDS):
            own = [(m.start() - a, 0, m.end() - a) for m in assign.finditer(whole, a, b) if m.end(2) - m.start(2) >= 6]
            if own:
                found.setdefault(i, []).extend(own)
        if whole.find(b"AKIA", a, b) >= 0:
            own = [(m.start() - a, 1, m.end() - a) for m in access.finditer(whole, a, b) if m.end() - m.start() >= 20]
            if own:
                found.setdefault(i, []).extend(own)
    if len(data):
        for kind, members, least in ((2, _members(HEX), 24), (3, _members(RUN), model.min_run)):
            starts, ends = long_runs(data, offsets, members, least)
            if kind == 3:
                starts, ends = _hopeful(data, offsets, starts, ends, model, found)
            rows = np.searchsorted(offsets, starts, "right") - 1
            for i, s, e in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
                a = int(offsets[i])
                if kind != 3:
                    found.setdefault(i, []).append((s - a, kind, e - a))
                    continue
                own, at = [], s
                for x, _, y in sorted(t for t in found.get(i, ()) if t[1] != 3 and t[0] < e - a and s - a < t[2]):
                    own += [(at + p, at + q) for p, q in model.stretches(whole[at : a + x])] if a + x > at else []
                    at = max(at, a + y)
                own += [(at + p, at + q) for p, q in model.stretches(whole[at:e])] if e > at else []
                if own:
                    found.setdefault(i, []).extend((p - a, kind, q - a) for p, q in own)
    for spans in found.values():
        spans.sort()
    return found


def _hopeful(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: MarkovPair, found: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs those that may hold a secret: the positive ratios of a run, summed, exceed the threshold, as every stretch's sum does; or its text has base spans."""
    if not len(starts):
        return starts, ends
    sizes = ends - starts
    passed = np.cumsum(sizes)
    gains = np.empty(len(starts))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(passed, np.arange(1 << 20, passed[-1], 1 << 20)), [len(starts)]]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # about a million bytes at a time
        own = sizes[lo:hi]
        first = np.cumsum(own) - own
        codes = model.codes[data[np.repeat(starts[lo:hi] - first, own) + np.arange(own.sum())]]
        before = np.concatenate([[0], codes[:-1]])
        before[first] = 0
        gains[lo:hi] = np.add.reduceat(np.maximum(model.ratio[before, codes], 0.0), first)
    rows = np.searchsorted(offsets, starts, "right") - 1
    keep = (gains > model.threshold - 1e-6) | np.isin(rows, np.fromiter(found, np.int64, len(found)))
    return starts[keep], ends[keep]


def code_points(text: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with code points in place of bytes."""
    at = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return [(int(at[s]), k, int(at[e])) for s, k, e in spans]


def told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, model: MarkovPair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct<kind, start, end>> of every whole text. One pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>"

    def run(batches):
        to = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            data, offsets = utf8(b.column(1))
            found = scan_batch(data, offsets, model)
            out = [[]] * b.num_rows
            for i, spans in found.items():
                out[i] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in code_points(data[offsets[i] : offsets[i + 1]], spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, to)], names=["id", "spans"])

    return rows.mapInArrow(lean(run), kind).withColumnRenamed("id", id_col)


def scan_digest(docs: DataFrame, model: MarkovPair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans (joined), n_markov: scan_secrets' spans, told as counts and digests."""
    spans = scan_secrets(docs, model, id_col, text_col)
    tell = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return spans.select(
        id_col,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(tell(F.filter("spans", lambda x: x["kind"] != "markov")), 256).alias("base_sha256"),
        tell(F.col("spans")).alias("spans"),
        count("markov").alias("n_markov"),
    )


def redact_secrets(docs: DataFrame, model: MarkovPair, text_col: str = "text", count_col: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by `mark` and count_col, if there, brought up to date. Texts without a span, nulls too, stay as they are."""
    schema = docs.schema
    i_text, i_count = docs.columns.index(text_col), docs.columns.index(count_col) if count_col in docs.columns else None

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(i_text))
            found = scan_batch(data, offsets, model)
            if found:
                texts = b.column(i_text).to_pylist()
                for i, spans in found.items():
                    own, parts, at = data[offsets[i] : offsets[i + 1]].tobytes(), [], 0
                    for s, _, e in spans:
                        if e > at:
                            parts += [own[at:s], mark.encode()] if s >= at else []
                            at = e
                    texts[i] = b"".join([*parts, own[at:]]).decode()
                columns = list(b.columns)
                columns[i_text] = pa.array(texts, b.schema.field(i_text).type)
                if i_count is not None:
                    counts = columns[i_count].to_pylist()
                    for i in found:
                        counts[i] = len(texts[i])
                    columns[i_count] = pa.array(counts, b.schema.field(i_count).type)
                b = pa.RecordBatch.from_arrays(columns, names=b.schema.names)
            yield b

    return docs.mapInArrow(lean(run), schema)


