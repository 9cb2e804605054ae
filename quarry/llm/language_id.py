"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text forwards and backwards, across words, and labels every position with a probability
for each language; a document's probabilities are the mean over all its letters. It is trained here in numpy by
backpropagation through time (Adam) on a bounded sample: of about ``MAX_DOCS`` documents a language, drawn by a hash of the id,
up to ``PER_DOC`` stretches of ``STRETCH`` bytes each, ``MAX_STRETCHES`` in all and as many for each language. Every language found
is learned; of more than 1,000 each has fewer documents in proportion, and more languages than ``MAX_STRETCHES`` are an error.

Prediction reads the whole text. So that long texts don't make long chains of steps, it is read in windows of ``WINDOW`` bytes with
``CONTEXT`` bytes on either side from which the states come in, running over words as they are; each position is labelled once. Text
that ends within a window is followed by blanks. Prediction is one Arrow pass; rows aren't shuffled, and
a text's result doesn't depend on the texts beside it (up to rounding).

Defined results: a null text or one without letters gives ``und`` and score 0; ties go to the language that sorts first;
without training rows everything is ``und`` with score 0; a null doc_id isn't held out; repeated rows get equal results; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import common
from .toxicity import held_out

MAX_DOCS, PER_DOC, MAX_STRETCHES, STRETCH = 400, 32, 12_000, 48
WINDOW, CONTEXT, STEP, HIDDEN = 512, 32, 64, 12
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of letters: ASCII ones, and all of longer code points.
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def spelled(text: str) -> np.ndarray:
    """The bytes of a text in lower case."""
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def windows(raw: np.ndarray) -> list[np.ndarray]:
    """Stretches of WINDOW bytes (the last one to the next multiple of STEP, filled up with blanks) with CONTEXT bytes on either side."""
    full = len(raw) // WINDOW
    rest = -(-(len(raw) - full * WINDOW) // STEP) * STEP
    padded = np.full(CONTEXT + full * WINDOW + rest + CONTEXT, 32, np.uint8)
    padded[CONTEXT : CONTEXT + len(raw)] = raw
    out = [padded[at * WINDOW : (at + 1) * WINDOW + 2 * CONTEXT] for at in range(full)]
    return [*out, padded[full * WINDOW :]] if rest else out


@dataclass
class Network:
    """A bidirectional GRU: per direction the gates (update, reset, candidate) of HIDDEN units."""

    langs: list[str]
    params: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, langs: list[str], seed: int = 3) -> Network:
        rng, h = np.random.default_rng(seed), HIDDEN
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h))
            p[f"u{d}"] = rng.normal(0, 0.3, (h, 3 * h))
        p["o"] = rng.normal(0, 0.3, (2 * h, len(langs)))
        p["c"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (T, n, h) of one direction over bytes (T, n), and what backpropagation needs."""
        p, h, u = self.params, HIDDEN, self.params[f"u{d}"]
        state, states, kept = np.zeros((x.shape[1], h), np.float32), np.empty((*x.shape, h), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = p[f"x{d}"][x[t]]
            zr = _sigmoid(a[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            new = state + z * (c - state)
            kept.append((t, state, z, r, c))
            state = states[t] = new
        return states, kept

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """The states of _run alone, in place."""
        h, table, u, v = HIDDEN, self.params[f"x{d}"], self.params[f"u{d}"][:, : 2 * HIDDEN].copy(), self.params[f"u{d}"][:, 2 * HIDDEN :].copy()
        n = x.shape[1]
        state, states = np.zeros((n, h), np.float32), np.empty((*x.shape, h), np.float32)
        a, zr = np.empty((n, 3 * h), np.float32), np.empty((n, 2 * h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            table.take(x[t], 0, out=a, mode="clip")
            np.matmul(state, u, out=zr)
            zr += a[:, : 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            new = states[t]
            np.matmul(zr[:, h:] * state, v, out=new)
            new += a[:, 2 * h :]
            np.tanh(new, out=new)
            new -= state
            new *= zr[:, :h]
            new += state
            state = new
        return states

    def positions(self, x: np.ndarray, edge: int = 0) -> np.ndarray:
        """Probabilities (languages, T, n) of the positions of bytes (T, n), without ``edge`` of them at either end."""
        x = x.astype(np.intp)
        inner = slice(edge, len(x) - edge)
        y = self.params["c"][:, None].astype(np.float32)
        for d, part in (("f", self.params["o"][:HIDDEN]), ("b", self.params["o"][HIDDEN:])):
            y = y + part.T @ self._states(x, d)[inner].reshape(-1, HIDDEN).T
        y -= y.max(0)
        np.exp(y, out=y)
        y /= y.sum(0)
        return y.reshape(len(y), -1, x.shape[1])

    def gradients(self, x: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        p, h = self.params, HIDDEN
        runs = {d: self._run(x, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        y = both @ p["o"] + p["c"]
        y = np.exp(y - y.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        n = x.size
        loss = -float(np.log(y[:, np.arange(x.shape[1]), target] + 1e-9).sum()) / n
        dy = y / n
        dy[:, np.arange(x.shape[1]), target] -= 1 / n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"] = both.reshape(-1, 2 * h).T @ dy.reshape(-1, dy.shape[2])
        g["c"] = dy.sum((0, 1))
        dboth = dy @ p["o"].T
        for d, part in (("f", dboth[:, :, :h]), ("b", dboth[:, :, h:])):
            u, dstate = p[f"u{d}"], np.zeros((x.shape[1], h), np.float32)
            steps, read = [], []
            for t, state, z, r, c in reversed(runs[d][1]):
                dnew = dstate + part[t]
                dz, dc = dnew * (c - state) * z * (1 - z), dnew * z * (1 - c * c)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * state * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                dstate = dnew * (1 - z) + drs * r + dzr @ u[:, : 2 * h].T
                g[f"u{d}"][:, : 2 * h] += state.T @ dzr
                g[f"u{d}"][:, 2 * h :] += (r * state).T @ dc
                steps.append(np.concatenate([dzr, dc], 1))
                read.append(x[t])
            flat, at = np.concatenate(steps), np.concatenate(read)
            for k in range(3 * h):
                g[f"x{d}"][:, k] = np.bincount(at, flat[:, k], 256)
        return loss, g


def fit(stretches: list[bytes], labels: list[str], epochs: int = 8, batch: int = 128, least_steps: int = 600, seed: int = 3) -> Network | None:
    """Trains on (bytes, language) draws, ``epochs`` times or ``least_steps`` batches; None without any."""
    langs = sorted(set(labels))
    if not langs:
        return None
    net, rng = Network.new(langs, seed), np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(langs)}
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for b, lang in zip(stretches, labels):
        by_length.setdefault(len(b), []).append((b, number[lang]))
    batches = []
    for n, found in sorted(by_length.items()):
        x = np.frombuffer(b"".join(b for b, _ in found), np.uint8).reshape(-1, n)
        y = np.array([k for _, k in found])
        order = rng.permutation(len(y))
        batches += [(x[o].T.copy(), y[o]) for o in np.array_split(order, max(1, len(order) // batch))]
    m = {k: np.zeros_like(v) for k, v in net.params.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.params.items()}
    epochs = max(epochs, -(-least_steps // len(batches)))
    step, total = 0, epochs * len(batches)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            step += 1
            _, grads = net.gradients(*batches[k])
            rate = 0.01 * (1 - 0.95 * step / total)
            for name, g in grads.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v2[name] = 0.99 * v2[name] + 0.01 * g * g
                net.params[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


class Reader:
    """Labels documents, some hundred windows at a time."""

    def __init__(self, net: Network | None, most: int = 1024) -> None:
        self.net, self.most = net, most

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if self.net is None:
            return ["und"] * len(texts), [0.0] * len(texts)
        sums, sizes = np.zeros((len(texts), len(self.net.langs))), np.zeros(len(texts))
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, text in enumerate(texts):
            if text and _LETTER.search(text):
                for w in windows(spelled(text)):
                    found = waiting.setdefault(len(w), [])
                    found.append((i, w))
                    if len(found) == self.most:
                        self._read(found, sums, sizes)
                        found.clear()
        for found in waiting.values():
            if found:
                self._read(found, sums, sizes)
        langs, scores = [], []
        for total, size in zip(sums, sizes):
            best = int(total.argmax()) if size else 0
            langs.append(self.net.langs[best] if size else "und")
            scores.append(float(min(1.0, total[best] / size)) if size else 0.0)
        return langs, scores

    def _read(self, found: list[tuple[int, np.ndarray]], sums: np.ndarray, sizes: np.ndarray) -> None:
        x = np.stack([w for _, w in found]).T
        letters = _LETTERS[x[CONTEXT : len(x) - CONTEXT]]
        p = (self.net.positions(x, CONTEXT) * letters).sum(1, dtype=np.float64).T
        owner = [i for i, _ in found]
        np.add.at(sums, owner, p)
        np.add.at(sizes, owner, letters.sum(0))


def stretches(text: str | None, most: int = PER_DOC) -> list[bytes]:
    """Up to ``most`` stretches of a text between blanks, at places drawn by its checksum, a quarter of them over its ends; those with letters."""
    raw = spelled(text or "").tobytes()
    rng = np.random.default_rng(zlib.crc32(raw))
    count = min(most, 2 + len(raw) // STRETCH)
    ends = -(-count // 4)
    raw = b" " * CONTEXT + raw + b" " * max(CONTEXT, STRETCH - len(raw))
    last = len(raw) - STRETCH
    places = np.concatenate([rng.integers(0, min(CONTEXT, last) + 1, ends), rng.integers(max(0, last - CONTEXT), last + 1, ends), rng.integers(0, last + 1, max(0, count - 2 * ends))])
    found = [raw[at : at + STRETCH] for at in places[:count]]
    return [b for b in found if _LETTERS[np.frombuffer(b, np.uint8)].any()]


def sample_words(texts: list[str], langs: list[str]) -> tuple[list[bytes], list[str]]:
    """Stretches of the texts and their languages."""
    found = [(b, k) for t, k in zip(texts, langs) for b in stretches(t)]
    return [b for b, _ in found], [k for _, k in found]


def _stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = sample_words(batch.column(1).to_pylist(), batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(found[1], pa.string()), pa.array(found[0], pa.binary())], names=["k", "b"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 3) -> Network | None:
    """Learns from documents with a language whose crc32(id) mod 4 isn't 2."""
    ship(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("k")).where(F.col("k").isNotNull() & F.col("t").isNotNull() & F.col("i").isNotNull() & ~held_out("i", 4, 2))
    counts = common.save(known.groupBy("k").count(), "langs")
    kinds = counts.count()
    if not kinds:
        return None
    if kinds > MAX_STRETCHES:
        raise ValueError(f"{kinds} languages, more than the {MAX_STRETCHES} stretches drawn for training")
    most = min(MAX_DOCS, MAX_DOCS * 1000 / kinds, MAX_STRETCHES / kinds)  # what the driver gets is bounded
    drawn = known.join(common.maybe_broadcast(counts, kinds, 256), "k").where(F.pmod(F.xxhash64("i", F.lit("train")), F.lit(1_000_000)) < F.least(F.lit(1.0), most / F.col("count")) * 1_000_000)
    rows = drawn.select("k", "t").mapInArrow(_stretched, "k string, b binary").toArrow()
    pool: dict[str, list[bytes]] = {}
    for k, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
        pool.setdefault(k, []).append(b)
    rng, found, labels = np.random.default_rng(seed), [], []
    for k in sorted(pool):
        whole = sorted(pool[k])
        take = min(len(whole), MAX_STRETCHES // kinds)
        found += [whole[i] for i in sorted(rng.choice(len(whole), take, replace=False))]
        labels += [k] * take
    common.discard(counts)
    return fit(found, labels)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        for texts in batches:
            langs, scores = reader.label(texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col, 4, 2), F.lit(False)).alias("held_out"), label(F.col(text_col)).alias("x"))
    return rows.select("doc_id", "held_out", "x.lang_pred", "x.score")
