"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's bytes are read by a forward and a backward gated recurrent unit, across words and white space alike, and every
byte gets a probability for each language; a document pools the log probabilities of all its bytes. Texts are cut
into windows of ``WINDOW`` bytes that are read side by side: each unit starts ``LEAD`` bytes ahead of its window, so the first
bytes of a window have been led up to as well. Whole texts are read, each byte is labelled once.

Training is backpropagation through time on windows of whole labelled documents, on the driver. The documents are a
bounded sample: as many of each language at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import unwrapped, wrapped

WINDOW, LEAD = 256, 16  # bytes
TOGETHER = 2048  # windows read side by side
CHUNK = 1 << 21  # bytes of text cut into windows at once
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Gru:
    """One direction: a row of input weights per byte, recurrent weights and their bias."""

    x: np.ndarray  # 256 x 3H
    u: np.ndarray  # H x 3H
    b: np.ndarray  # 3H

    def states(self, seq: np.ndarray) -> Iterator[np.ndarray]:
        """States (H x n) after each of the byte rows of ``seq`` (L x n)."""
        h_dim = self.u.shape[0]
        x, u = np.ascontiguousarray(self.x.T), np.ascontiguousarray(self.u.T)
        h = np.zeros((h_dim, seq.shape[1]), np.float32)
        for row in seq:
            gx, gh = np.take(x, row, axis=1), u @ h
            gh += self.b[:, None]
            zr = gx[: 2 * h_dim]
            zr += gh[: 2 * h_dim]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c = gh[2 * h_dim :]
            c *= zr[h_dim:]
            c += gx[2 * h_dim :]
            np.tanh(c, out=c)
            h = h - c
            h *= zr[:h_dim]
            h += c
            yield h

    def run(self, seq: np.ndarray) -> tuple[np.ndarray, list]:
        """States (L x n x H) over byte columns of ``seq`` (n x L), and what backward() needs."""
        n, length = seq.shape
        h_dim = self.u.shape[0]
        h = np.zeros((n, h_dim), np.float32)
        out, saved = np.empty((length, n, h_dim), np.float32), []
        for t in range(length):
            gx, gh = self.x[seq[:, t]], h @ self.u + self.b
            zr = sigmoid(gx[:, : 2 * h_dim] + gh[:, : 2 * h_dim])
            z, r, c = zr[:, :h_dim], zr[:, h_dim:], gh[:, 2 * h_dim :]
            cand = np.tanh(gx[:, 2 * h_dim :] + r * c)
            saved.append((h, z, r, c, cand))
            h = cand + z * (h - cand)
            out[t] = h
        return out, saved

    def backward(self, seq: np.ndarray, saved: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of x, u, b from those of the states, back through time."""
        dx, du, db = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(self.b)
        dh = np.zeros_like(grad[0])
        for t in range(seq.shape[1] - 1, -1, -1):
            h, z, r, c, cand = saved[t]
            dh = dh + grad[t]
            da = dh * (1 - z) * (1 - cand * cand)
            dz, dr = dh * (h - cand) * z * (1 - z), da * c * r * (1 - r)
            dgh = np.concatenate([dz, dr, da * r], axis=1)
            np.add.at(dx, seq[:, t], np.concatenate([dz, dr, da], axis=1))
            du += h.T @ dgh
            db += dgh.sum(0)
            dh = dh * z + dgh @ self.u.T
        return [dx, du, db]


@dataclass
class Model:
    labels: list[str]
    forward: Gru
    back: Gru
    w: np.ndarray  # 2H x labels
    c: np.ndarray

    def window_sums(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Summed log probabilities of the bytes of each window [start, end) of a text that lies in [low, high).

        Windows are read by length, so those read together end about together; what stands behind the end of a shorter one is not summed.
        """
        out = np.zeros((len(start), len(self.labels)), np.float32)
        h, size = self.forward.u.shape[0], end - start
        order = np.argsort(size, kind="stable")
        short = int((size < WINDOW).sum())
        parts = [x for group in (order[:short], order[short:]) for x in np.array_split(group, max(1, -(-len(group) // TOGETHER))) if len(x)]
        for part in parts:
            n, before, after = size[part], np.minimum(start[part] - low[part], LEAD), np.minimum(high[part] - end[part], LEAD)
            length = int(n.max())
            logits = np.empty((length, len(self.labels), len(part)), np.float32)
            rows = np.arange(-LEAD, length)[:, None]
            for t, state in self.led(self.forward, data, start[part] + rows, rows >= -before):
                logits[t] = self.w[:h].T @ state
            for t, state in self.led(self.back, data, end[part] - 1 - rows, rows >= -after):
                if n[0] == length:  # all windows are of one length
                    logits[length - 1 - t] += self.w[h:].T @ state
                else:
                    ok = np.flatnonzero(n > t)
                    logits[n[ok] - 1 - t, :, ok] += (self.w[h:].T @ state[:, ok]).T
            logits += self.c[:, None]
            logits -= logits.max(1, keepdims=True)
            logits -= np.log(np.exp(logits).sum(1, keepdims=True))
            if n[0] < length:
                logits *= (rows[LEAD:] < n)[:, None]
            out[part] = logits.sum(0).T
        return out

    def led(self, unit: Gru, data: np.ndarray, at: np.ndarray, begun: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(step, state) of a unit on the bytes ``at`` (steps x windows, the first LEAD steps lead up); states are zero until a window has ``begun``."""
        seq = data[np.clip(at, 0, len(data) - 1)]
        for t, state in enumerate(unit.states(seq)):
            if t < LEAD:
                state *= begun[t]
            else:
                yield t - LEAD, state


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the windows of every text."""
    n = -(-np.diff(offsets) // WINDOW)
    row = np.repeat(np.arange(len(n)), n)
    start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    return start, np.minimum(start + WINDOW, offsets[row + 1]), row


def train(texts: list[str], langs: list[str], hidden: int = 8, steps: int = 400, batch: int = 192, span: int = 48, rate: float = 0.015, seed: int = 11) -> Model | None:
    """A model of the labels met; None without one. Languages count alike however often they occur.

    Every step draws ``batch`` stretches of ``span`` bytes from anywhere in the texts; shorter texts are drawn whole, in steps of their own.
    """
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)

    def gru() -> Gru:
        return Gru(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.3, (256, 3 * hidden)), (hidden**-0.5, (hidden, 3 * hidden)), (0.01, 3 * hidden))))

    model = Model(labels, gru(), gru(), rng.normal(0, 0.2, (2 * hidden, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    held = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    data, size = np.concatenate([*held, np.zeros(0, np.uint8)]), np.array([len(x) for x in held])
    begin = np.cumsum(size) - size
    y = np.array([labels.index(x) for x in langs])
    weight = (size / np.maximum(1, np.bincount(y, size, minlength=len(labels)))[y]).astype(float)
    if not weight.sum():
        return model
    length = np.minimum(size, span)
    by_length = {int(k): np.flatnonzero(length == k) for k in np.unique(length) if k}
    chance = np.array([weight[i].sum() for i in by_length.values()])
    params = [model.forward.x, model.forward.u, model.forward.b, model.back.x, model.back.u, model.back.b, model.w, model.c]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        long = list(by_length)[int(rng.choice(len(chance), p=chance / chance.sum()))]
        of = by_length[long]
        pick = rng.choice(of, batch, p=weight[of] / weight[of].sum())
        at = begin[pick] + (rng.random(batch) * (size[pick] - long + 1)).astype(np.int64)
        seq, target = data[at[:, None] + np.arange(long)], y[pick]
        back = seq[:, ::-1]
        a, saved_a = model.forward.run(seq)
        b, saved_b = model.back.run(back)
        both = np.concatenate([a, b[::-1]], axis=2)
        s = both @ model.w + model.c
        p = np.exp(s - s.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(batch), target] -= 1
        p /= long * batch
        flat = both.reshape(-1, 2 * hidden)
        dboth = p @ model.w.T
        grads = [
            *model.forward.backward(seq, saved_a, dboth[:, :, :hidden]),
            *model.back.backward(back, saved_b, dboth[::-1, :, hidden:]),
            flat.T @ p.reshape(-1, len(labels)),
            p.sum((0, 1)),
        ]
        now = rate * (1 - step / (steps + 1))
        for q, g, a1, a2 in zip(params, grads, m1, m2, strict=True):
            a1 += 0.1 * (g - a1)
            a2 += 0.005 * (g * g - a2)
            q -= (now * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
    return model


def pooled(model: Model, column: pa.Array) -> np.ndarray:
    """Mean log probabilities over all bytes of each text."""
    out, n = np.zeros((len(column), len(model.labels))), np.zeros(len(column))
    for a, b, data, offsets in tokens.chunks(column, CHUNK):
        start, end, row = windows(offsets)
        if len(start):
            sums = model.window_sums(data, start, end, offsets[row], offsets[row + 1])
            for k in range(out.shape[1]):
                out[a:b, k] = np.bincount(row, sums[:, k], minlength=b - a)
            n[a:b] = np.diff(offsets)
    return out / np.maximum(1, n)[:, None]


def predictor(model: Model | None) -> Callable[[pa.Array, pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function of columns (whether a text has letters, the text) to names and scores."""

    def predicted(lettered: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        letters = lettered.to_numpy(zero_copy_only=False)
        names, score = np.full(len(letters), "und", dtype=object), np.zeros(len(letters))
        if model and len(letters):
            mean = pooled(model, texts)
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            names = np.where(letters, np.array(model.labels, dtype=object)[p.argmax(1)], "und")
            score = np.where(letters, p.max(1), 0.0)
        return names, score

    return predicted


def predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    predicted = predictor(model)
    for batch in batches:
        names, score = predicted(batch.column(2), batch.column(3))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
        )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, seed: int = 0) -> Model | None:
    """Train on whole labelled documents, at most ``sample_docs`` of each language, in hash order of their ids.

    A first count sets a hash threshold per language that about twice its sample passes, so tasks hand on the
    sample and little more however many tasks there are, and a rare language is learned on a large table as on a small one.
    """
    key, lang = F.xxhash64(F.lit(seed), F.col(id_col)), F.col(lang_col).cast("string")
    labelled = df.filter(lang.isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r.y: r["count"] for r in labelled.groupBy(lang.alias("y")).count().collect()}  # a row per language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, int(min(1.0, 2 * sample_docs / n) * (1 << 30)))])
    rows = (
        labelled.filter(F.pmod(key, F.lit(1 << 30)) <= F.try_element_at(share, lang))
        .select(F.col(text_col).cast("string").alias("t"), lang.alias("y"), key.alias("k"))
        .withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("k", "t")))
        .filter(F.col("n") <= sample_docs)
        .orderBy("y", "n")
        .collect()
    )
    return train([r.t for r in rows], [r.y for r in rows])


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 300) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (pooled probability of the prediction).

    ``und`` with score 0 stands for null texts, texts without a letter, and for everything when no
    labelled row can be learned from. Equal probabilities go to the language that sorts first. Documents with a null id are not
    learned from and count as not held out. Repeated rows get equal answers; an empty table gives an empty result; other columns are not read.
    """
    model = fit(df, id_col, text_col, lang_col, sample_docs)
    t = F.col(text_col).cast("string")
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(t.rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.coalesce(t, F.lit("")).alias("text")
    ).mapInArrow(lambda it: predict(it, model), SCHEMA)


def identified_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 300) -> DataFrame:
    """``df`` without the rows whose language is ``und``; ``lang_col`` becomes the prediction, other columns stay.

    Null texts and texts without a letter go. Where no labelled row can be learned from, all texts with a letter stay as they
    are. The prediction is a column beside each row, so no join by id is needed and only texts travel to Python; repeated rows, ties and null
    ids are treated as in ``identify``; an empty table gives an empty result.
    """
    model = fit(df, id_col, text_col, lang_col, sample_docs)
    t = F.col(text_col).cast("string")
    letters = F.coalesce(t.rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return df.filter(letters)
    @F.arrow_udf("string")
    def told(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        predicted = predictor(model)
        for lettered, texts in batches:
            yield pa.array(predicted(lettered, pc.fill_null(texts, ""))[0], pa.string())

    told = told.asNondeterministic()  # else the filter would be evaluated below the projection too, with a second run of the network
    rows = wrapped(df, pred=told(letters, t)).filter(F.col("pred") != "und")
    return unwrapped(rows, df, **{lang_col: F.col("pred")})
