"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW``; over each window one gated recurrent
layer runs forward and one backward, a softmax labels every byte position, and the
document's probabilities are the mean over all its positions. The windows keep memory bounded and let
many positions run at once, whatever the length of a text.

The network is trained in numpy by backpropagation through time over the windows of the texts of
a bounded sample of labelled documents: about ``SAMPLE`` per language, picked by a hash of
the id, for the ``LANGUAGES`` most frequent languages. A document of that sample gives all of its windows, or as many as bring the sample to ``MOST_WINDOWS``, spread
evenly over all of its text. The bounds are parameters.

Defined results: ``und`` with score 0 for null texts and for those without a letter, and for
all if nothing can be learned; null ids count as not held out and are not learned from; repeated
rows are predicted one by one; an empty table gives an empty result; other columns than id, text and
language are ignored, and the prediction itself sees the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, small_batches

WINDOW = 48
HIDDEN = 8
SAMPLE, LANGUAGES, MOST_WINDOWS = 64, 256, 1 << 19
#: Steps of training at least.
STEPS = 128
#: Windows that run at once.
LANES = 2048
UNKNOWN = "und"
_PAD = 256


class ByteTagger:
    """The network; arrays are (features, lanes), so that each gate is one contiguous block.

    Weights of a direction: x (3h, 257) by byte, u (3h, h); out (labels, 2h + 1).
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        h, k = hidden, len(labels)
        self.labels, self.hidden = labels, h
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.w = {f"{d}{p}": draw(3 * h, 257 if p == "x" else h, by=0.5 if p == "x" else h**-0.5) for d in "fb" for p in "xu"} | {"out": draw(k, 2 * h + 1, by=0.3)}

    def _run(self, d: str, bytes_: np.ndarray, out: np.ndarray, keep: list | None = None) -> None:
        """States (time, hidden, lanes) over ``bytes_`` (time, lanes) into ``out``; a gate is half a tanh and a half."""
        h, lanes = self.hidden, bytes_.shape[1]
        half = np.ones((3 * h, 1), np.float32)
        half[: 2 * h] = 0.5
        x, u = self.w[f"{d}x"] * half, self.w[f"{d}u"] * half
        state = np.zeros((h, lanes), np.float32)
        a, r, n = np.empty((3 * h, lanes), np.float32), np.empty((3 * h, lanes), np.float32), np.empty((h, lanes), np.float32)
        for t in range(len(bytes_)) if d == "f" else range(len(bytes_) - 1, -1, -1):
            np.take(x, bytes_[t], axis=1, out=a, mode="clip")
            np.matmul(u, state, out=r)
            gates = a[: 2 * h]
            gates += r[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, q = gates[:h], gates[h:]
            np.multiply(q, r[2 * h :], out=n)
            n += a[2 * h :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, state, z.copy(), q.copy(), r[2 * h :].copy(), n.copy()))
            np.subtract(state, n, out=out[t])
            out[t] *= z
            out[t] += n
            state = out[t]

    def probabilities(self, bytes_: np.ndarray) -> np.ndarray:
        """Per position (time, labels, lanes)."""
        h, out = self.hidden, self.w["out"]
        both = np.empty((len(bytes_), 2 * h, bytes_.shape[1]), np.float32)
        self._run("f", bytes_, both[:, :h])
        self._run("b", bytes_, both[:, h:])
        score = out[:, :-1] @ both
        score += out[:, -1:]
        score -= score.max(axis=1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=1, keepdims=True)
        return score

    def gradients(self, bytes_: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions that aren't padding, and its gradients through time."""
        h, w, time, lanes = self.hidden, self.w, *bytes_.shape
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.ones((time, 2 * h + 1, lanes), np.float32)
        for i, d in enumerate("fb"):
            self._run(d, bytes_, both[:, i * h : (i + 1) * h], kept[d])
        score = w["out"] @ both
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=1, keepdims=True)
        real = (bytes_ != _PAD).astype(np.float32)
        total = real.sum()
        lane = np.arange(lanes)
        own = p[:, label, lane]
        loss = float(-(np.log(own + 1e-9) * real).sum() / total)
        p[:, label, lane] = own - 1
        p *= real[:, None] / total
        grad = {"out": np.einsum("tkl,tfl->kf", p, both, optimize=True)}
        states = w["out"][:, : 2 * h].T @ p
        for i, d in enumerate("fb"):
            u = w[f"{d}u"]
            gx, gu, back = np.zeros((257, 3 * h), np.float32), np.zeros_like(u), np.zeros((h, lanes), np.float32)
            for t, before, z, q, rn, n in reversed(kept[d]):
                g = states[t, i * h : (i + 1) * h] + back
                dn = g * (1 - z) * (1 - n * n)
                dz = g * (before - n) * z * (1 - z)
                dq = dn * rn * q * (1 - q)
                np.add.at(gx, bytes_[t], np.concatenate([dz, dq, dn]).T)
                dr = np.concatenate([dz, dq, dn * q])
                gu += dr @ before.T
                back = g * z + u.T @ dr
            grad[f"{d}x"], grad[f"{d}u"] = gx.T, gu
        return loss, grad

    def fit(self, bytes_: np.ndarray, label: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.02, seed: int = 3) -> float:
        """Adam over shuffled batches of windows (lanes, time), in as many epochs or so many more that there are ``STEPS`` steps; the last epoch's mean loss."""
        epochs = max(epochs, STEPS // max(1, -(-len(label) // batch)))
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        loss = float("nan")
        for epoch in range(epochs):
            order, losses = rng.permutation(len(label)), []
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                step += 1
                one, grad = self.gradients(np.ascontiguousarray(bytes_[part].T), label[part])
                losses.append(one)
                now = rate * (1 - epoch / epochs)
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
            loss = float(np.mean(losses))
        return loss


def windows_of(text: bytes, window: int) -> np.ndarray:
    """(windows, window) of a text's bytes; the last is padded."""
    count = -(-len(text) // window)
    out = np.full(count * window, _PAD, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(count, window)


def train(docs: DataFrame, learnable, *, sample: int = SAMPLE, languages: int = LANGUAGES, window: int = WINDOW, hidden: int = HIDDEN, epochs: int = 4, most: int = MOST_WINDOWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteTagger | None:
    """The network learned from the rows of ``docs`` for which the column ``learnable`` is true; None if there are none."""
    spark = docs.sparkSession
    known = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(languages).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    # a document is drawn if the hash of its id falls in its language's share
    share = F.create_map(*[F.lit(x) for lang in labels for x in (lang, min(1.0, sample / counts[lang]))])
    unit = F.pmod(F.xxhash64(id_col, F.lit("drawn")), F.lit(1 << 30)) / float(1 << 30)

    each = max(1, most // (sample * len(labels)))

    def draw(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                cut = windows_of(text.encode(), window)
                some = cut if len(cut) <= each else cut[np.linspace(0, len(cut) - 1, each).astype(int)]
                out.extend((lang, part.tobytes()) for part in some)
            yield pd.DataFrame(out, columns=["lang", "bytes"])

    picked = known.where(unit < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = picked.mapInPandas(draw, "lang string, bytes binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["lang", "bytes"])
    bytes_ = np.stack([np.frombuffer(b, np.int16) for b in got["bytes"]])
    label = np.searchsorted(labels, got["lang"].to_numpy(dtype=str))
    tagger = ByteTagger(labels, hidden)
    tagger.fit(bytes_, label, epochs=epochs)
    return tagger


def document_probabilities(tagger: ByteTagger, texts: list[bytes], window: int = WINDOW, lanes: int = LANES) -> np.ndarray:
    """(texts, labels): the mean of the positions' probabilities; texts aren't empty."""
    sums = np.zeros((len(texts), len(tagger.labels)))
    hold, owner, count = [], [], 0

    def run() -> None:
        bytes_ = np.concatenate(hold)
        own = np.concatenate(owner)
        for i in range(0, len(own), lanes):
            part = np.ascontiguousarray(bytes_[i : i + lanes].T)
            p = tagger.probabilities(part)
            p *= (part != _PAD)[:, None]
            np.add.at(sums, own[i : i + lanes], p.sum(axis=0).T)

    for i, text in enumerate(texts):
        cut = windows_of(text, window)
        hold.append(cut)
        owner.append(np.full(len(cut), i))
        count += len(cut)
        if count >= 8 * lanes:
            run()
            hold, owner, count = [], [], 0
    if hold:
        run()
    return sums / np.array([max(1, len(t)) for t in texts])[:, None]


def identify(docs: DataFrame, tagger: ByteTagger | None, *, window: int = WINDOW, text_col: str = "text", carry: tuple[str, ...] = (), scored: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``carry`` columns of ``docs`` with the language and its score, named as in ``scored``."""
    small_batches(docs.sparkSession)
    sent = carry if text_col in carry else (*carry, text_col)  # a carried text goes to the task once
    at, width = sent.index(text_col), len(carry)
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(sent)])
    kept = rows.schema.fields[:width]
    names = [*(f.name for f in kept), "lang_pred", "score"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            own = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if tagger else []
            label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if own:
                p = document_probabilities(tagger, [texts[i].encode() for i in own], window)
                for i, best, top in zip(own, p.argmax(axis=1), p.max(axis=1), strict=True):
                    label[i], score[i] = tagger.labels[best], min(1.0, max(0.0, float(top)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(label, pa.string()), pa.array(score)], names=names)
        release()

    return rows.mapInArrow(predict, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], F.col("lang_pred").alias(scored[0]), F.col("score").alias(scored[1]))


def held_out(id_col: str = "doc_id"):
    """The fold that isn't learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def predict_languages(docs: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """Learn from the documents outside the held-out fold and predict for all: doc_id, held_out, lang_pred, score."""
    tagger = train(docs, ~held_out(id_col), id_col=id_col, **columns)
    found = identify(docs, tagger, carry=(id_col,), text_col=columns.get("text_col", "text"))
    return found.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "lang_pred", "score")
