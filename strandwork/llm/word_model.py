"""Language-model scores of whole documents: a gated recurrent network over words beside a counted base.

Counts are exact and cover the whole training fold: words are counted in each task, summed by a shuffle, and
written as a table. The base is the add-0.1 unigram of these counts. The model's symbols are the end, the ``SYMBOLS`` - 2
most frequent words and one symbol for all others; a word behind that last symbol is weighed by its smoothed count among
those others, so the whole is a proper distribution over all words. The network has one gated recurrent layer and an output
softmax factored into the class of a symbol and the symbol within its class.

It is trained in numpy by backpropagation truncated to ``WINDOW`` steps, on every word of every document of the training fold, once.
In each of ``ROUNDS`` rounds every task goes on from the same network over its share of the fold, and the networks
are averaged by the words they saw: first by groups of tasks, so that the driver gets as many as the root of the shuffle partitions.
Scoring reads every word of every text; the state is carried from window to
window, and documents stand one after another in ``LANES`` lanes with the state cleared between them. Batches are encoded and
scored in groups of ``TOGETHER`` bytes, as each call looks up the frequent words anew and its last lanes wait for its longest text;
the fewer lanes are left, the longer is a window.

Words among the most frequent are looked up in a table that goes to all tasks and is bounded in words (``FREQUENT``) and bytes (``FREQUENT_BYTES``);
what is rarer or longer leaves the task once per document and word, and is joined with the counts by a
shuffle, in which adaptive execution may split what is skewed.

Defined results: null and empty texts are one end; null ids are learned from; repeated rows are scored one by one and counted
each; with nothing to learn from all counts are zero and the network is as drawn; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import release, settle, shuffle_partitions, small_batches

END, SMOOTH = "\n", 0.1  # no word holds a line break
#: Words, and bytes of them all and of the longest, of the table that goes to all tasks.
FREQUENT, FREQUENT_BYTES, LONGEST = 262_144, 4 << 20, 128
SYMBOLS, CLASSES, HIDDEN, WINDOW, LANES = 1024, 32, 16, 32, 1024
ROUNDS, RATE = 4, 0.01
#: Symbols that a task gathers before it trains on them, and steps of training that so many are to give at least.
GATHERED, STEPS = 1 << 20, 128
#: Bytes of batches that are encoded and scored together: what is set up for each call, and lanes that wait for a long text, count less.
TOGETHER = 8 << 20
#: Scores under this bound are exponentiated as they are.
SAFE = 60.0
_END, _RARE = 0, 1


class WordModel:
    """The network; arrays are (features, lanes). x (3h, symbols), u (3h, h), c (classes, h + 1), w (classes, words, h + 1)."""

    def __init__(self, symbols: int = SYMBOLS, classes: int = CLASSES, hidden: int = HIDDEN, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h, self.hidden, self.size = hidden, hidden, -(-symbols // classes)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.w = {"x": draw(3 * h, self.size * classes, by=0.3), "u": draw(3 * h, h, by=h**-0.5), "c": draw(classes, h + 1, by=0.05), "w": draw(classes, self.size, h + 1, by=0.05)}

    def copy(self) -> WordModel:
        out = object.__new__(WordModel)
        out.hidden, out.size, out.w = self.hidden, self.size, {k: v.copy() for k, v in self.w.items()}
        return out

    def states(self, before: np.ndarray, state: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, h + 1, lanes) after each of the symbols ``before`` (time, lanes); an end clears the state that comes before it."""
        h, (time, lanes) = self.hidden, before.shape
        out = np.ones((time, h + 1, lanes), np.float32)
        sign = np.repeat([-1, 1], [2 * h, h]).astype(np.float32)[:, None]  # a gate is 1 / (1 + exp(-a))
        x, u, going = self.w["x"] * sign, self.w["u"] * sign, (before != _END).astype(np.float32)
        kind, slots = np.result_type(u, state), time if keep is not None else 1
        was, r, a = np.empty((slots, h, lanes), kind), np.empty((slots, 3 * h, lanes), kind), np.empty((slots, 3 * h, lanes), x.dtype)
        part = np.empty((h, lanes), kind)
        with np.errstate(over="ignore"):
            for t in range(time):
                was_, r_, a_ = was[t % slots], r[t % slots], a[t % slots]
                gates, n = a_[: 2 * h], a_[2 * h :]
                np.take(x, before[t], axis=1, mode="clip", out=a_)
                np.multiply(state, going[t], out=was_)
                np.matmul(u, was_, out=r_)
                gates += r_[: 2 * h]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                np.multiply(gates[h:], r_[2 * h :], out=part)
                n += part
                np.tanh(n, out=n)
                np.subtract(was_, n, out=part)
                part *= gates[:h]
                state = out[t, :h]
                np.add(part, n, out=state, casting="same_kind")
        if keep is not None:
            keep |= {"going": going, "was": was, "gates": a, "r": r[:, 2 * h :]}
        return out

    def _bounded(self) -> bool:
        """Whether no score can be too large for an exponential, as no state is beyond 1."""
        return max(float(np.abs(self.w[k]).sum(axis=-1).max()) for k in "cw") < SAFE

    def log10(self, states: np.ndarray, target: np.ndarray, bounded: bool = False) -> np.ndarray:
        """log10 probability of each target (time, lanes). ``bounded``: no score is beyond ``SAFE``."""
        flat, target_ = np.ascontiguousarray(states.transpose(1, 0, 2)).reshape(states.shape[1], -1), target.ravel()
        of, within = np.divmod(target_.astype(np.int32), np.int32(self.size))

        def log_softmax(score: np.ndarray, right: np.ndarray) -> np.ndarray:
            own = score.ravel()[right * np.int64(len(right)) + np.arange(len(right))]
            if not bounded:
                top = score.max(axis=0)
                score -= top
                own -= top
            np.exp(score, out=score)
            own -= np.log(score.sum(axis=0))
            return own

        out = log_softmax(self.w["c"] @ flat, of)
        order = np.argsort(of.astype(np.int16), kind="stable")
        by_class, within = np.take(flat, order, axis=1), within[order]
        bounds = np.searchsorted(of[order], np.arange(len(self.w["c"]) + 1)).tolist()
        inner = np.concatenate([log_softmax(w @ by_class[:, a:z], within[a:z]) for w, a, z in zip(self.w["w"], bounds[:-1], bounds[1:]) if z > a])
        out[order] += inner
        return (out * np.float32(1 / np.log(10))).reshape(target.shape)

    def gradients(self, before: np.ndarray, target: np.ndarray, state: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean cross-entropy over a window, its gradients through the window, and the last state."""
        h, w, kept, bounded = self.hidden, self.w, {}, self._bounded()
        states = self.states(before, state, kept)
        flat = np.ascontiguousarray(states.transpose(1, 0, 2)).reshape(h + 1, -1)
        of, within = np.divmod(target.ravel().astype(np.int32), np.int32(self.size))
        count, loss = len(of), 0.0

        def softmax(score: np.ndarray, right: np.ndarray) -> np.ndarray:
            nonlocal loss
            if not bounded:
                score -= score.max(axis=0)
            p = np.exp(score, out=score)
            p *= 1 / (p.sum(axis=0) * count)
            own, all_ = right * np.int64(len(right)) + np.arange(len(right)), p.reshape(-1)
            mine = all_[own]
            loss -= float(np.log(mine * count + 1e-12).sum()) / count
            all_[own] = mine - 1 / count
            return p

        # all in the order of the targets' classes, and back once
        order = np.argsort(of.astype(np.int16), kind="stable")
        by_class, of, within, place = np.take(flat, order, axis=1), of[order], within[order], np.empty_like(order)
        place[order] = np.arange(count)
        d = softmax(w["c"] @ by_class, of)
        grad = {"c": d @ by_class.T, "w": np.zeros_like(w["w"])}
        back = w["c"].T[:h] @ d
        bounds = np.searchsorted(of, np.arange(len(w["c"]) + 1)).tolist()
        for k, (a, z) in enumerate(zip(bounds[:-1], bounds[1:])):
            if z > a:
                d = softmax(w["w"][k] @ by_class[:, a:z], within[a:z])
                grad["w"][k] = d @ by_class[:, a:z].T
                back[:, a:z] += w["w"][k].T[:h] @ d
        into = np.take(back, place, axis=1).reshape(h, *before.shape)
        # what doesn't hang on later steps is worked out for all of them at once
        was, r, going = kept["was"], kept["r"], kept["going"]
        z, q, n = (kept["gates"][:, i * h : i * h + h] for i in range(3))
        to_z, to_n, to_q = (was - n) * z * (1 - z), (1 - z) * (1 - n * n), r * q * (1 - q)
        deltas, later = np.empty((len(before), 4 * h, before.shape[1]), back.dtype), np.zeros_like(state)  # of z, q, n behind q, n
        back_u = np.ascontiguousarray(w["u"].T)
        for t in range(len(before) - 1, -1, -1):
            d = deltas[t]
            g = into[:, t] + later
            np.multiply(g, to_z[t], out=d[:h])
            np.multiply(g, to_n[t], out=d[3 * h :])
            np.multiply(d[3 * h :], to_q[t], out=d[h : 2 * h])
            np.multiply(d[3 * h :], q[t], out=d[2 * h : 3 * h])
            g *= z[t]
            later = back_u @ d[: 3 * h]
            later += g
            later *= going[t]
        # one sum for each symbol that occurs
        symbols = before.ravel()
        order = np.argsort(symbols.astype(np.int16), kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(symbols[order]) != 0))
        of_x = np.concatenate([deltas[:, : 2 * h], deltas[:, 3 * h :]], axis=1).transpose(1, 0, 2).reshape(3 * h, -1)
        gx = np.zeros_like(w["x"])
        gx[:, symbols[order[starts]]] = np.add.reduceat(np.take(of_x, order, axis=1), starts, axis=1)
        grad |= {"x": gx, "u": np.matmul(deltas[:, : 3 * h], was.transpose(0, 2, 1)).sum(axis=0)}
        return loss, grad, states[-1, :h]

    def fit(self, docs: list[np.ndarray], lanes: int | None = None, epochs: int = 1, rate: float = RATE, moments: dict | None = None) -> float:
        """Adam over windows of a stream that is cut into lanes; the last epoch's mean loss in nats. ``moments`` carries Adam's state from call to call."""
        stream = np.concatenate([np.zeros(1, np.int64), *docs])
        lanes = lanes or int(np.clip(len(stream) // (WINDOW * STEPS), 8, 256))
        time, loss = -(-(len(stream) - 1) // lanes), float("nan")
        if not time or len(stream) < 2:
            return loss
        moments = {} if moments is None else moments
        if not moments:
            moments |= {"step": 0, "m": {k: np.zeros_like(v) for k, v in self.w.items()}, "s": {k: np.zeros_like(v) for k, v in self.w.items()}}
        m, s = moments["m"], moments["s"]
        stream = np.concatenate([stream, np.zeros(time * lanes + 1 - len(stream), np.int64)])  # the last lanes end in ends
        before, target = (stream[i : i + time * lanes].reshape(lanes, time).T for i in (0, 1))
        for _ in range(epochs):
            losses, state = [], np.zeros((self.hidden, lanes), np.float32)
            for a in range(0, time, WINDOW):
                one, grad, state = self.gradients(before[a : a + WINDOW], target[a : a + WINDOW], state)
                losses.append(one)
                moments["step"] += 1
                now, step = rate * min(1.0, moments["step"] / 10), moments["step"]
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.005 * (g * g - s[k])
                    self.w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.995**step)) + 1e-7)
            loss = float(np.mean(losses))
        return loss

    def score(self, docs: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
        """log10 probability of each whole document; a document's symbols end with the end."""
        loads = [(0, i) for i in range(min(lanes, len(docs)))]
        lane: list[list[int]] = [[] for _ in loads]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            load, k = heapq.heappop(loads)
            lane[k].append(i)
            heapq.heappush(loads, (load + len(docs[i]), k))
        if not docs:
            return np.zeros(0)
        lane.sort(key=lambda own: -sum(len(docs[i]) for i in own))
        whose = [i for own in lane for i in own]
        # lane after lane, with an end before them all: what stands before a lane is the end of the one before it
        stream = np.concatenate([[_END], *(docs[i] for i in whose)])
        sizes = np.array([sum(len(docs[i]) for i in own) for own in lane])
        starts, logs = np.cumsum(sizes) - sizes, np.empty(len(stream) - 1)
        state, bounded, a = np.zeros((self.hidden, len(lane)), np.float32), self._bounded(), 0
        while a < sizes[0]:
            live = int(np.searchsorted(-sizes, -a, "left"))
            # the fewer lanes go on, the longer the window, but over WINDOW no longer than all of them last
            time = int(min(sizes[0] - a, max(WINDOW, min(WINDOW * lanes // live, sizes[live - 1] - a))))
            step = a + np.arange(time)[:, None]
            at, lasts = starts[:live] + step, step < sizes[:live]
            np.minimum(at, len(logs) - 1, out=at)
            target = np.where(lasts, stream[at + 1], _END)
            states = self.states(stream[at], state[:, :live])
            state = states[-1, : self.hidden]
            logs[at[lasts]] = self.log10(states, target, bounded)[lasts]
            a += time
        return np.bincount(np.repeat(whose, [len(docs[i]) for i in whose]), logs, len(docs))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a column one after another, and each text's bounds among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    some = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return flat.filter(some), before[offsets - offsets[0]]


def together(batches: Iterator[pa.RecordBatch], size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The same rows in their order, in batches of up to ``size`` bytes; a larger one stays as it is, empty ones go."""
    held: list[pa.RecordBatch] = []

    def joined() -> Iterator[pa.RecordBatch]:
        if held:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()

    for batch in batches:
        if sum(b.nbytes for b in held) + batch.nbytes > size:
            yield from joined()
        if batch.num_rows:
            held.append(batch)
    yield from joined()


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c over the column ``text``, with an end for each row."""
    small_batches(texts.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed() -> pa.RecordBatch:
            got = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            held.clear()
            return pa.RecordBatch.from_arrays([got["word"].combine_chunks().cast(pa.string()), got["n_sum"].combine_chunks()], names=["word", "n"])

        for batch in batches:
            words, _ = words_of(batch.column(0))
            coded = words.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            held.append(pa.table({"word": pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_string())]), "n": pa.array(np.append(n, batch.num_rows), pa.int64())}))
            rows += held[-1].num_rows
            if rows > 300_000:
                yield summed()
                rows = 0
        if held:
            yield summed()
        release()

    return texts.select("text").mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _symbols(texts: pa.Array, symbol: np.ndarray, frequent: pa.Array) -> tuple[list[np.ndarray], pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Each text's symbols with the end; its coded words, their bounds, and the place among the frequent of each different word (-1: rarer)."""
    words, ends = words_of(texts)
    coded = words.dictionary_encode()
    place = pc.fill_null(pc.index_in(coded.dictionary, value_set=frequent), -1).to_numpy().astype(np.int64)
    own = np.where(place >= 0, symbol[place], _RARE)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    return [np.append(own[a:z], _END) for a, z in zip(ends[:-1], ends[1:])], coded, ends, place


SCORED = "row long, doc_id long, n_tokens long, n_known long, logs double, model double, words array<string>, times array<long>"


def frequent_words(counts: DataFrame, words: int = FREQUENT, bytes_: int = FREQUENT_BYTES) -> tuple[pa.Array, np.ndarray]:
    """The most frequent words of ``counts (word, c)``, most frequent first, and their counts; at most so many words and bytes.

    They are those of the highest sizes, 16 to a doubling, that fit the bounds: a table of sizes has under 1,024 rows.
    """
    size, length = F.floor(F.log2("c") * 16), F.octet_length("word")
    common = counts.where((F.col("word") != END) & (length <= LONGEST))
    n = held = 0
    for r in sorted(common.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.sum(length).alias("bytes")).collect(), reverse=True):
        n, held = n + r["n"], held + r["bytes"]
        if n > words or held > bytes_:
            common = common.where(size > r["size"])
            break
    found = common.toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    return found["word"].combine_chunks().cast(pa.large_string()), found["c"].to_numpy().astype(np.float64)


def train_rounds(texts: DataFrame, model: WordModel, symbol: np.ndarray, words: pa.Array, rounds: int = ROUNDS, rate: float = RATE) -> WordModel:
    """``model`` trained on every row of ``texts (doc_id, text)`` once, by averaged rounds."""
    spark = texts.sparkSession
    groups = int(np.ceil(shuffle_partitions(spark) ** 0.5))
    schema = "slot int, seen long, weights binary"

    def flat(w: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float32)

    def one(slot: int, seen: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "seen": pa.array([seen], pa.int64()), "weights": pa.array([total.astype(np.float64).tobytes()], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = 0, None
        for batch in batches:
            for n, weights in zip(batch["seen"].to_pylist(), batch["weights"], strict=True):
                own = np.frombuffer(weights.as_buffer(), np.float64)
                seen, total = seen + n, own if total is None else total + own
        if seen:
            yield one(0, seen, total)

    for r in range(rounds):
        shared = spark.sparkContext.broadcast((model, symbol, words))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, now=rate * (1 - r / rounds)) -> Iterator[pa.RecordBatch]:
            start, symbol, words = shared.value
            own, moments, seen, gathered, size = start.copy(), {}, 0, [], 0
            for batch in together(batches):
                more = _symbols(batch.column(0), symbol, words)[0]
                gathered, size = gathered + more, size + sum(map(len, more))
                if size > GATHERED:
                    own.fit(gathered, rate=now, moments=moments)
                    seen, gathered, size = seen + size, [], 0
            if gathered:
                own.fit(gathered, rate=now, moments=moments)
                seen += size
            if seen:
                yield one(TaskContext.get().partitionId() % groups, seen, flat(own.w) * float(seen))
            release()

        part = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r).select("text").mapInArrow(learn, schema)
        found = part.repartition(groups, "slot").mapInArrow(summed, schema).collect()
        if seen := sum(x["seen"] for x in found):
            mean, at, model = sum(np.frombuffer(x["weights"], np.float64) for x in found) / seen, 0, model.copy()
            for k in sorted(model.w):
                size = model.w[k].size
                model.w[k] = mean[at : at + size].reshape(model.w[k].shape).astype(np.float32)
                at += size
        shared.unpersist()
    return model


def score_documents(docs: DataFrame, held_out: Column, *, frequent: int = FREQUENT, symbols: int = SYMBOLS, classes: int = CLASSES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned where ``held_out`` (over the id, named doc_id) is false."""
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    train = rows.where(~held)
    counts = settle(word_counts(train), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0)).alias("ends")).first()
    n, v = totals["n"], totals["v"]
    common_words, c = frequent_words(counts, frequent)
    known = min(len(c), symbols - 2)
    symbol = np.concatenate([np.arange(2, 2 + known), np.full(len(c) - known + 1, _RARE)]).astype(np.int64)  # the last for place -1
    rest = float(n - totals["ends"] - c[:known].sum()) + SMOOTH * (v - known - bool(totals["ends"]) + 1)
    model = train_rounds(train, WordModel(symbols, classes), symbol, common_words, rounds)
    shared = spark.sparkContext.broadcast((model, common_words, c, symbol))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common_words, c, symbol = shared.value
        row = TaskContext.get().partitionId() << 33
        logs, weight = np.log10(c + SMOOTH), np.log10((c + SMOOTH) / rest)
        weight[:known] = 0
        for batch in together(batches):
            size = batch.num_rows
            sequences, coded, ends, place = _symbols(batch.column(1), symbol, common_words)
            codes, owner = coded.indices.to_numpy(), np.repeat(np.arange(size), np.diff(ends))
            at = place[codes]
            common_ = at >= 0
            rare = np.flatnonzero(~common_)
            pairs, times = np.unique(owner[rare] * len(place) + codes[rare], return_counts=True)
            whose = pairs // max(1, len(place))
            offsets = pa.array(np.searchsorted(whose, np.arange(size + 1)).astype(np.int32))
            total = lambda x: np.bincount(owner[common_], x[at[common_]], size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(size)), batch.column(0), pa.array(np.diff(ends) + 1),
                    pa.array(np.bincount(owner[common_], minlength=size), pa.int64()), pa.array(total(logs), pa.float64()), pa.array(total(weight) + model.score(sequences), pa.float64()),
                    pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(pairs % max(1, len(place)))).cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                ],
                names=[x.split()[0] for x in SCORED.split(", ")],
            )
            row += size
        release()

    scored = settle(rows.mapInArrow(each, SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    weighed = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("rare_logs"), F.sum("times").alias("rare_n"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    zero = lambda name, kind: F.coalesce(F.col(name), F.lit(0).cast(kind))
    end_log = float(np.log10(totals["ends"] + SMOOTH))
    return scored.join(weighed, "row", "left").select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + zero("rare_known", "long") + int(totals["ends"] > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("rare_logs", "double") + end_log - F.col("n_tokens") * float(np.log10(n + SMOOTH * (v + 1)))).alias("base_score"),
        (F.col("model") + zero("rare_logs", "double") - zero("rare_n", "long") * float(np.log10(rest))).alias("score"),
    )
