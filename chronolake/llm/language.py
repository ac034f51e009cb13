"""Language identification: a bidirectional gated recurrent network over bytes.

A text's bytes are read in windows of ``WINDOW`` from its beginning to its end. One network reads a window forwards, another
one backwards; from both states at a byte, a softmax gives the probability of each language there, so every position has a
label. A document's probabilities are the means of its positions'. The networks are gated recurrent units whose input
weights are a column for each byte value; they are trained in numpy by backpropagation through time, on windows of a bounded
sample of the labelled documents, the same number of each language where there are enough.

Arrays have a row for each feature and a column for each window, and time comes first, so a step works on whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, texts_of
from .toxicity import held_out

#: Bytes of a window; features of each direction's state.
WINDOW, STATE = 128, 8
#: Labelled documents that are trained on, at most, and windows of each.
MOST_DOCS, WINDOWS_EACH = 2000, 2
SLICE_BYTES = 2 << 20
#: Numbers of the probabilities that are held at once.
HELD = 2 << 20
SEED = 20250402
UNKNOWN = "und"


@dataclass
class Direction:
    """Gated recurrent unit: ``inputs`` has a column for each byte, ``own`` acts on the state; rows are update, reset, candidate."""

    inputs: np.ndarray
    own: np.ndarray


@dataclass
class Model:
    """``out`` turns both directions' states into a score of each of ``labels``, beside ``bias``."""

    labels: list[str]
    forwards: Direction
    backwards: Direction
    out: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.forwards.inputs, self.forwards.own, self.backwards.inputs, self.backwards.own, self.out, self.bias]


def squash(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """A hyperbolic tangent's rational likeness, exactly -1 and 1 from -3 and 3 on: a third of its cost."""
    x = np.clip(x, -3.0, 3.0, out=out)
    square = x * x
    above = square + 27.0
    square *= 9.0
    square += 27.0
    above /= square
    return np.multiply(x, above, out=out)


def squash_slope(x: np.ndarray) -> np.ndarray:
    square = np.minimum(x * x, 9.0)
    return (9.0 - square) ** 2 / (9.0 * (3.0 + square) ** 2)


def new_model(labels: list[str], state: int = STATE, kind: type = np.float32, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)

    def direction() -> Direction:
        own = np.concatenate([np.linalg.qr(rng.standard_normal((state, state)))[0] for _ in range(3)])
        inputs = 0.3 * rng.standard_normal((3 * state, 256))
        inputs[:state] -= 1.0  # states last some positions from the start
        return Direction(inputs.astype(kind), (0.5 * own).astype(kind))

    return Model(labels, direction(), direction(), (0.3 * rng.standard_normal((len(labels), 2 * state))).astype(kind), np.zeros((len(labels), 1), kind))


def windows_of(buffer: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, beginning, length) of the windows of texts that lie in a buffer of bytes; none of an empty text."""
    counts = -(-(ends - begins) // WINDOW)
    text = np.repeat(np.arange(len(begins)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begins[text] + number * WINDOW
    return text, start, np.minimum(ends[text] - start, WINDOW)


def codes_of(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes of windows, a column each, as long as the longest; after a window's end anything."""
    at = start[None, :] + np.arange(int(length.max(initial=0)))[:, None]
    return np.take(buffer, np.minimum(at, len(buffer) - 1))


@dataclass
class Labelled:
    """Of each window: the sum of each label's probabilities, places where the label changes, the labels of the first and
    the last byte, and (if kept) those of all bytes, position by position."""

    sums: np.ndarray
    switches: np.ndarray
    first: np.ndarray
    last: np.ndarray
    every: np.ndarray | None


def label_windows(model: Model, codes: np.ndarray, length: np.ndarray, keep: bool = False) -> Labelled:
    """All positions of windows that are sorted by falling length: only those that reach a position are worked on."""
    steps, n = codes.shape
    state, count = model.forwards.own.shape[1], len(model.labels)
    reach = np.searchsorted(-length, -np.arange(steps), side="left")  # windows longer than each position
    # A gate is half of one and the squashed half of its argument, so the gates' weights are halved once.
    half = np.concatenate([np.full((2 * state, 1), 0.5), np.ones((state, 1))]).astype(np.float32)
    gates, x = np.empty((3 * state, n), np.float32), np.empty((3 * state, n), np.float32)

    def advance(inputs: np.ndarray, own: np.ndarray, h: np.ndarray, t: int) -> np.ndarray:
        m = int(reach[t])
        now, g, a = (h, gates, x) if m == n else (h[:, :m], np.empty((3 * state, m), np.float32), np.empty((3 * state, m), np.float32))
        np.take(inputs, codes[t, :m], axis=1, out=a, mode="clip")
        np.matmul(own, now, out=g)
        both, new = g[: 2 * state], g[2 * state :]
        both += a[: 2 * state]
        squash(both, out=both)
        both *= 0.5
        both += 0.5
        new *= both[state:]
        new += a[2 * state :]
        squash(new, out=new)
        new -= now
        new *= both[:state]
        now += new
        return now

    scores = np.empty((steps, count, n), np.float32)
    inputs, own, out, h = model.forwards.inputs * half, model.forwards.own * half, np.ascontiguousarray(model.out[:, :state]), np.zeros((state, n), np.float32)
    for t in range(steps):
        scores[t, :, : reach[t]] = out @ advance(inputs, own, h, t)
    inputs, own, out, h = model.backwards.inputs * half, model.backwards.own * half, np.ascontiguousarray(model.out[:, state:]), np.zeros((state, n), np.float32)
    found = Labelled(np.zeros((count, n), np.float32), np.zeros(n, np.int64), np.zeros(n, np.int16), np.zeros(n, np.int16), np.zeros((steps, n), np.int16) if keep else None)
    after = np.zeros(n, np.int16)
    for t in range(steps - 1, -1, -1):
        p = out @ advance(inputs, own, h, t)
        m = p.shape[1]
        p += scores[t, :, :m]
        p += model.bias
        best, label = p[0].copy(), np.zeros(m, np.int16)
        for k in range(1, count):
            label[p[k] > best] = k
            np.maximum(best, p[k], out=best)
        p -= best
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        found.sums[:, :m] += p
        before = int(reach[t + 1]) if t + 1 < steps else 0
        found.switches[:before] += label[:before] != after[:before]
        found.last[before:m] = label[before:]
        after[:m] = label
        if keep:
            found.every[t, :m] = label
    found.first = after
    return found


def probabilities(scores: np.ndarray) -> np.ndarray:
    """In place of the scores of each position, the labels' probabilities."""
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def _read(direction: Direction, codes: np.ndarray, there: np.ndarray, order: range) -> tuple[np.ndarray, list]:
    """(states after each position, what backpropagation needs). Where ``there`` is 0 the state stays."""
    steps, n = codes.shape
    state = direction.own.shape[1]
    h, states, kept = np.zeros((state, n), direction.own.dtype), np.empty((steps, state, n), direction.own.dtype), [None] * steps
    for t in order:
        x, g = direction.inputs[:, codes[t]], direction.own @ h
        asked = (x[: 2 * state] + g[: 2 * state]) / 2
        gates = (squash(asked) + 1) / 2
        update, reset, inner = gates[:state], gates[state:], g[2 * state :]
        wished = x[2 * state :] + reset * inner
        new = squash(wished)
        kept[t] = (h, update, reset, inner, new, squash_slope(asked) / 4, squash_slope(wished))
        h = h + there[t] * update * (new - h)
        states[t] = h
    return states, kept


def _back(direction: Direction, codes: np.ndarray, there: np.ndarray, order: range, slopes: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the loss by inputs and own weights: backpropagation through time, from those by each position's state."""
    state = direction.own.shape[1]
    steps, n = codes.shape
    by_own, by_gate = np.zeros_like(direction.own), np.empty((3 * state, steps, n), direction.own.dtype)
    later = np.zeros((state, n), direction.own.dtype)
    for t in reversed(order):
        h, update, reset, inner, new, gate_slope, new_slope = kept[t]
        d = slopes[t] + later
        masked = there[t] * d
        d_new = masked * update * new_slope
        d_inner = d_new * reset
        d_update = masked * (new - h) * gate_slope[:state]
        d_reset = d_new * inner * gate_slope[state:]
        own = np.concatenate([d_update, d_reset, d_inner])
        by_own += own @ h.T
        by_gate[:, t] = np.concatenate([d_update, d_reset, d_new])
        later = d - masked * update + direction.own.T @ own
    flat = codes.ravel()
    by_inputs = np.stack([np.bincount(flat, weights=row.ravel(), minlength=256) for row in by_gate]).astype(direction.own.dtype)
    return by_inputs, by_own


def loss_and_slopes(model: Model, codes: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log probability of the windows' labels over all positions, and its slope by each array of weights."""
    steps, n = codes.shape
    there = (np.arange(steps)[:, None] < length[None, :]).astype(model.out.dtype)
    ways = (model.forwards, range(steps)), (model.backwards, range(steps - 1, -1, -1))
    read = [_read(direction, codes, there, order) for direction, order in ways]
    states = np.concatenate([x[0] for x in read], axis=1)
    p = probabilities(model.out @ states + model.bias)
    own = p[:, label, np.arange(n)]
    total = there.sum()
    loss = -float((np.log(np.maximum(own, 1e-30)) * there).sum() / total)
    p[:, label, np.arange(n)] -= 1
    p *= (there / total)[:, None, :]
    by_state = model.out.T @ p
    half = model.forwards.own.shape[1]
    parts = [_back(direction, codes, there, order, by_state[:, a : a + half], kept) for (direction, order), (_, kept), a in zip(ways, read, (0, half), strict=True)]
    return loss, [*parts[0], *parts[1], np.einsum("tln,tsn->ls", p, states, optimize=True), p.sum(axis=(0, 2))[:, None]]


def train(windows: list[bytes], names: list[str], epochs: int = 8, batch: int = 128, rate: float = 0.03, state: int = STATE) -> Model:
    """A model of windows and their languages, by minibatches and Adam; the same for the same windows in the same order."""
    labels = sorted(set(names))
    model = new_model(labels, state)
    if len(labels) < 2:
        return model
    target, length = np.searchsorted(labels, names), np.array([len(w) for w in windows])
    buffer = np.frombuffer(b"".join(windows), np.uint8)
    start = np.cumsum(length) - length
    rng, weights = np.random.default_rng(SEED + 1), model.weights()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    rounds = epochs * max(1, -(-len(windows) // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            _, slopes = loss_and_slopes(model, codes_of(buffer, start[own], length[own]), length[own], target[own])
            size = np.sqrt(sum(float((s**2).sum()) for s in slopes))
            step += 1
            now = rate * min(1.0, step / 20) * (1 - 0.95 * step / rounds)
            for w, s, (first, second) in zip(weights, slopes, moments, strict=True):
                s = s * min(1.0, 1.0 / max(size, 1e-12))
                first += 0.1 * (s - first)
                second += 0.01 * (s**2 - second)
                w -= now * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return model


def training_windows(docs: DataFrame, most_docs: int = MOST_DOCS, each: int = WINDOWS_EACH) -> tuple[list[bytes], list[str]]:
    """(windows, their languages) of at most ``most_docs`` labelled documents that are not held out, ``each`` of a document.

    Of each language the documents of smallest hash, in turn. A doc_id with several languages counts for each; of its texts
    one is taken. The windows are anywhere in a text, by the hash of doc_id.
    """
    c = F.col
    named = docs.where(c("lang").isNotNull() & c("doc_id").isNotNull() & ~held_out()).groupBy("lang", "doc_id").agg(F.xxhash64("doc_id").alias("_h"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    chosen = cut(named.withColumn("_turn", turn).where(c("_turn") <= most_docs).orderBy("_turn", "_h", "doc_id", "lang").limit(most_docs).select("lang", "doc_id", "_h"))
    texts = docs.where(c("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            out = []
            for text, h in zip(batch.column("text").to_pylist(), batch.column("_h").to_pylist(), strict=True):
                whole = text.encode()
                starts = np.random.default_rng(h & (1 << 63) - 1).integers(0, max(1, len(whole) - WINDOW + 1), each)
                out.append([whole[s : s + WINDOW] for s in sorted(set(starts.tolist())) if whole])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "lang", "windows"])

    one = texts.mapInArrow(some, "doc_id long, lang string, windows array<binary>").groupBy("lang", "doc_id").agg(F.min("windows").alias("windows"))
    rows = sorted(one.collect(), key=lambda r: (r["lang"], r["doc_id"]))
    pairs = [(bytes(w), r["lang"]) for r in rows for w in r["windows"] if any(x >= 128 or chr(x).isalpha() for x in w)]
    return [w for w, _ in pairs], [lang for _, lang in pairs]


def fit(docs: DataFrame, most_docs: int = MOST_DOCS, epochs: int = 8) -> Model:
    """The model of the labelled rows of ``docs`` that are not held out; one without labels where there are none."""
    windows, names = training_windows(docs, most_docs)
    return train(windows, names, epochs) if windows else new_model([])


def predict(docs: DataFrame, model: Model, passing: tuple[str, ...] = ("doc_id",), keep_spans: bool = False) -> DataFrame:
    """The columns ``passing``, lang_pred, score, n_positions, n_switches (and spans: start, end in bytes and language of each
    run of one label).

    Every byte of every text is labelled; score is the mean probability of the language over them. A null text, and one
    without any letter, is ``und`` with score 0 (and no positions), and so is everything for a model without labels; with
    one label all else has that with score 1. One row for each row, repeated ones too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in passing) + ", lang_pred string, score double, n_positions long, n_switches long" + ", spans array<struct<start: long, end: long, lang: string>>" * keep_spans

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = texts_of(batch)
            lettered = np.asarray(pc.match_substring_regex(texts, r"\p{L}")) & bool(own.labels)
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = texts.buffers()[2]
            buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
            sizes = np.where(lettered, bounds[1:] - bounds[:-1], 0)
            pooled, switches, spans = _pooled(own, buffer, bounds[:-1], bounds[:-1] + sizes, keep_spans)
            best = pooled.argmax(axis=1) if own.labels else np.zeros(len(texts), np.int64)
            names = np.array([*own.labels, UNKNOWN], dtype=object)
            score = np.where(lettered, pooled.max(axis=1, initial=0.0) / np.maximum(sizes, 1), 0.0)
            columns = [*(batch.column(x) for x in passing), pa.array(names[np.where(lettered, best, -1)], pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(sizes), pa.array(switches)]
            if keep_spans:
                columns.append(pa.array([[{"start": a, "end": b, "lang": own.labels[k]} for a, b, k in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*passing, "lang_pred", "score", "n_positions", "n_switches"] + ["spans"] * keep_spans)

    return docs.select(*dict.fromkeys([*passing, "text"])).mapInArrow(predicted, schema)


def _pooled(model: Model, buffer: np.ndarray, begins: np.ndarray, ends: np.ndarray, keep_spans: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """(sum of probabilities by text and label, places where the label changes, spans by text), some windows at a time."""
    pooled, switches, spans = np.zeros((len(begins), len(model.labels))), np.zeros(len(begins), np.int64), [[] for _ in begins]
    text, start, length = windows_of(buffer, begins, ends)
    order = np.argsort(-length, kind="stable")
    each = max(64, HELD // (WINDOW * max(1, len(model.labels))))
    first, last = np.zeros(len(text), np.int16), np.zeros(len(text), np.int16)
    every: dict[int, np.ndarray] = {}
    for k in range(0, len(order), each):
        at = order[k : k + each]
        found = label_windows(model, codes_of(buffer, start[at], length[at]), length[at], keep_spans)
        np.add.at(switches, text[at], found.switches)
        first[at], last[at] = found.first, found.last
        if keep_spans:
            every.update((int(w), found.every[: length[w], j]) for j, w in enumerate(at))
        for j in range(len(model.labels)):
            pooled[:, j] += np.bincount(text[at], weights=found.sums[j], minlength=len(begins))
    np.add.at(switches, text[1:], (text[1:] == text[:-1]) & (first[1:] != last[:-1]))
    if keep_spans:
        bounds = np.searchsorted(text, np.arange(len(begins) + 1))
        for own in np.flatnonzero(np.diff(bounds)):
            whole = np.concatenate([every[w] for w in range(bounds[own], bounds[own + 1])])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(whole)) + 1, [len(whole)]])
            spans[own] = [(int(a), int(b), int(whole[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pooled, switches, spans
