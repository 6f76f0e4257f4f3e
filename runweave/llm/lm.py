"""Language-model scoring with causal self-attention in numpy, on subword ids.

Tokens are words (A-Z in lower case) and one end per document.  A word's subword ids are those of the tokenizers library for
the word after a space; a text is the sequence of its words' ids and one end.  Ids are ranked by their frequency in all
training documents, and a rank is written in DIGITS digits.  The model predicts the first digit, and each other one given
those before it: softmaxes of 15 classes each for 50,000 ids, whose product is a probability for every id; the first digit
tells whether an id begins a word.  Each softmax starts from the digits' frequencies in all training documents (one
added to each id's count) and is moved by what one block of masked self-attention and a feed-forward layer make of the ids
before.

Documents are scored in windows of CONTEXT ids that overlap by OVERLAP: each id is scored once, with at least OVERLAP ids
of context unless it stands nearer to the start; windows of many documents form one batch.  A word's probability is the
mean, with weights MIXED and 1 - MIXED, of two: its first id's probability among all ids that begin a word, times the
word's share (c + 1) / (N + V + 1) of the words with that first id, in which all unknown ones are one; and the probability
of all its ids and of another word's beginning after them, which can spell any word.

Training (Adam) starts on the driver from windows of a few documents.  From there, each task trains a copy of the model on
all windows of its training documents, each id a target once, and the copies are averaged by the numbers of ids.

Words with many occurrences, at most FREQUENT of them by a histogram of the counts, are broadcast; the counts of all others
reach the documents by a join.
"""

from __future__ import annotations

from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.common import documents, drop_table, stage_table
from runweave.llm.token_ids import binaries, encoder, slices, text_slices, vocabulary_path

CONTEXT, OVERLAP, WIDTH, HIDDEN = 16, 4, 16, 32
DIGITS = 4  # of a rank
SINGLE = 2048  # ids with embeddings of their own
FREQUENT = 131_072
MIXED = 0.9
SAMPLE, SAMPLE_WINDOWS = 600, 64  # documents, and windows of each, that the training starts from
STEPS, BATCH, RATE = 600, 192, 0.01
BLOCKS = 256  # of a step over whole texts
SCORED = 512  # windows that are scored at a time
MOST = np.float32(60)  # of a softmax's inputs, which exp() can still take


class Ranks:
    """Ids by falling frequency, those that begin a word (and the end) before all others, the digits of their ranks, and the
    digits' log shares.  The first digit tells whether an id begins a word: that is so below `starts`."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray):
        """counts: of each id, the end being the last; begins: which of them begin a word."""
        self.size, first = len(counts), int(begins.sum())
        wide = lambda b: -(-first // b ** (DIGITS - 1))
        self.base = b = next(b for b in range(2, 1 << 11) if wide(b) - (-(self.size - first) // b ** (DIGITS - 1)) <= b)
        self.starts = wide(b)
        falling = np.lexsort((np.arange(self.size), -counts))
        self.rank = np.empty(self.size, np.int32)
        self.rank[falling[begins[falling]]] = np.arange(first, dtype=np.int32)
        self.rank[falling[~begins[falling]]] = self.starts * b ** (DIGITS - 1) + np.arange(self.size - first, dtype=np.int32)
        weight = np.zeros(b**DIGITS)
        weight[self.rank] = counts + 1.0
        self.shares = []
        for level in range(DIGITS):  # of each digit, given those before it
            w = weight.reshape(b**level, b, -1).sum(axis=2)
            share = np.log(np.maximum(w, 1e-300)) - np.log(np.maximum(w.sum(axis=1, keepdims=True), 1e-300))
            self.shares.append(np.maximum(share, -80).astype(np.float32))
        # inputs: a row for each of the most frequent ids, one for each group of b * b others, one for no id
        self.rows = SINGLE + np.arange(b**DIGITS, dtype=np.int32) // (b * b)
        self.rows[self.rank[falling[:SINGLE]]] = np.arange(min(SINGLE, self.size))
        self.none = SINGLE + b ** (DIGITS - 2)


class Model:
    """One block of causal self-attention.  Parameters: embeddings of ranks (frequent ones singly, others by groups) and of
    places, query, key, value and output projections, a feed-forward layer, and for each digit the weights of its softmax
    (U0, U1, ...) and, but for the first, how the digits before it scale the state (G1, ...)."""

    def __init__(self, ranks: Ranks, seed: int = 7):
        rng, d, b = np.random.default_rng(seed), WIDTH, ranks.base
        self.ranks = ranks
        shapes = {"E": (ranks.none + 1, d), "P": (CONTEXT, d), "Q": (d, d), "K": (d, d), "V": (d, d), "O": (d, d), "A": (d, HIDDEN), "a": (HIDDEN,), "B": (HIDDEN, d), "b": (d,)}
        shapes |= {f"U{level}": (d, b) for level in range(DIGITS)} | {f"G{level}": (b**level, d) for level in range(1, DIGITS)}
        first = {"E": 0.3, "P": 0.3, "U": 0.05, "a": 0, "b": 0}
        self.p = {k: (np.ones(s) if k[0] == "G" else rng.normal(0, first.get(k[0], 1 / np.sqrt(s[0])), s)).astype(np.float32) for k, s in shapes.items()}
        self.mask = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))

    def _attend(self, x: np.ndarray, first: int):
        """Embeddings, queries, keys, values, attention and what is attended to, for windows of input rows."""
        p, own = self.p, x[:, first:]
        scaled = p["Q"] * np.asarray(1 / np.sqrt(WIDTH), p["Q"].dtype)
        rows = lambda w, x, at: np.take(p["E"] @ w, x, axis=0) + (p["P"] @ w)[at:]
        h = np.take(p["E"], own, axis=0) + p["P"][first:]
        q, k, v = rows(scaled, own, first), rows(p["K"], x, 0), rows(p["V"], x, 0)
        s = q @ k.transpose(0, 2, 1)
        np.minimum(s, MOST, out=s)
        np.exp(s, out=s)
        s *= self.mask[first:]
        if (x == self.ranks.none).any():
            s *= (x != self.ranks.none)[:, None, :]
        s *= 1 / np.maximum(s @ np.ones((s.shape[2], 1), s.dtype), np.asarray(1e-30, s.dtype))
        return h, q, k, v, s, s @ v

    def _softmaxes(self, h: np.ndarray, y: np.ndarray):
        """For states h (rows) and the ranks y that follow, digit by digit: what the softmax divides (powers of e), its sums, the
        scaled states, the digits' places in flat arrays, and the digits before each as one number; and the sum of the logarithms
        of the ranks' probabilities' parts."""
        p, b = self.p, self.ranks.base
        ones, rows, upto, left = np.ones(b, h.dtype), np.arange(len(h)) * b, [np.zeros(len(h), np.int64)], y.astype(np.int64)
        out, logs = [], np.zeros(len(h), h.dtype)
        for level in range(DIGITS):
            step = b ** (DIGITS - 1 - level)
            digit = left // step
            left = left - digit * step
            scaled = h * np.take(p[f"G{level}"], upto[-1], axis=0) if level else h
            z = scaled @ p[f"U{level}"]
            z += np.take(self.ranks.shares[level], upto[-1], axis=0) if level else self.ranks.shares[0]
            np.minimum(z, MOST, out=z)
            at = rows + digit
            logs += np.take(z.ravel(), at)
            np.exp(z, out=z)
            total = z @ ones
            logs -= np.log(total)
            out.append((z, total, scaled, at, upto[-1]))
            upto.append(upto[-1] * b + digit)
        return out, logs

    def log_probabilities(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms of probabilities, for windows of input rows x, at the places (from `first` on) that w marks, in
        order: of the ranks y, and of there being any that begins a word."""
        p = self.p
        h, *_, o = self._attend(x, first)
        at = np.flatnonzero(w[:, first:])
        h = np.take((h + o @ p["O"]).reshape(-1, WIDTH), at, axis=0)
        h = h + np.maximum(h @ p["A"] + p["a"], 0) @ p["B"] + p["b"]
        levels, logs = self._softmaxes(h, np.take(y[:, first:], at))
        z, total = levels[0][:2]
        return logs, np.log(z[:, : self.ranks.starts].sum(axis=1) / total)

    def gradients(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        """Mean loss over the places that w marks, and the parameters' gradients."""
        p, g = self.p, {}
        h0, q, k, v, s, o = self._attend(x, 0)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        at = np.flatnonzero(w)
        h1, n = flat(h0) + flat(o) @ p["O"], max(1, len(at))
        part = np.take(h1, at, axis=0)
        f = part @ p["A"] + p["a"]
        r = np.maximum(f, 0)
        h2 = part + r @ p["B"] + p["b"]
        levels, logs = self._softmaxes(h2, np.take(y, at))
        dh2 = np.zeros_like(h2)
        for level, (z, total, scaled, targets, upto) in enumerate(levels):
            z *= (1 / (n * total))[:, None]
            z.ravel()[targets] -= np.asarray(1 / n, z.dtype)
            g[f"U{level}"] = scaled.T @ z
            back = z @ p[f"U{level}"].T
            if level:
                g[f"G{level}"] = _gathered(upto, back * h2, len(p[f"G{level}"]))
                back *= np.take(p[f"G{level}"], upto, axis=0)
            dh2 += back
        g["B"], g["b"] = r.T @ dh2, dh2.sum(0)
        df = (dh2 @ p["B"].T) * (f > 0)
        g["A"], g["a"] = part.T @ df, df.sum(0)
        dh1 = np.zeros_like(h1)
        dh1[at] = dh2 + df @ p["A"].T
        g["O"] = flat(o).T @ dh1
        do = (dh1 @ p["O"].T).reshape(o.shape)
        ds, dv = do @ v.transpose(0, 2, 1), s.transpose(0, 2, 1) @ do
        ds *= s
        ds -= s * (ds @ np.ones((ds.shape[2], 1), ds.dtype))
        dq, dk = (ds @ k) * np.asarray(1 / np.sqrt(WIDTH), ds.dtype), ds.transpose(0, 2, 1) @ q
        dh0, rows = dh1, flat(h0)
        for name, d in (("Q", flat(dq)), ("K", flat(dk)), ("V", flat(dv))):
            g[name] = rows.T @ d
            dh0 = dh0 + d @ p[name].T
        g["P"] = dh0.reshape(x.shape[0], -1).sum(0).reshape(CONTEXT, WIDTH)
        g["E"] = _gathered(x.ravel(), dh0, len(p["E"]))
        return -float(logs.sum()) / n, g

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int | None = None, seed: int = 11) -> None:
        """Adam over windows drawn from those given."""
        rng, adam, steps = np.random.default_rng(seed), Adam(self), STEPS if steps is None else steps
        for t in range(1, steps + 1 if len(x) else 0):
            some = rng.integers(0, len(x), BATCH)
            adam.step(x[some], y[some], w[some], RATE * min(1, 2 * (1 - t / (steps + 1))))


def _gathered(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows by their places."""
    return np.stack([np.bincount(at, column, size) for column in np.ascontiguousarray(rows.T)], axis=1).astype(rows.dtype)


class Adam:
    """Adam for a model's parameters, which become parts of one array."""

    def __init__(self, model: Model):
        self.model, self.t = model, 0
        self.flat = np.concatenate([a.ravel() for a in model.p.values()])
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        at = 0
        for k, a in model.p.items():
            model.p[k], at = self.flat[at : at + a.size].reshape(a.shape), at + a.size

    def step(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rate: float) -> float:
        loss, g = self.model.gradients(x, y, w)
        self.t += 1
        own = np.concatenate([g[k].ravel() for k in self.model.p])
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * own
        own *= own
        own *= np.float32(0.01)
        self.v *= np.float32(0.99)
        self.v += own
        np.multiply(self.v, np.float32(1 / (1 - 0.99**self.t)), out=own)
        np.sqrt(own, out=own)
        own += np.float32(1e-8)
        np.divide(self.m, own, out=own)
        own *= np.float32(rate / (1 - 0.9**self.t))
        self.flat -= own
        return loss


class Learner:
    """Trains a model on every block of the sequences it is given, each once, in batches of mixed blocks."""

    def __init__(self, model: Model, seed: int = 13):
        self.model, self.adam, self.rng, self.rest, self.learnt = model, Adam(model), np.random.default_rng(seed), None, 0

    def _step(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        t = self.adam.t + 1
        self.adam.step(x, y, w, RATE * min(1, t / 20) / np.sqrt(1 + t / 100))
        self.learnt += int(w.sum())

    def learn(self, sequences: list[np.ndarray], last: bool = False) -> None:
        if sequences:
            new = blocks(self.model.ranks, sequences)
            self.rest = new if self.rest is None else tuple(map(np.concatenate, zip(self.rest, new)))
        if self.rest is None:
            return
        order = self.rng.permutation(len(self.rest[0]))
        full = len(order) if last else len(order) // BLOCKS * BLOCKS
        for at in range(0, full, BLOCKS):
            self._step(*(p[order[at : min(at + BLOCKS, full)]] for p in self.rest))
        self.rest = tuple(p[order[full:]] for p in self.rest) if full < len(order) else None


def _cut(ranks: Ranks, sequences: list[np.ndarray], step: int, wide: int, lead: int):
    """Inputs, targets and marks of sequences of ranks (each with its end), each after an end, in windows of `wide` places at
    multiples of `step` of what begins with `lead` empty places; and the windows of each."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    counts = -(-(sizes + (0 if step < wide else lead)) // step)
    spans = counts * step + (wide - step)
    starts = np.cumsum(spans) - spans
    x, y, w = np.full(int(spans.sum()), ranks.none, np.int32), np.zeros(int(spans.sum()), np.int32), np.zeros(int(spans.sum()), bool)
    at = np.repeat(starts + lead - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    flat = np.concatenate(sequences).astype(np.int32)
    y[at], w[at] = flat, True
    ends = np.cumsum(sizes)
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[ends - sizes] = ranks.rank[-1]  # a text begins after an end
    x[at] = ranks.rows[before]
    first = np.repeat(starts - (np.cumsum(counts) - counts) * step, counts) + np.arange(int(counts.sum())) * step
    places = first[:, None] + np.arange(wide)
    return x[places], y[places], w[places], counts


def blocks(ranks: Ranks, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of ranks, each with its end, in blocks that don't overlap: input rows, targets, and which places count."""
    return _cut(ranks, sequences, CONTEXT, CONTEXT, OVERLAP)[:3]


def windows(ranks: Ranks, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same in overlapping windows; each target is marked in exactly one, in its order.  And the windows of each sequence."""
    x, y, w, counts = _cut(ranks, sequences, CONTEXT - OVERLAP, CONTEXT, OVERLAP)
    w[:, :OVERLAP] = False
    return x, y, w, counts


def id_scores(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each rank of the sequences, one after the other, and of there being one that begins a word; each
    sequence has its end."""
    if not sequences:
        return np.zeros(0), np.zeros(0)
    x, y, w, _ = windows(model.ranks, sequences)
    per = [model.log_probabilities(x[at : at + SCORED], y[at : at + SCORED], w[at : at + SCORED], OVERLAP) for at in range(0, len(x), SCORED)]
    return tuple(np.concatenate(p).astype(np.float64) / np.log(10) for p in zip(*per))


def word_probabilities(model: Model, sequences: list[np.ndarray], per: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10, for the words (each of per ids) and ends of all sequences: of a word's first id where a word begins, less the
    norm of that id; and of all its ids there, and of another word's beginning after them."""
    (by_id, start), first = id_scores(model, sequences), np.cumsum(per) - per
    ids = np.concatenate(sequences)
    onward = np.append(start[first[1:]], 0.0)
    onward[ids[first] == model.ranks.rank[-1]] = 0.0  # nothing follows an end
    own = by_id[first] - start[first]
    return own - norms[ids[first]], np.add.reduceat(by_id, first) - start[first] + onward


def context_scores(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence."""
    sizes = np.array([len(s) for s in sequences])
    return np.add.reduceat(id_scores(model, sequences)[0], np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 7 == 2


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of all texts one after the other, and how many each has, by Arrow."""
    listed = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, counts = pc.list_flatten(listed), np.asarray(pc.list_value_length(listed)).astype(np.int64)
    some = np.asarray(pc.greater(pc.binary_length(flat), 0))
    rows = np.repeat(np.arange(len(counts)), counts)[some]
    return flat.filter(pa.array(some)), np.bincount(rows, minlength=len(counts))


def word_counts(train: DataFrame, path: str, text: str = "text") -> DataFrame:
    """word (a line feed stands for the end), n and its first id, over all rows."""

    def count(batches):
        for batch in batches:
            for part in text_slices(batch, 0):
                words, _ = _words(part.column(0))
                met = pc.value_counts(words)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([met.field(0), pa.array(["\n"])]), pa.concat_arrays([met.field(1), pa.array([part.num_rows], pa.int64())])], names=["word", "n"])

    def with_id(batches):
        tool = encoder(path)
        for batch in batches:
            ids, sizes = tool.encode_words(batch.column(0).dictionary_encode())
            first = ids[np.cumsum(sizes) - sizes].astype(np.int32) if len(sizes) else np.zeros(0, np.int32)
            first[np.asarray(pc.equal(batch.column(0), "\n"))] = tool.size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], names=["word", "n", "first"])

    counts = train.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stage_table(counts.mapInArrow(with_id, "word string, n long, first int"), "word-counts")


def encoded(df: DataFrame, path: str, learn, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, k (the key), learn, t (the text), ids (of its words, and the end's after them) and sizes (ids of each word) of each
    row; each task's last row has a null for learn and, as ids, how often the rows to learn from have each id, as 64-bit
    integers."""

    def run(batches):
        tool = encoder(path)
        met = np.zeros(tool.size + 1, np.int64)
        end = np.array([tool.size], tool.dtype)
        for batch in batches:
            for part in text_slices(batch, 3):
                words, counts = _words(part.column(3))
                ids, sizes = tool.encode_words(words.dictionary_encode())
                ends = np.cumsum(counts)
                at = np.concatenate([[0], np.cumsum(sizes)])
                n = at[ends] - at[ends - counts]
                ids = np.insert(ids, np.cumsum(n), end)
                learnt = np.asarray(part.column(2).cast(pa.uint8())).astype(bool)
                met += np.bincount(ids[np.repeat(learnt, n + 1)], minlength=len(met))
                own = [binaries(ids, n + 1), binaries(sizes.astype("<u4"), counts)]
                for row in range(0, part.num_rows, 256):
                    yield pa.RecordBatch.from_arrays([*part.slice(row, 256).columns, *(c.slice(row, 256) for c in own)], names=["rid", "k", "learn", "t", "ids", "sizes"])
        none = [pa.array([None], kind) for kind in (pa.int64(), pa.int64(), pa.bool_(), pa.string())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([met.tobytes()], pa.binary()), pa.array([None], pa.binary())], names=["rid", "k", "learn", "t", "ids", "sizes"])

    # the row numbers are written down with what belongs to them, so a lost executor can't change them between two reads
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("k"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("t"))
    return stage_table(rows.mapInArrow(run, "rid long, k long, learn boolean, t string, ids binary, sizes binary"), "encoded")


def id_counts(coded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in what is learnt from, out of the tasks' own counts: at most a row per id reaches the driver."""

    def split(batches):
        for batch in batches:
            for x in batch.column(0):
                met = np.frombuffer(x.as_buffer(), np.int64)
                some = np.flatnonzero(met)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(met[some], pa.int64())], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in coded.filter("learn IS NULL").select("ids").mapInArrow(split, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def _sequences(column: pa.Array, ranks: Ranks, dtype: np.dtype) -> list[np.ndarray]:
    return [ranks.rank[np.frombuffer(x.as_buffer(), dtype)] for x in column]


def start_model(train: DataFrame, ranks: Ranks, dtype: np.dtype, sample: int = SAMPLE) -> Model:
    """A model fitted to windows of the `sample` training documents whose keys hash lowest: SAMPLE_WINDOWS of each at most, spread
    over the whole document.  Only where training begins: fit_model() goes on through everything."""

    def some(batches):
        for batch in batches:
            for part in slices(batch):
                for r, seq in enumerate(_sequences(part.column(1), ranks, dtype)):
                    x, y, w = blocks(ranks, [seq])
                    at = np.unique(np.linspace(0, len(x) - 1, SAMPLE_WINDOWS).astype(int))
                    raw = [pa.array([a[at].astype(np.int32).tobytes()], pa.binary()) for a in (x, y, w)]
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(r, 1), *raw], names=["h", "x", "y", "w"])

    keyed = train.select(F.xxhash64("k", "t").alias("h"), "ids")
    chosen = [r["h"] for r in keyed.select("h").orderBy("h").limit(sample).collect()]
    model = Model(ranks)
    found = keyed.filter(F.col("h").isin(chosen)).mapInArrow(some, "h long, x binary, y binary, w binary").orderBy("h").limit(sample).collect() if chosen else []
    if found:
        x, y, w = (np.concatenate([np.frombuffer(r[c], np.int32) for r in found]).reshape(-1, CONTEXT) for c in "xyw")
        model.fit(x, y, w.astype(bool))
    return model


def fit_model(train: DataFrame, ranks: Ranks, dtype: np.dtype) -> Model:
    """A model trained on all of every training document.  Each task goes on from start_model() through all its documents;
    the mean of the tasks' parameters, by the numbers of targets, is the model.  Only sums per parameter reach the driver."""
    model = start_model(train, ranks, dtype)
    shared = train.sparkSession.sparkContext.broadcast((model.p, ranks))

    def learn(batches):
        params, ranks = shared.value
        own = Model(ranks)
        own.p = {k: a.copy() for k, a in params.items()}
        learner = Learner(own)
        for batch in batches:
            for part in slices(batch, 128):
                learner.learn(_sequences(part.column(0), ranks, dtype))
        learner.learn([], last=True)
        if learner.learnt:
            flat = np.concatenate([a.ravel() for a in own.p.values()]).astype(np.float64) * learner.learnt
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1), pa.int32()), pa.array(np.append(flat, learner.learnt), pa.float64())], names=["at", "part"])

    sums = train.select("ids").mapInArrow(learn, "at int, part double").groupBy("at").agg(F.sum("part").alias("sum")).toArrow()
    if sums.num_rows:
        flat = np.asarray(sums["sum"])[np.argsort(np.asarray(sums["at"]))]
        flat = (flat[:-1] / flat[-1]).astype(np.float32)
        for k, a in model.p.items():
            model.p[k], flat = flat[: a.size].reshape(a.shape), flat[a.size :]
    shared.unpersist()
    return model


def score_documents(df: DataFrame, path: str, learn, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score for every row of `df`, learning from the rows that `learn` (a
    boolean column; null is false) marks.

    A null text is one end; null keys and repeated rows stay as they are; without rows to learn from all words are unknown, N
    is 0 and all ids are equally frequent; an empty df gives an empty result; other columns are not looked at."""
    spark, tool = df.sparkSession, encoder(path)
    size, dtype = tool.size + 1, tool.dtype
    if size > np.iinfo(dtype).max + 1:
        raise ValueError("the vocabulary leaves no id for the end")
    counts = word_counts(df.filter(learn), path, text)
    by_first = {r["first"]: (r["n"], r["v"]) for r in counts.groupBy("first").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n, v = sum(x for x, _ in by_first.values()), sum(x for _, x in by_first.values())
    base = log10(n + v + 1)
    # the least count for which at most FREQUENT words remain, from a histogram of a few hundred rows
    steps = F.floor(F.log2("n") * 16).cast("int")
    least, room = None, FREQUENT
    for r in counts.groupBy(steps.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        room -= r["words"]
        if room < 0:
            break
        least = r["least"]
    top = counts.filter(F.col("n") >= (least or 1 << 62)).toArrow()
    order = dict(zip(top["word"].to_pylist(), range(top.num_rows)))
    logs = np.append(np.log10(np.asarray(top["n"], dtype=np.float64) + 1), 0.0)

    coded = encoded(df, path, learn, key, text)
    ranks = Ranks(id_counts(coded, size), np.append(tool.begins(), True))
    model = fit_model(coded.filter("learn"), ranks, dtype)
    norms = np.zeros(len(ranks.rows))
    for first, both in by_first.items():
        norms[ranks.rank[first]] = log10(sum(both) + 1)
    shared = spark.sparkContext.broadcast((order, logs, norms, model.p, ranks))

    def score(batches):
        order, logs, norms, params, ranks = shared.value
        model = Model(ranks)
        model.p = params
        end = order.get("\n", -1)
        for batch in batches:
            for part in slices(batch, 256):
                words, sizes = _words(part.column(2))
                coded, rows = words.dictionary_encode(), part.num_rows
                kinds = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
                places = np.fromiter((order.get(x, -1) for x in kinds), np.int64, len(kinds))[np.asarray(coded.indices)]
                # words and ends in their order, by row; and the ids of each
                row = np.repeat(np.arange(rows), sizes + 1)
                ends = np.cumsum(sizes + 1) - 1
                place = np.full(len(row), end)
                inner = np.ones(len(row), bool)
                inner[ends] = False
                place[inner] = places
                per = np.ones(len(row), np.int64)
                per[inner] = np.frombuffer(b"".join(part.column(4).to_pylist()), "<u4")
                begins, spelt = word_probabilities(model, _sequences(part.column(3), ranks, dtype), per, norms)
                often = place >= 0
                known = logs[place]
                score = np.where(often | ~inner, np.log10(MIXED * 10 ** (begins + known) + (1 - MIXED) * 10**spelt), 0.0)
                rare = np.flatnonzero(~often & inner)
                codes = np.zeros(len(row), np.int64)
                codes[inner] = np.asarray(coded.indices)
                sums = [np.bincount(row, x, rows) for x in (often, known, score)]
                rids, b = part.column(0), len(rare)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([rids, rids.take(pa.array(row[rare]))]), pa.concat_arrays([part.column(1), pa.nulls(b, pa.int64())]), pa.concat_arrays([pa.nulls(rows, pa.string()), coded.dictionary.take(pa.array(codes[rare])).cast(pa.string())]),
                        pa.array(np.concatenate([sizes + 1, np.zeros(b, np.int64)])), pa.array(np.concatenate([sums[0].astype(np.int64), np.zeros(b, np.int64)])), pa.array(np.concatenate([sums[1], np.zeros(b)])), pa.array(np.concatenate([sums[2], spelt[rare]])), pa.array(np.concatenate([np.zeros(rows), begins[rare]])),
                    ],
                    names=["rid", "k", "word", "n_tokens", "known", "logs", "score", "begins"],
                )

    numbered = coded.filter("learn IS NOT NULL").select("rid", "k", "t", "ids", "sizes")
    scored = stage_table(numbered.mapInArrow(score, "rid long, k long, word string, n_tokens long, known long, logs double, score double, begins double"), "scored")
    drop_table(coded)
    less = counts.filter(F.col("n") < (least or 1 << 62)).select("word", F.col("n").alias("c"))
    c = F.coalesce(F.col("c"), F.lit(0)) + 1
    mix = F.log10(F.lit(MIXED) * c * F.pow(F.lit(10.0), "begins") + F.lit(1 - MIXED) * F.pow(F.lit(10.0), "score"))
    found = scored.filter("word IS NOT NULL").select("rid", "word", "score", "begins").join(less, "word", "left")
    found = found.groupBy("rid").agg(F.count("c").alias("more"), F.sum(F.log10(c)).alias("more_logs"), F.sum(mix).alias("more_score"))
    rows = scored.filter("word IS NULL").join(found, "rid", "left")
    more = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0.0))
    return rows.select(
        F.col("k").alias(key), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (more("logs", "more_logs") - F.col("n_tokens") * F.lit(base)).alias("base_score"), more("score", "more_score").alias("score"),
    )


def op10_score(spark, sf_dir):
    """Scores of all documents, learnt from those that aren't held out."""
    out = score_documents(documents(spark, sf_dir), vocabulary_path(), ~held_out())
    return out.withColumn("held_out", held_out()).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
