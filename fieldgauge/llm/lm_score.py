"""Language-model scores: a gated recurrent network over word classes, and word counts inside each class.

P(word | before) = P(class | before) * P(word | class). The class of a word follows from its last bytes alone; the end of a text is a
class of its own. The network (a GRU in numpy) reads the classes so far and gives the next one by a softmax; its state is carried
through the whole text, window after window, and begins anew with each text. Inside a class a word has (c + 0.1) / (N_k + 0.1 (V_k + 1)),
of the class's N_k training tokens and V_k words, which leaves one share for unknown words, so a text's probability is proper.

Learning: every task counts the words of its training texts and runs truncated backpropagation over all of them, starting from one
common network (trained on excerpts of at most ``warm_docs`` training texts, a documented bound); the network used is the mean over
tasks, weighted by tokens. Counts are of all training texts. Words of at most ``frequent`` highest counts are broadcast (16 bytes each);
the others meet their counts in a join by word.

Defined results: a null or empty text is one token, its end; a null doc_id counts as the empty one for the held-out rule; equal rows
are scored alike and each counts in learning; without training texts the network is the untrained one; an empty table gives no rows;
further columns are not read.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mixed, words
from .store import added, written

CLASSES, HIDDEN, WINDOW, LANES, PIECE = 64, 16, 32, 256, 1024


def class_sequences(texts):
    """For some texts at a time: word hashes, word classes (1 to CLASSES - 1), and each text's first word and the end."""
    for w in words(texts, group_bytes=8_000_000):
        code = np.zeros(len(w.end), np.uint64)
        for back in (1, 2, 3):
            at = w.end - back
            code = code * np.uint64(257) + np.where(at >= w.start, w.data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        found = w.hash, (mixed(code) % np.uint64(CLASSES - 1) + np.uint64(1)).astype(np.uint8), w.word_at
        del w, code, at  # the bytes and places are not needed while the caller works
        yield found


@dataclass
class Net:
    x: np.ndarray   # CLASSES x 3H: what an input class adds to the gates update, reset and to the candidate
    u: np.ndarray   # H x 3H
    c: np.ndarray   # H: bias of the state's part of the candidate
    v: np.ndarray   # H x CLASSES
    b: np.ndarray   # CLASSES

    NAMES = ("x", "u", "c", "v", "b")

    @classmethod
    def fresh(cls, seed: int = 11) -> Net:
        r, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *s: (r.standard_normal(s) * 0.15).astype(np.float32)
        return cls(draw(CLASSES, 3 * h), draw(h, 3 * h), np.zeros(h, np.float32), draw(h, CLASSES), np.zeros(CLASSES, np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    @classmethod
    def of(cls, flat: np.ndarray) -> Net:
        like, out, at = cls.fresh(), [], 0
        for n in cls.NAMES:
            a = getattr(like, n)
            out.append(flat[at:at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return cls(*out)


def lanes_of(classes: np.ndarray, word_at: np.ndarray):
    """Lay texts end to end in lanes of about equal length, longest lane first; a very long text makes lanes fewer, not longer.

    Gives inputs, targets and starts (all time x lanes), the number of lanes that reach each time, and each text's lane and time.
    """
    size = np.diff(word_at) + 1
    many = int(min(LANES, len(size), max(1, size.sum() // size.max())))
    heap = [(0, k) for k in range(many)]
    lane, begin = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    for i in np.argsort(-size, kind="stable").tolist():
        used, k = heapq.heappop(heap)
        lane[i], begin[i] = k, used
        heapq.heappush(heap, (used + int(size[i]), k))
    length = np.zeros(many, np.int64)
    for used, k in heap:
        length[k] = used
    order = np.argsort(-length, kind="stable")
    rank = np.empty(many, np.int64)
    rank[order] = np.arange(many)
    lane, length = rank[lane], length[order]
    inputs, targets = np.zeros((int(length[0]), many), np.uint8), np.zeros((int(length[0]), many), np.uint8)
    text = np.repeat(np.arange(len(size)), size - 1)
    time = begin[text] + np.arange(len(classes)) - word_at[text]
    targets[time, lane[text]] = classes
    inputs[time + 1, lane[text]] = classes
    starts = np.zeros(inputs.shape, bool)
    starts[begin, lane] = True
    return inputs, targets, starts, np.searchsorted(-length, -np.arange(length[0]), "left"), lane, begin


def _sigmoid(a):
    return 0.5 + 0.5 * np.tanh(0.5 * a)


def _forward(net: Net, inputs, starts, active, state, keep: bool):
    """One window: the states after each step, and what backpropagation needs."""
    h, n0, past = HIDDEN, int(active[0]), []
    state = state[:n0]
    states = np.zeros((len(inputs), n0, h), np.float32)
    for t in range(len(inputs)):
        n = int(active[t])
        before = state[:n] * ~starts[t, :n, None]
        gate, own = net.x[inputs[t, :n]], before @ net.u
        zr = _sigmoid(gate[:, :2 * h] + own[:, :2 * h])
        z, r = zr[:, :h], zr[:, h:]
        side = own[:, 2 * h:] + net.c
        new = np.tanh(gate[:, 2 * h:] + r * side)
        state = new + z * (before - new)
        states[t, :n] = state
        if keep:
            past.append((before, z, r, side, new))
    return states, past


def _log_softmax(net: Net, states):
    a = states.reshape(-1, HIDDEN) @ net.v + net.b
    a -= a.max(1, keepdims=True)
    return a - np.log(np.exp(a).sum(1, keepdims=True))


class Learner:
    """Truncated backpropagation with Adam steps, one for each window of time."""

    def __init__(self, net: Net, rate: float = 0.01):
        self.net, self.rate, self.steps, self.tokens = net, rate, 0, 0
        self.first = {n: np.zeros_like(getattr(net, n)) for n in Net.NAMES}
        self.second = {n: np.zeros_like(getattr(net, n)) for n in Net.NAMES}

    def learn(self, classes: np.ndarray, word_at: np.ndarray) -> None:
        """Learn from whole texts; what is longer than ``PIECE`` words is learned from in pieces, so that many lanes stay full."""
        size = np.diff(word_at)
        cuts = np.maximum(1, -(-size // PIECE))
        text = np.repeat(np.arange(len(size)), cuts)
        place = word_at[text] + PIECE * (np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        word_at = np.append(place, word_at[-1])
        inputs, targets, starts, active, _, _ = lanes_of(classes, word_at)
        state = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for t in range(0, len(inputs), WINDOW):
            part = slice(t, t + WINDOW)
            states, past = _forward(self.net, inputs[part], starts[part], active[part], state, True)
            self._step(inputs[part], targets[part], starts[part], active[part], states, past)
            state = states[-1]
        self.tokens += len(classes) + len(word_at) - 1

    def _step(self, inputs, targets, starts, active, states, past):
        net, h, n0 = self.net, HIDDEN, int(active[0])
        real = np.arange(n0)[None, :] < np.asarray(active)[:, None]
        error = np.exp(_log_softmax(net, states))
        error[np.arange(len(error)), targets[:, :n0].ravel()] -= 1
        error *= (real.ravel() / real.sum())[:, None].astype(np.float32)
        grads = {"v": states.reshape(-1, h).T @ error, "b": error.sum(0), "u": np.zeros_like(net.u), "c": np.zeros_like(net.c)}
        back = (error @ net.v.T).reshape(states.shape)
        gates = np.zeros((*states.shape[:2], 3 * h), np.float32)
        ahead = np.zeros((0, h), np.float32)
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, side, new = past[t]
            d = back[t, :len(z)]
            d[:len(ahead)] += ahead
            dn = d * (1 - z) * (1 - new * new)
            ds = dn * r
            g = gates[t, :len(z)]
            g[:, :h] = d * (before - new) * z * (1 - z)
            g[:, h:2 * h] = dn * side * r * (1 - r)
            g[:, 2 * h:] = dn
            own = np.concatenate((g[:, :2 * h], ds), 1)
            grads["u"] += before.T @ own
            grads["c"] += ds.sum(0)
            ahead = (own @ net.u.T + d * z) * ~starts[t, :len(z), None]
        flat, hot = inputs[:, :n0].ravel(), gates.reshape(-1, 3 * h)
        one = np.zeros((len(flat), CLASSES), np.float32)
        one[np.arange(len(flat)), flat] = 1
        grads["x"] = one.T @ hot
        self.steps += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / max(size, 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
        for n, g in grads.items():
            g = g * scale
            self.first[n] += 0.1 * (g - self.first[n])
            self.second[n] += 0.001 * (g * g - self.second[n])
            getattr(net, n)[...] -= (rate * self.first[n] / (np.sqrt(self.second[n]) + 1e-6)).astype(np.float32)


def class_scores(net: Net, classes: np.ndarray, word_at: np.ndarray, prior: np.ndarray, share: float = 0.02) -> np.ndarray:
    """log10 probability of each text's class sequence, its end included; ``share`` of it is the classes' overall frequency."""
    if len(word_at) < 2:
        return np.zeros(0)
    inputs, targets, starts, active, lane, begin = lanes_of(classes, word_at)
    state, total = np.zeros((inputs.shape[1], HIDDEN), np.float32), np.zeros((len(inputs) + 1, inputs.shape[1]))  # as many numbers as words, as lanes are full
    for t in range(0, len(inputs), WINDOW):
        part = slice(t, t + WINDOW)
        states, _ = _forward(net, inputs[part], starts[part], active[part], state, False)
        n0, state = states.shape[1], states[-1]
        said = targets[part, :n0].ravel()
        p = np.exp(_log_softmax(net, states)[np.arange(len(said)), said].astype(np.float64))
        total[t + 1:t + 1 + len(states), :n0] = np.log10((1 - share) * p + share * prior[said]).reshape(len(states), n0)
    np.cumsum(total, axis=0, out=total)
    return total[begin + np.diff(word_at) + 1, lane] - total[begin, lane]


def held_out(n: int = 10):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n == 0


def gather(docs: DataFrame, warm_docs: int = 256, warm_chars: int = 4096) -> tuple[Net, DataFrame]:
    """The mean network, and the counts (word, class, count) of all training texts."""
    spark = docs.sparkSession
    train = docs.where(~held_out()).select("doc_id", "text")
    # about four times as many as are wanted are drawn by hash, so that few excerpts travel whatever the number of tasks
    draw, n = F.xxhash64(F.lit("warm"), "doc_id"), max(1, train.count())
    some = (train.where("text IS NOT NULL").where(F.pmod(draw, F.lit(1_000_000_000)) < int(1e9 * min(1.0, 4 * warm_docs / n)))
            .orderBy(draw, "doc_id").limit(warm_docs).select(F.substring("text", 1, warm_chars)).collect())
    warm = Learner(Net.fresh())
    for _ in range(8 if some else 0):
        for _, classes, word_at in class_sequences([r[0] for r in some]):
            warm.learn(classes, word_at)
    first = spark.sparkContext.broadcast(warm.net.flat())

    def work(batches):
        import pyarrow as pa
        learner = Learner(Net.of(first.value), rate=0.004)

        def rows(kind, key, cls, value):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(cls), pa.array(value)], names=["kind", "key", "class", "value"])

        for b in batches:
            for h, classes, word_at in class_sequences(b.column("text").to_pylist()):
                learner.learn(classes, word_at)
                word, at, n = np.unique(h, return_index=True, return_counts=True)
                yield rows(0, word.view(np.int64), classes[at].astype(np.int32), n.astype(np.float64))
        flat = learner.net.flat().astype(np.float64) * learner.tokens
        if learner.tokens:
            yield rows(1, np.arange(len(flat) + 1), np.zeros(len(flat) + 1, np.int32), np.append(flat, learner.tokens))

    found = written(train.select("text").mapInArrow(work, "kind byte, key long, class int, value double"), "gathered")
    means = found.where("kind = 1").groupBy("key").agg(F.sum("value").alias("value")).orderBy("key").collect()
    values = np.array([r["value"] for r in means])
    net = Net.of(values[:-1] / values[-1]) if len(values) else Net.of(first.value)
    counts = found.where("kind = 0").groupBy(F.col("key").alias("word"), "class").agg(F.sum("value").cast("long").alias("n"))
    return net, written(counts, "word-counts")


def _often(counts: DataFrame, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """The words above the lowest count that at most ``frequent`` words reach, in order, and their counts."""
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in steps:
        total += r["many"]
        if total > frequent:
            break
        least = r["step"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = counts.where(F.floor(F.log2("n") * 16) >= least).select("word", "n").toArrow()
    word, n = found.column("word").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(word)
    return word[order], n[order]


def lm_scores(docs: DataFrame, frequent: int = 262_144) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    net, counts = gather(docs)
    by_class = {r["class"]: (r["tokens"], r["words"]) for r in counts.groupBy("class").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).collect()}
    ends = docs.where(~held_out()).count()
    if ends:
        by_class[0] = (ends, 1)
    tokens = np.array([by_class.get(k, (0, 0))[0] for k in range(CLASSES)], float)
    types = np.array([by_class.get(k, (0, 0))[1] for k in range(CLASSES)], float)
    unknown = (np.arange(CLASSES) > 0) | (ends == 0)  # the end's class has no unknown word once there is an end
    inside = np.log10(tokens + 0.1 * (types + unknown))
    n_all, v_all = int(tokens.sum()), int(types.sum())
    whole = float(np.log10(n_all + 0.1 * (v_all + 1)))
    prior = (tokens + 1) / (tokens + 1).sum()
    shared = spark.sparkContext.broadcast((net, *_often(counts, frequent), inside, prior, ends))

    def start():
        net, often, often_n, inside, prior, ends = shared.value
        logs = np.log10(often_n + 0.1)
        end_log = float(np.log10(ends + 0.1))

        def work(texts):
            out = {k: [] for k in ("n_tokens", "model", "known", "logs", "rare", "rare_n")}
            for h, classes, word_at in class_sequences(texts):
                n = np.diff(word_at)
                model = class_scores(net, classes, word_at, prior)
                norm = np.concatenate(([0.0], np.cumsum(inside[classes])))
                model = model - (norm[word_at[1:]] - norm[word_at[:-1]]) - inside[0]
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
                hit = often[at] == h if len(often) else np.zeros(len(h), bool)
                some = np.concatenate(([0], np.cumsum(hit)))
                sums = np.concatenate(([0.0], np.cumsum(np.where(hit, logs[at], 0.0) if len(often) else np.zeros(len(h)))))
                out["n_tokens"] += (n + 1).tolist()
                out["model"] += model.tolist()
                out["known"] += (some[word_at[1:]] - some[word_at[:-1]] + (ends > 0)).tolist()
                out["logs"] += (sums[word_at[1:]] - sums[word_at[:-1]] + end_log).tolist()
                for a, z in zip(word_at[:-1], word_at[1:]):
                    word, many = np.unique(h[a:z][~hit[a:z]], return_counts=True)
                    out["rare"].append(word)
                    out["rare_n"].append(many)
            return out
        return work

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    parts = added(rows, "n_tokens long, model double, known long, logs double, rare array<bigint>, rare_n array<bigint>", start, ["text"], ("text",))
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "score-parts")
    rare = parts.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("many"))
    # (c + 0.1) / 0.1 in logs: a word without a count adds nothing here and 0.1 below
    met = rare.join(counts.select("word", "n"), "word").groupBy("row").agg(F.sum(F.col("many") * F.log10((F.col("n") + 0.1) / 0.1)).alias("more"), F.sum("many").alias("met"))
    out = parts.select("row", "doc_id", "held_out", "n_tokens", "model", "known", "logs", F.aggregate("rare_n", F.lit(0).cast("long"), lambda s, x: s + x).alias("others")).join(met, "row", "left")
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("others")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
                      (logs - F.col("n_tokens") * whole).alias("base_score"), (F.col("model") + logs).alias("score"))
