"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated from labelled rows.

Every whole text gives some counts; rows with too few words or too much repetition fail at once. The shares made of the
counts are points for the forest: trees of random splits over small samples, in which unusual points end after few splits.
A split's statistic is drawn with a chance that follows how far the labelled good and bad rows differ in it, so that statistics
which say nothing about quality (digits in a list of numbers, say) do not make a document unusual.
The forest is grown from at most about ``sample_rows`` good rows (a documented bound; chosen by a hash of doc_id), or from any such sample where
no row is labelled good; as many bad rows help to weigh the statistics. All labelled rows give the range of the cuts, and all are scored for
the threshold. A row is rejected if its score is above the threshold: the lowest score at which no more than ``clean_loss`` of the
labelled good rows are rejected, or midway to the bad rows' scores where the two are apart.

Defined results: a null or empty text has no words and fails; a null doc_id is judged by its text; equal rows are judged
alike; a label without quality is no label, and of several for one doc_id the lowest holds; empty tables give no rows, or no
calibration (threshold ``default_threshold``); further columns are carried along by ``judge``, whose own columns win.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import per_text, runs, words
from .store import added, written

_SYMBOLS, _CAPITALS, _SMALL, _MARKS, _DIGITS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (
    b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)), b"!?;:\"'()[]{}=+/\\^~_@", b"0123456789"))
_LEADS = (np.arange(256) & 0xC0) != 0x80
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["symbols", "dup_lines", "repeats", "capitals", "marks", "digits", "echoes"]


def counts(texts: pd.Series, window: int = 8) -> pd.DataFrame:
    """The counts and shares of each text."""
    out = []
    for w in words(texts, lower=False):
        n = w.counts
        in_word = np.zeros(len(w.data) + 1, np.int8)
        in_word[w.start] += 1
        in_word[w.end] -= 1
        inside = np.cumsum(in_word[:-1]).astype(bool)
        h, at = runs(w, window)
        text = w.text_of_word()
        key = h ^ text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + window, -1)
        repeated = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
        echo = np.zeros(len(text), bool)
        echo[1:] = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
        echoes = np.concatenate(([0], np.cumsum(echo)))
        lines = np.zeros((len(n), 2), np.int64)
        for i in range(len(n)):
            t = texts.iloc[w.first + i]
            full = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")] if t else []
            lines[i] = len(full), len(full) - len(set(full))
        letters = per_text(w, (_CAPITALS | _SMALL)[w.data])
        symbols = per_text(w, _SYMBOLS[w.data])
        repeats, some = np.diff(repeated[w.word_at]), np.maximum(n, 1)
        out.append(pd.DataFrame({
            "n_words": n, "word_chars": per_text(w, inside & _LEADS[w.data]), "n_symbols": symbols, "n_dup_lines": lines[:, 1], "n_repeat_words": repeats,
            "symbols": np.minimum(symbols / some, 4.0), "dup_lines": lines[:, 1] / np.maximum(lines[:, 0], 1), "repeats": repeats / some,
            "capitals": per_text(w, _CAPITALS[w.data]) / np.maximum(letters, 1), "marks": np.minimum(per_text(w, _MARKS[w.data]) / some, 4.0),
            "digits": np.minimum(per_text(w, _DIGITS[w.data]) / some, 4.0), "echoes": np.diff(echoes[w.word_at]) / some}))
    frame = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=COUNTS + SHARES)
    return frame.astype({**dict.fromkeys(COUNTS, "int64"), **dict.fromkeys(SHARES, "float64")})


@dataclass
class Forest:
    """Trees as arrays over nodes: feature (-1: leaf), cut, left child (right is next), depth plus the leaf's mean depth."""
    trees: list
    norm: float

    @staticmethod
    def _mean_depth(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @classmethod
    def grow(cls, points: np.ndarray, box: np.ndarray, chances: np.ndarray, trees: int = 200, size: int = 256, seed: int = 7) -> Forest:
        """Cuts are drawn over each node's part of the ``box`` (lowest and highest values), so that regions which hold no
        point end early as well."""
        draw, out = np.random.default_rng(seed), []
        size = min(size, len(points))
        limit = int(np.ceil(np.log2(max(size, 2))))
        for _ in range(trees if size else 0):
            nodes, open_ = [[-1, 0.0, -1, 0.0]], [(0, points[draw.choice(len(points), size, replace=False)], 0, box[0].copy(), box[1].copy())]
            while open_:
                at, rows, depth, low, high = open_.pop()
                wide = np.flatnonzero(high > low)
                if depth >= limit or len(rows) < 2 or not len(wide):
                    nodes[at][3] = depth + cls._mean_depth(len(rows))
                    continue
                f = int(draw.choice(wide, p=chances[wide] / chances[wide].sum()))
                cut = draw.uniform(low[f], high[f])
                nodes[at] = [f, cut, len(nodes), 0.0]
                nodes += [[-1, 0.0, -1, 0.0], [-1, 0.0, -1, 0.0]]
                left, top, bottom = rows[:, f] < cut, high.copy(), low.copy()
                top[f] = bottom[f] = cut
                open_ += [(len(nodes) - 2, rows[left], depth + 1, low, top), (len(nodes) - 1, rows[~left], depth + 1, bottom, high)]
            a = np.array(nodes)
            out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3]))
        return cls(out, cls._mean_depth(size) or 1.0)

    def score(self, points: np.ndarray) -> np.ndarray:
        """0 to 1; higher is more unusual."""
        total, every = np.zeros(len(points)), np.arange(len(points))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(points), int)
            while (moving := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(moving, left[at] + (points[every, f] >= cut[at]), at)
            total += path[at]
        return 2.0 ** (-total / max(1, len(self.trees)) / self.norm)


def separation(points: np.ndarray, good: np.ndarray, floor: float = 0.01) -> np.ndarray:
    """For each statistic, the largest difference of its two distributions, good and bad; 1 where a kind is missing."""
    if good.all() or not good.any():
        return np.ones(points.shape[1])
    out = []
    for x in points.T:
        cuts = np.unique(x)
        below = [np.searchsorted(np.sort(x[kind]), cuts, "right") / kind.sum() for kind in (good, ~good)]
        out.append(max(floor, float(np.abs(below[0] - below[1]).max())) ** 2)
    return np.array(out)


def kth_lowest(scores: DataFrame, k: int, parts: int = 4096) -> float:
    """The exact value at place ``k`` (from 0) of ``score``: counts in equal parts of the range, again within the part that holds it."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        part = F.least(F.floor((F.col("score") - low) / (high - low) * parts), F.lit(parts - 1))
        held = scores.where(F.col("score").between(low, high)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
        for r in sorted(held.collect()):
            if k < r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def calibrate(scored: DataFrame, clean_loss: float, default: float) -> float:
    """The threshold for all labelled rows' (score, good)."""
    fine = scored.where("good").select("score")
    n = fine.count()
    if not n:
        return default
    edge = kth_lowest(fine, n - 1 - int(clean_loss * n))
    beyond = scored.where(~F.col("good") & (F.col("score") > edge)).agg(F.min("score")).first()[0]
    return (edge + beyond) / 2 if beyond is not None else edge + 1e-9


def judge(docs: DataFrame, labels: DataFrame, min_words: int = 20, repeat_percent: int = 30, sample_rows: int = 20_000, clean_loss: float = 0.001,
          default_threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: the columns in ``keep`` (all unless given), the counts, shares, base_failed, score and kept."""
    spark, own = docs.sparkSession, [*COUNTS, *SHARES, "base_failed", "score", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    verdict = "base_failed boolean, score double, kept boolean"
    numbers = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in SHARES])

    def count(texts):
        return counts(pd.Series(texts, dtype=object)).to_dict("series")

    plain = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    stats = written(added(plain, numbers, lambda: count, ["_text"], ("_text",)), "quality-counts")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good_label = F.col("quality") > 0
    labelled = written(stats.where(~failed).join(marked, F.col("_id") == F.col("doc_id")).select("_id", *SHARES, "quality"), "quality-labelled")
    kinds = {r["good"]: r["n"] for r in labelled.groupBy(good_label.alias("good")).agg(F.count(F.lit(1)).alias("n")).collect()}
    has_labels, chosen = bool(kinds), labelled
    if not has_labels:
        chosen = stats.where(~failed).select("_id", *SHARES, F.lit(None).cast("int").alias("quality"))
        kinds = {None: chosen.count()}
    ends = chosen.agg(*[f(c) for f in (F.min, F.max) for c in SHARES]).first()
    for kind, n in kinds.items():
        if n > sample_rows:
            chosen = chosen.where(~good_label.eqNullSafe(F.lit(kind).cast("boolean")) | (F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < max(1, (sample_rows << 40) // n)))
    sample = chosen.orderBy("_id", *SHARES).toPandas()
    points, good = sample[SHARES].to_numpy(float), sample["quality"].to_numpy(float) > 0
    box = np.array(ends, float).reshape(2, -1) if len(points) else np.zeros((2, len(SHARES)))
    forest = Forest.grow(points[good] if good.any() else points, box, separation(points, good) if has_labels else np.ones(len(SHARES)))
    threshold = default_threshold
    if has_labels:
        grown = spark.sparkContext.broadcast(forest)

        def rate(*values):
            return {"score": grown.value.score(np.array(values, float).reshape(len(SHARES), -1).T)}

        scored = added(labelled.select(good_label.alias("good"), *SHARES), "score double", lambda: rate, SHARES, tuple(SHARES))
        threshold = calibrate(written(scored, "quality-scores"), clean_loss, default_threshold)
    model = spark.sparkContext.broadcast((forest, threshold))

    def decide(numbers: pd.DataFrame) -> dict:
        forest, threshold = model.value
        failed = (numbers["n_words"] < min_words) | (100 * numbers["n_repeat_words"] > repeat_percent * numbers["n_words"])
        score = forest.score(numbers[SHARES].to_numpy(float))
        return {"base_failed": failed, "score": score, "kept": ~failed & (score <= threshold)}

    columns = [*COUNTS, *SHARES]
    if keep == ["doc_id"]:
        done = added(stats, verdict, lambda: lambda *values: decide(pd.DataFrame(dict(zip(columns, values)), columns=columns)), columns)
        return done.withColumnRenamed("_id", "doc_id").select("doc_id", *own)
    # whole rows are kept: count again beside them instead of moving every text to meet its numbers

    def both(texts):
        numbers = counts(pd.Series(texts, dtype=object))
        return {**numbers.to_dict("series"), **decide(numbers)}

    carried = docs.select(*[F.col(c).alias(f"in_{c}") for c in keep], F.col("text").alias("_text"))
    return added(carried, f"{numbers}, {verdict}", lambda: both, ["_text"], ("_text",)).select(*[F.col(f"in_{c}").alias(c) for c in keep], *own)


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels, keep=["doc_id"]).select("doc_id", *COUNTS, "base_failed", "kept", "score")
