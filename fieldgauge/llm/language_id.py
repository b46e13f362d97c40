"""Language identification by cross-parsing entropy.

For each language a suffix automaton of some labelled text knows every substring of it. A text is cut greedily into the longest
stretches that the automaton knows (phrases); its cross-parsing entropy is phrases * log2(n) / letters, for n letters of labelled
text. The language with the lowest wins; the score is how far it stays below the second (1 where there is no second).

Texts are reduced to lower-case letters with one blank between words. The whole text is parsed, in stretches of ``STRETCH`` symbols
of which each is begun afresh, so that many are parsed side by side in numpy. The automata come from a bounded sample of the
labelled rows: at most ``letters`` symbols for each language, from excerpts of ``EXCERPT`` characters, chosen by a hash of doc_id.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or where nothing was learned; a null doc_id counts as
the empty one for the held-out rule; equal rows get equal results; an empty table gives no rows; other columns are never read.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import added

STRETCH, EXCERPT, LANES = 1024, 1024, 4096
_MISS = 1 << 30
_tables: list[np.ndarray] = []


def _unicode() -> list[np.ndarray]:
    """For every code point: its lower case, or 0 if it is no letter."""
    if not _tables:
        low = [chr(c).lower() if chr(c).isalpha() else "" for c in range(0x110000)]
        _tables.append(np.array([ord(x) if len(x) == 1 else (ord(x[0]) if x else 0) for x in low], np.uint32))
    return _tables


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters as code points, with single zeros between words and at both ends; empty if there is no letter."""
    points = _unicode()[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate(([0], points, [0]))
    points = points[(points != 0) | np.concatenate(([True], points[:-1] != 0))]
    return points if len(points) > 1 else points[:0]


def automaton(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix automaton of ``symbols`` as a flat table for greedy parsing.

    A state is stored times ``alphabet``. table[state + symbol] is the next state; where the automaton has none, it is the state
    after that symbol from the root, marked by ``_MISS``: a phrase has ended and the next one begins with the symbol. The last
    row is the state before a text, and after a symbol that the root does not know, which is a phrase of its own.
    """
    length, link, edges, last = [0], [-1], [{}], 0
    for c in symbols.tolist():
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        edges.append({})
        at = last
        while at != -1 and c not in edges[at]:
            edges[at][c] = now
            at = link[at]
        if at != -1:
            to = edges[at][c]
            if length[to] == length[at] + 1:
                link[now] = to
            else:
                twin = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                edges.append(dict(edges[to]))
                while at != -1 and edges[at].get(c) == to:
                    edges[at][c] = twin
                    at = link[at]
                link[to] = link[now] = twin
        last = now
    again = np.full(alphabet, len(edges) * alphabet, np.int64)
    for c, to in edges[0].items():
        again[c] = to * alphabet
    table = np.tile((again | _MISS).astype(np.int32), len(edges) + 1).reshape(len(edges) + 1, alphabet)
    for state, out in enumerate(edges):
        for c, to in out.items():
            table[state, c] = to * alphabet
    return table.ravel()


class Languages:
    """The automata, and the alphabet: the most frequent letters, and some classes for all the rest."""

    def __init__(self, samples: dict[str, list[str]], letters: int = 32_768, most: int = 120, classes: int = 8):
        # a state times the alphabet must stay below _MISS
        letters = max(1024, min(letters, 8 * letters // max(1, len(samples))))
        texts = {k: np.concatenate([letters_of(t) for t in v] or [np.empty(0, np.uint32)])[:letters] for k, v in sorted(samples.items())}
        texts = {k: v for k, v in texts.items() if len(v)}
        points, n = np.unique(np.concatenate([*texts.values(), np.empty(0, np.uint32)]), return_counts=True)
        common = points[np.argsort(-n, kind="stable")][:most]
        common = np.sort(common[common != 0])
        self.codes = (np.arange(0x110000) % classes + 1 + len(common)).astype(np.uint8)
        self.codes[common] = np.arange(1, len(common) + 1)
        self.codes[0] = 0
        self.alphabet = len(common) + 1 + classes
        self.names = list(texts)
        self.tables = [automaton(self.codes[v], self.alphabet) for v in texts.values()]
        self.bits = np.array([math.log2(max(2, len(v))) for v in texts.values()])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum() or not self.names:
            return out
        data = self.codes[np.concatenate(texts)]
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[owner] + number * STRETCH
        size = np.minimum(STRETCH, sizes[owner] - number * STRETCH)
        order = np.argsort(-size, kind="stable")
        data = np.concatenate((data, np.zeros(STRETCH, np.uint8)))
        for i in range(0, len(order), LANES):
            lanes = order[i:i + LANES]
            grid = np.ascontiguousarray(data[start[lanes][:, None] + np.arange(size[lanes[0]])].T)
            active = np.searchsorted(-size[lanes], -np.arange(len(grid)), "left")  # lanes longer than t
            for k, table in enumerate(self.tables):
                count, state = np.zeros(len(lanes), np.int64), np.full(len(lanes), len(table) - self.alphabet, np.int32)
                for t in range(len(grid)):
                    n = active[t]
                    to = table[state[:n] + grid[t, :n]]
                    count[:n] += to >> 30
                    np.bitwise_and(to, _MISS - 1, out=state[:n])
                np.add.at(out[:, k], owner[lanes], count)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        symbols = [letters_of(t) if t else np.empty(0, np.uint32) for t in texts]
        names, scores = [], []
        for s, found in zip(symbols, self.phrases(symbols)):
            if not len(s) or not self.names:
                names.append("und")
                scores.append(0.0)
                continue
            entropy = found * self.bits / len(s)
            order = np.argsort(entropy, kind="stable")
            names.append(self.names[order[0]])
            scores.append(float(1 - entropy[order[0]] / entropy[order[1]]) if len(order) > 1 and entropy[order[1]] > 0 else float(len(order) == 1))
        return names, scores


DRAWS = 1 << 40


def _share(wanted: int, n: int) -> int:
    """How many of the ``DRAWS`` numbers choose a row, so that of ``n`` rows about ``wanted`` are chosen; never none."""
    return min(DRAWS, max(1, DRAWS * wanted // n))


def _remainder(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def learn(docs: DataFrame, letters: int = 32_768) -> Languages:
    """Automata from the labelled rows of ``docs`` (text, lang, doc_id). Languages are taken to be few."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    totals = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not totals:
        return Languages({})
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(DRAWS))
    wanted = 8 * letters // EXCERPT
    share = F.create_map(*[F.lit(x) for k, n in sorted(totals.items()) for x in (k, _share(wanted, n))])[F.col("lang")]
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("excerpt")), F.greatest(F.length("text") - EXCERPT, F.lit(1))) + 1
    rows = known.withColumn("draw", draw).where(F.col("draw") < share).select("lang", "draw", "doc_id", F.substring("text", start.cast("int"), F.lit(EXCERPT)).alias("excerpt"))
    samples: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["draw"], r["doc_id"] or 0, r["excerpt"])):
        samples.setdefault(r["lang"], []).append(r["excerpt"])
    return Languages(samples, letters)


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """``docs`` plus lang_pred and score."""
    carried = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def work(texts):
            names, scores = shared.value.predict(texts)
            return {"lang_pred": names, "score": scores}
        return work

    rows = docs.select(*[F.col(c).alias(f"in_{c}") for c in carried], F.col("text").alias("_text"))
    return added(rows, "lang_pred string, score double", start, ["_text"], ("_text",)).select(*[F.col(f"in_{c}").alias(c) for c in carried], "lang_pred", "score")


def predictions(docs: DataFrame) -> DataFrame:
    model = learn(docs.where(_remainder(4) != 2))
    held = docs.select("doc_id", "text", (_remainder(4) == 2).alias("held_out"))
    return identify(held, model).select("doc_id", "held_out", "lang_pred", "score")
