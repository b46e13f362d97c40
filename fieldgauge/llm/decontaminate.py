"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows, run once over every whole text.

Texts and items are normalised alike: A-Z in lower case, words of ASCII letters and digits and any other character beyond ASCII.
An item's windows are its runs of ``window`` words; an item of fewer words, but not none, is one window. Each window, between
blanks, is a pattern; a text is scanned as its words joined by blanks, so patterns meet whole words only, and a hit's place in
the joined text gives its words and, through the words' places, the span in the original text.

Windows reach the executors by broadcast in parts of at most ``part_chars`` characters, one automaton for each part. A benchmark
within the bound is one automaton and one scan; a larger one is scanned part after part in the same task, with marks added up.

Defined results: a null text has no words and is not hit; a null item has no windows; windows of an item without item_id mark
words but count no item; equal rows give equal results; empty tables give no hits or no rows; further columns are carried along by
``find_leaks``, whose own columns win where names clash.
"""
from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import added

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
# A-Z to a-z; every separator to a blank
_NORMAL = bytes(b + 32 if b in _UPPER else 32 if b in _SEPARATORS else b for b in range(256))
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


def windows_of(words: list[bytes], window: int) -> list[str]:
    runs = [words] if 0 < len(words) < window else [words[i:i + window] for i in range(len(words) - window + 1)]
    return [b" ".join(r).decode("utf-8", "replace") for r in runs]


def _windows(items: DataFrame, window: int, part_chars: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Distinct windows with their item ids, in parts that the driver takes one at a time."""
    def split(batches):
        for b in batches:
            rows = [(w, i) for i, t in zip(b["item_id"], b["text"]) for w in windows_of(words_of(t), window)]
            yield pd.DataFrame(rows, columns=["window", "item_id"]).astype({"window": object, "item_id": object})

    found = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInPandas(split, "window string, item_id string").distinct()
    part, chars = {}, 0
    for w, i in found.orderBy("window", "item_id").toLocalIterator():
        if chars > part_chars and w not in part:
            yield list(part.items())
            part, chars = {}, 0
        ids = part.setdefault(w, [])
        chars += (0 if ids else len(w)) + len(i or "") + 8
        if i is not None:
            ids.append(i)
    if part:
        yield list(part.items())


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, part_chars: int = 64_000_000) -> DataFrame:
    """``docs`` plus n_words, n_hit, items (ids, sorted as strings), contaminated and spans (start, end in the original text)."""
    own = ["n_words", "n_hit", "items", "contaminated", "spans"]
    carried = [c for c in docs.columns if c not in own]
    out = docs.select(*[F.col(c).alias(f"in_{c}") for c in carried], F.lit(None).cast("array<array<bigint>>").alias("runs"), F.array().cast("array<string>").alias("items"))
    if "text" not in carried:
        raise ValueError("docs must have a column text")
    spark = docs.sparkSession
    parts = [spark.sparkContext.broadcast(part) for part in _windows(items, window, part_chars)] or [spark.sparkContext.broadcast([])]
    marks = "runs array<array<bigint>>, items array<string>"
    for part in parts[:-1]:
        out = added(out, marks, _scanner(part), ["in_text", "runs", "items"], ("runs", "items"))
    out = added(out, "n_words long, n_hit long, items array<string>, contaminated boolean, spans array<array<bigint>>", _scanner(parts[-1], last=True), ["in_text", "runs", "items"], ("runs", "items"))
    return out.select(*[F.col(f"in_{c}").alias(c) for c in carried], *own)


def _scanner(part, last: bool = False):
    def start():
        import ahocorasick
        machine, patterns = ahocorasick.Automaton(), part.value
        for n, (w, _) in enumerate(patterns):
            machine.add_word(f" {w} ", (w.count(" ") + 1, n))
        if patterns:
            machine.make_automaton()

        def scan(texts, old_runs, old_items):
            counts, runs, items = [], [], []
            for text, old, had in zip(texts, old_runs, old_items):
                words = words_of(text)
                counts.append(len(words))
                new, ids = list(old or ()), set(had)
                if words and patterns:
                    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
                    ends = None
                    for end, (size, n) in machine.iter(joined):
                        if ends is None:
                            ends = [m.start() for m in re.finditer(" ", joined)][1:]
                        stop = bisect.bisect_left(ends, end) + 1
                        new.append([stop - size, stop])
                        ids.update(patterns[n][1])
                runs.append(new or None)
                items.append(sorted(ids))
            if not last:
                return {"runs": runs, "items": items}
            places = [_spans(t, r) for t, r in zip(texts, runs)]
            return {"n_words": counts, "n_hit": [h for h, _ in places], "items": items, "contaminated": [h > 0 for h, _ in places], "spans": [s for _, s in places]}
        return scan
    return start


def _spans(text: str | None, runs: list | None) -> tuple[int, list]:
    """The number of words in the runs of hit words, merged, and each run's place in the original text."""
    merged: list[list[int]] = []
    for a, z in sorted(runs or ()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    places = [m.span() for m in _ORIGINAL_WORD.finditer(text)] if merged else []
    return sum(z - a for a, z in merged), [[places[a][0], places[z - 1][1]] for a, z in merged]


def leak_digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = find_leaks(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


LEAK_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM p),
g AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, z WHERE len(w) >= size)),
h AS (SELECT doc_id, i, p.size, item_id FROM g JOIN p ON g.win = p.win AND g.size = p.size),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
