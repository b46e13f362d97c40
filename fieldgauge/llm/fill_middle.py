"""Fill-in-middle transformation by a piece table: texts are never moved, only descriptors of their spans are.

A document is one descriptor over its own text, an immutable buffer; the sentinels are a second one. Cutting splits a descriptor in two,
arranging permutes descriptors, and the inverse permutation restores the reading order. Hashes take the pieces one after another,
so they need no copy of the output. A document's form and cuts come from the hash of its id alone: the same id gives the same form in every run
and on every partitioning.

Forms: psm is prefix, suffix, middle; spm is suffix, prefix, middle, each piece behind its sentinel. A text that is empty or contains a sentinel
stays plain, so that the form and the output always tell the text.

Defined results: a null text counts as empty; a null id is hashed as ``null``; repeated rows give equal results; empty tables give no rows;
further columns are carried, the operator's own win where names clash. ``restore`` gives null where the output does not fit its form.
"""
from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import added

SENTINELS = ("<P>", "<S>", "<M>")
PREFIX, MIDDLE, SUFFIX = range(3)
# The order in which the pieces of a document, numbered as they are read, stand in the output.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
CHUNK = 1 << 20


class Piece(NamedTuple):
    buffer: str
    start: int
    stop: int


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The same text with a border between two pieces at ``at`` code points."""
    out, seen = [], 0
    for p in pieces:
        size = p.stop - p.start
        if seen < at < seen + size:
            middle = p.start + at - seen
            out += [Piece(p.buffer, p.start, middle), Piece(p.buffer, middle, p.stop)]
        else:
            out.append(p)
        seen += size
    return out


def between(pieces: list[Piece], start: int, stop: int) -> list[Piece]:
    """The pieces of ``start`` to ``stop`` of a table that has borders at both."""
    out, seen = [], 0
    for p in pieces:
        if start <= seen and seen + p.stop - p.start <= stop and p.stop > p.start:
            out.append(p)
        seen += p.stop - p.start
    return out


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(order.index(k) for k in range(len(order)))


def text_of(pieces: list[Piece]) -> str:
    return "".join(p.buffer[p.start:p.stop] for p in pieces)


def digest(pieces: list[Piece]) -> str:
    """sha256 of the pieces' UTF-8 text, a bounded span at a time."""
    h = hashlib.sha256()
    for p in pieces:
        for at in range(p.start, p.stop, CHUNK):
            h.update(p.buffer[at:min(p.stop, at + CHUNK)].encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def sentinel_pieces(sentinels: tuple[str, str, str]) -> list[Piece]:
    """The sentinels of prefix, middle and suffix, over one buffer."""
    p, s, m = sentinels
    joined = p + m + s
    return [Piece(joined, 0, len(p)), Piece(joined, len(p), len(p + m)), Piece(joined, len(p + m), len(joined))]


def draws(doc_id, seed: int) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k:k + 8], 16) for k in range(0, 32, 8)]


def arranged(text: str, doc_id, sentinels=SENTINELS, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20):
    """form, prefix length, middle length (None if plain) and the output's pieces."""
    whole = [Piece(text, 0, len(text))]
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= fim_percent or any(s in text for s in sentinels):
        return "plain", None, None, whole
    form = "spm" if h4 % 100 < spm_percent else "psm"
    a, z = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    pieces = cut(cut(whole, a), z)
    parts = [between(pieces, 0, a), between(pieces, a, z), between(pieces, z, len(text))]
    marks = sentinel_pieces(sentinels)
    return form, a, z - a, [p for k in ORDERS[form] for p in (marks[k], *parts[k])]


def restored(output: str, form: str | None, sentinels=SENTINELS) -> list[Piece] | None:
    """The pieces of the text behind an output, in reading order, or None if it does not fit its form."""
    if form == "plain":
        return [Piece(output, 0, len(output))]
    if form not in ORDERS:
        return None
    mark, order, spans, at = (sentinels[0], sentinels[2], sentinels[1]), ORDERS[form], [], 0
    for n, k in enumerate(order):
        if not output.startswith(mark[k], at):
            return None
        start = at + len(mark[k])
        at = output.find(mark[order[n + 1]], start) if n + 1 < len(order) else len(output)
        if at < 0:
            return None
        spans.append(Piece(output, start, at))
    return [spans[k] for k in inverse(order)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = SENTINELS, seed: int = 1,
                   fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``docs`` without the text, plus n, form, prefix_chars, middle_chars, output (the text to train on) and output_sha256."""
    own = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256")
    carried = [c for c in docs.columns if c not in (*own, text_col)]

    def start():
        def work(ids, texts):
            texts = [t or "" for t in texts]
            found = [arranged(t, i, sentinels, seed, fim_percent, spm_percent) for i, t in zip(ids, texts)]
            return {"n": [len(t) for t in texts], "form": [f for f, *_ in found], "prefix_chars": [a for _, a, _, _ in found], "middle_chars": [m for _, _, m, _ in found],
                    "output": [text_of(p) for *_, p in found], "output_sha256": [digest(p) for *_, p in found]}
        return work

    given = docs.select(*[F.col(c).alias(f"in_{c}") for c in carried], F.col(id_col).alias("key"), F.col(text_col).alias("whole"))
    out = added(given, "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string", start, ["key", "whole"], ("key", "whole"))
    return out.select(*[F.col(f"in_{c}").alias(c) for c in carried], *own)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``rows`` plus text (rebuilt from output and form) and restored_sha256, in place of the output."""
    own = ("text", "restored_sha256")
    carried = [c for c in rows.columns if c not in (*own, output_col)]

    def start():
        def work(outputs, forms):
            found = [None if o is None else restored(o, f, sentinels) for o, f in zip(outputs, forms)]
            return {"text": [None if p is None else text_of(p) for p in found], "restored_sha256": [None if p is None else digest(p) for p in found]}
        return work

    given = rows.select(*[F.col(c).alias(f"in_{c}") for c in carried], F.col(form_col).alias("kind"), F.col(output_col).alias("whole"))
    out = added(given, "text string, restored_sha256 string", start, ["whole", "kind"], ("whole", "kind"))
    return out.select(*[F.col(f"in_{c}").alias(c) for c in carried], *own)


def middle_digests(docs: DataFrame) -> DataFrame:
    made = fill_in_middle(docs.select("doc_id", "text"))
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


MIDDLE_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
k AS (SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM h),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z FROM k),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, z - a) AS middle, substr(t, z + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p
"""
