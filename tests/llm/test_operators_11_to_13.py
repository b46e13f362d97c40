"""Fill-in-middle, license scans and vector codes against brute force and on odd inputs."""
import hashlib
import math
import re

import numpy as np
import pytest

from fieldgauge.llm import fill_middle, license_scan, vector_codes
from fieldgauge.llm.license_rules import REACH, RULES, Rule

DOCS = "doc_id long, text string, lang string"
CLASH = "doc_id long, text string, n string, form int, output string, labels int, n_words string, whole int, key int, words int, found string, base int"


def low(text):
    return (text or "").encode().lower().decode()


# ---- fill in middle

def middle_rows(rows):
    out = []
    for doc_id, text in rows:
        t = text or ""
        h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
        a, z = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            form, a, m, output = "plain", None, None, t
        else:
            form, m = "spm" if h4 % 100 < 20 else "psm", z - a
            output = f"<P>{t[:a]}<S>{t[z:]}<M>{t[a:z]}" if form == "psm" else f"<S>{t[z:]}<P>{t[:a]}<M>{t[a:z]}"
        out.append((doc_id, len(t), form, a, m, output, t))
    return out


ODD = [None, "", "x", "é日本🙂" * 50, "a <P> inside", "half < P> and <S", "<M>", "words " * 300_000, " \n\t", "<", "P><S"]


def test_fill_in_middle_brute_force(spark):
    rows = [(k, ODD[k % len(ODD)] if k % 3 else f"text number {k} with words and ends <", "en") for k in range(200)] + [(None, "a null id", "en"), (5, "twice", None), (5, "twice", None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = middle_rows([r[:2] for r in rows])
    made = fill_middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "lang", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect()]
    assert sorted(got, key=str) == sorted((w[:6] for w in want), key=str)
    back = fill_middle.restore(made).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in back) == sorted(str((w[0], w[6])) for w in want)
    digests = {(r["doc_id"], r["n"], r["output_sha256"], r["restored_sha256"]) for r in fill_middle.middle_digests(docs).collect()}
    assert digests == {(w[0], w[1], hashlib.sha256(w[5].encode()).hexdigest(), hashlib.sha256(w[6].encode()).hexdigest()) for w in want}
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_piece_table():
    whole = [fill_middle.Piece("abcdef", 0, 6)]
    pieces = fill_middle.cut(fill_middle.cut(whole, 2), 5)
    assert [(p.start, p.stop) for p in pieces] == [(0, 2), (2, 5), (5, 6)] and fill_middle.text_of(pieces) == "abcdef"
    assert fill_middle.cut(pieces, 2) == pieces == fill_middle.cut(pieces, 0) and all(p.buffer is whole[0].buffer for p in pieces)
    assert fill_middle.text_of(fill_middle.between(pieces, 2, 6)) == "cdef" and fill_middle.between(pieces, 2, 2) == []
    for order in fill_middle.ORDERS.values():
        assert [order[k] for k in fill_middle.inverse(order)] == [0, 1, 2]
    assert fill_middle.restored("<P>a<M>b", "psm") is None and fill_middle.restored("a", "other") is None and fill_middle.restored("", "plain") == [("", 0, 0)]
    assert fill_middle.digest([fill_middle.Piece("é" * 3_000_000, 0, 3_000_000)]) == hashlib.sha256(("é" * 3_000_000).encode()).hexdigest()


def test_middle_settings_and_empty(spark):
    docs = spark.createDataFrame([(k, f"some text {k}", "en") for k in range(30)], DOCS)
    other = fill_middle.fill_in_middle(docs, sentinels=("[p]", "[s]", "[m]"), seed=9, fim_percent=100, spm_percent=100).collect()
    assert {r["form"] for r in other} == {"spm"} and all(r["output"].startswith("[s]") for r in other)
    assert fill_middle.middle_digests(docs.limit(0)).count() == 0
    bad = spark.createDataFrame([("<P>a", "psm"), (None, "psm"), ("a", None)], "output string, form string")
    assert [r["text"] for r in fill_middle.restore(bad).collect()] == [None] * 3


# ---- license scans

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def detections(text, rules):
    words, found = WORDS.findall(low(text)), []
    for i, w in enumerate(words):
        before = "".join(f"{x} " for x in words[max(0, i - REACH):i])
        after = "".join(f" {x}" for x in words[i + 1:i + 1 + REACH])
        for r in rules:
            if r.keyword == w:
                b, a = re.search(f"(?:^| )({r.before})$", before), re.search(f"^({r.after})(?: |$)", after)
                if b and a:
                    found.append((i - len(b.group(1).split()), i + 1 + len(a.group(1).split()), r))
    kept = [d for d in found if d[2].base or not any(
        e[0] <= d[0] and e[1] >= d[1] and (e[2].priority < d[2].priority or e[2].priority == d[2].priority and e[1] - e[0] > d[1] - d[0]) for e in found)]
    return words, found, kept


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License)", "SPDX-License-Identifier: GPL-3.0-or-later\nall rights reserved", "This work is licensed under CC BY-NC-SA 4.0.",
    "GNU General Public License, version 3; GNU Lesser General Public License version 2.1", "cc by cc by CC-BY", "ALL RIGHTS RESERVED. All rights reserved", "all rights were reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "released under the MIT License or the BSD 3-clause license", "cc", "general public", None, "", " ,.; ",
    "Copyright (c) 2020 by someone. Released into the public domain.", "cc\x01by \x01cc by", "reserved rights all ÄÖ cc by é", "redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "word " * 60_000 + "cc by " * 3, "all rights reserved " * 2_000]


def test_license_scan_brute_force(spark):
    rows = [(k, t, "en") for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], None), (None, TEXTS[0], "en")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    want = []
    for doc_id, text, lang in rows:
        words, found, kept = detections(text[:4000] if text and doc_id == 19 else text, RULES)
        base = [d[0] for d in found if d[2].base]
        each = sorted((label, len(mine), min(d[0] for d in mine), max(d[1] for d in mine) - 1) for label in {d[2].label for d in kept} for mine in [[d for d in kept if d[2].label == label]])
        want.append((doc_id, lang, len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({d[2].label for d in found if d[2].base})), ",".join(e[0] for e in each), each))
    def plain(r):
        return (r["doc_id"], r["lang"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], [(d["label"], d["n"], d["first_word"], d["last_word"]) for d in r["detections"]])
    short = [plain(r) for r in got if r["doc_id"] != 19]
    assert sorted(short, key=str) == sorted((w for w in want if w[0] != 19), key=str)
    many = next(r for r in got if r["doc_id"] == 19)
    assert (many["n_words"], many["n_base"], many["first_word"], many["last_word"], many["labels"]) == (6000, 2000, 0, 5997, "reserved")
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[0] == "apache-2.0" and labels[1] == "gpl-3.0,reserved" and labels[2] == "cc-by,cc-by-nc-sa-4.0" and labels[8] == "bsd-3-clause,mit" and labels[9] == labels[11] == ""
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in got)


def test_license_suppression_needs_containment(spark):
    rules = [Rule("long", 1, "b", "a ", " c"), Rule("inside", 2, "c", "b ", ""), Rule("across", 2, "d", "c ", ""), Rule("same", 1, "c", "a b ", ""), Rule("base", 4, "b", "", "", True)]
    got = license_scan.scan_licenses(spark.createDataFrame([(1, "a b c d", "x")], DOCS), rules=rules).first()
    assert got["labels"] == "across,base,long,same" and got["base_labels"] == "base"


def test_license_clashes_and_empty(spark):
    rows = [(1, "cc by", "x", 2, "y", 3, "z", 4, 5, 6, "q", 7)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, CLASH)).where("labels = 'cc-by'").first()
    assert (got["doc_id"], got["n"], got["form"], got["output"], got["labels"], got["n_words"], got["whole"], got["key"], got["words"]) == (1, "x", 2, "y", "cc-by", 2, 4, 5, 6)
    back = fill_middle.restore(fill_middle.fill_in_middle(spark.createDataFrame(rows, CLASH))).first()
    assert (back["text"], back["labels"], back["whole"], back["key"]) == ("cc by", 3, 4, 5)
    assert license_scan.license_verdicts(spark.createDataFrame([], DOCS)).count() == 0


def most_blanks(parsed):
    """The largest number of blanks that a parsed regex can take."""
    total = 0
    for kind, arg in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            total += arg == 32
        elif kind == "BRANCH":
            total += max(map(most_blanks, arg[1]))
        elif kind == "SUBPATTERN":
            total += most_blanks(arg[-1])
        elif kind == "MAX_REPEAT":
            inner = most_blanks(arg[2])
            total += inner * int(arg[1]) if inner else 0
        else:
            assert kind in ("IN", "NOT_LITERAL"), kind
    return total


def test_rules_stay_within_reach():
    from re import _parser
    for r in RULES:
        assert max(most_blanks(_parser.parse(r.before)), most_blanks(_parser.parse(r.after))) <= REACH, r
    assert len(RULES) > 300 and len(set(RULES)) > 300


# ---- vector codes

def codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (length - len(v)), label) for i, v, label in kept]
    width = length // parts
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = [[v[p * width:(p + 1) * width] for v in list(first.values())[:entries]] for p in range(parts)]

    def assign(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * width:(p + 1) * width], e)) for e in books[p]]
        return d.index(min(d)), min(d)
    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for _, v, _ in kept:
                mine[assign(v, p)[0]].append(v[p * width:(p + 1) * width])
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(mine, books[p])]
    out, total = [], {}
    for i, v, label in kept:
        found = [assign(v, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), label))
        total[label] = total.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=str)


def vectors(n, length, scale=1.0, seed=3):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in rng.normal(0, scale, length)], [None, 1, 2][i % 3]) for i in rng.permutation(n)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_codes_brute_force(spark, kind):
    rows = vectors(150, 24)
    rows += [(500, None, 1), (501, [float("nan")] * 24, 1), (502, [None] + [0.0] * 23, 1), (503, [float("inf")] + [0.0] * 23, 1), (-1, [0.5] * 24, 2), (-1, [0.25] * 24, 2), (-1, [0.25] * 24, 2), (None, [1.0] * 24, None)]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    got = vector_codes.vector_codes(table)
    assert sorted((tuple(r) for r in got.collect()), key=str) == codes(rows)


def test_vector_codes_odd_shapes(spark):
    schema = "vec_id long, embedding array<double>, label int"
    for rows in ([(k, [0.1 * k] * (3 + k % 4), 1) for k in range(5)], [(1, [], None), (2, [], 3)], [(k, [float(k % 2)] * 8, 0) for k in range(40)]):
        assert sorted((tuple(r) for r in vector_codes.vector_codes(spark.createDataFrame(rows, schema)).collect()), key=str) == codes(rows)
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 2)], schema)).count() == 0


def test_vector_codes_beyond_64_bits(spark):
    rows = [(k, [(-1.5) ** (k % 7) * 10.0 ** (k % 20)] * 8, k % 2) for k in range(40)] + [(99, [1e300, -1e300] * 4, 5)]
    want = [tuple(None if isinstance(x, int) and x >= 1 << 63 else x for x in w) for w in codes(rows)]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["codebooks_sha256"]) for r in sorted(got, key=lambda r: str(tuple(r)))] == [(w[0], w[1], w[2], w[4]) for w in sorted(want, key=str)]


def test_nearest_is_exact_and_breaks_ties_low():
    rng = np.random.default_rng(5)
    for most, width, many in ((3, 8, 16), (50, 5, 9), (10 ** 6, 1, 16), (10 ** 13, 7, 4), (2, 3, 1)):
        x, b = rng.integers(-most, most + 1, (300, width)), rng.integers(-most, most + 1, (many, width))
        d = ((x.astype(object)[:, None] - b.astype(object)[None]) ** 2).sum(2)
        code, error = vector_codes.nearest(x, b)
        assert code.tolist() == [list(r).index(min(r)) for r in d] and list(map(int, error)) == [int(min(r)) for r in d]


def test_transform_keeps_distances_and_orders_by_sign_changes():
    x = np.arange(24).reshape(3, 8)
    t = vector_codes.transformed(x)
    assert (8 * (x ** 2).sum(1) == (t ** 2).sum(1)).all()
    rows = vector_codes.transformed(np.eye(8, dtype=np.int64)).T
    assert [int((r[1:] != r[:-1]).sum()) for r in rows] == list(range(8))


def test_vector_codes_carries_columns(spark):
    table = spark.createDataFrame([(1, [0.5] * 8, 2, "x", 3)], "vec_id long, embedding array<float>, label int, code string, vector int")
    got, books = vector_codes.compress(table)
    row = got.first()
    assert got.columns == ["vec_id", "embedding", "label", "vector", "code", "error"] and row["code"] == "00" * 8 and row["vector"] == 3 and books.parts == 8
