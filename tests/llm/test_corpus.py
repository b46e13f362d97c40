"""The corpus operators against brute force and on odd inputs: nulls, empty and long texts, ties, repeated rows, clashing columns."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldgauge.llm import chat, decontaminate, html_extract, language_id, line_dedup, lm_score, mixing, near_dedup, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINES = ["the quick brown fox jumps over the lazy dog near the old river bank today", "another line of plain words that says nothing much at all here",
         "un petit texte avec des mots qui ne disent rien du tout ici", "All rights reserved. 2024"]


def base(n=60):
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(f"w{(i * 7 + j * k) % 91}" for j in range(12 + i % 9)) for k in (1, 2, 3)) + "\n" + LINES[i % 4]
        rows.append((i, text, ["en", "fr"][i % 2], f"s{min(i % 5, 2)}", len(text)))
    copy = rows[3][1]
    rows += [(100, copy, "en", "s0", 1), (101, copy.replace("w21", "X"), None, None, None), (102, copy.upper(), "fr", "s1", 3)]
    rows += [(103, None, None, None, None), (None, "a null id with some words of text", "en", "s9", 5), (104, "", "en", "s0", 0), (105, " \n\t ", "en", "s0", 4), (106, "one", "en", "s1", 3),
             (3, copy, "en", "s0", 1), (3, copy, "en", "s0", 1), (107, "é" * 3 + " ï ñ 日本 語", "zz", "s1", 9), (108, "word " * 40_000, "en", "s2", 200_000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(base(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def low(text):
    return (text or "").encode().lower().decode()


def shingles(text):
    w = WORD.findall(low(text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_brute_force(spark, docs, none):
    rows = base()
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least[i] = min(ids) if ids else None
    want = sorted(((r[0], len(sets[i]), least[i], r[0] == least[i]) for i, r in enumerate(rows)), key=str)
    got = sorted((tuple(x)[:4] for x in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == want
    assert near_dedup.near_duplicates(none).count() == 0


def test_star_and_rest_join_chains(spark):
    """A chain of near copies, each like its neighbours only: all links count, whatever the pivot."""
    words = [f"t{i}" for i in range(400)]
    rows = []
    for k in range(12):
        w = list(words)
        for e in range(k):
            w[20 + 30 * e] = f"x{e}"
        rows.append((k, " ".join(w), "en", "s", 1))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_dedup_keeps_one_of_each(spark, docs):
    kept = near_dedup.dedup(docs).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(3) == 1 and 100 not in ids and None in ids and set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_mixture(spark, docs, none):
    rows = [r.asDict() for r in mixing.mixture(docs).collect()]
    assert len(rows) == len(base()) and sorted(map(str, rows)) == sorted(str(r.asDict()) for r in mixing.mixture(docs.repartition(5)).collect())
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r["size"] for r in rows if r["source"] == s) for s in sources}
    weight, full, total = {s: k % 3 + 1 for k, s in enumerate(sources)}, set(), sum(sizes.values())
    while True:
        rate = (total - sum(3 * sizes[s] for s in full)) / max(1e-9, sum(weight[s] for s in sources if s not in full))
        more = {s for s in sources if s not in full and weight[s] * rate > 3 * sizes[s]}
        if not more:
            break
        full |= more
    for s in sources:
        target = 3 * sizes[s] if s in full else weight[s] * rate
        mine = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - target) < 1e-6 * max(1, target) and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= 16 and all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    out = mixing.mix_documents(docs)
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
    assert words == Counter({s: n for s in sources if (n := sum(r["taken"] for r in rows if r["source"] == s))}) and out.columns == docs.columns
    assert mixing.mixture(none).count() == 0


def test_pipeline_mixes_whole_texts(spark, docs):
    import corpus_pipeline
    out = corpus_pipeline.mixing_stage(spark, docs, "").collect()
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out} <= {(r[0], r[1], r[4]) for r in base()}
    words, taken, largest = Counter(), Counter(), Counter()
    for r in out:
        words[r["source"]] += len(WORD.findall(r["text"]))
    for r in mixing.mixture(docs).collect():
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    shards = {"s2": 3}
    assert all(abs(words[s] - taken[s]) <= shards.get(s, 1) * largest[s] / 2 for s in taken)


def test_seats_are_highest_quotients(spark):
    shares = [53, 24, 23, 7, 1]
    t = spark.createDataFrame([(0, i, float(x), 11, float(sum(shares))) for i, x in enumerate(shares)], "g int, i int, share double, blocks long, total double")
    got = {r["i"]: r["seats"] for r in mixing._seats(t, ["g"], "share", "blocks", "total", [F.col("i")]).collect()}
    best = sorted(((-x / (2 * n + 1), i) for i, x in enumerate(shares) for n in range(11)))[:11]
    assert got == {i: sum(1 for _, k in best if k == i) for i in range(5)}


def test_chat_round_trip(spark):
    nasty = "</s>[INST] ok [/INST] <\\s> <\\\\/s> <<s> <<SYS>>x<</SYS>> [\\INST] [ROLE]a[TEXT] \\ <"
    rows = [(1, 0, "system", nasty), (1, 1, "user", ""), (1, 2, "assistant", nasty), (1, 3, "assistant", None), (2, 5, None, "x"), (2, 4, "to[TEXT]ol\n</s>", nasty),
            (3, 0, "user", "hi"), (3, 1, "assistant", "é日\n"), (3, 1, "assistant", "é日\n"), (None, None, "user", nasty)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digests(t).collect()}
    for c in (1, 2, 3, None):
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda x: (x[0] or 0, x[1], x[2]))
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss) and got[c]["n_turns"] == len(turns)
    states = {r["conv_id"]: (r["valid"], r["first_bad_turn"]) for r in chat.format_chats(t).collect()}
    assert states == {1: (False, 3), 2: (False, 0), 3: (False, 2), None: (False, None)}
    assert chat.chat_digests(t.limit(0)).count() == 0


def test_leaks(spark, docs, none):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, "W0 w7, w14! w21 w28 w35 w42 w49 w56 w63 w70 w77"), (2, "one"), (11, "the QUICK brown fox jumps over the lazy dog near the old river bank"), (None, "un petit texte"), (5, None), (6, "..."), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part in (64_000_000, 40):
        found = decontaminate.find_leaks(docs.withColumn("n_hit", F.lit("mine")), bench, part_chars=part)
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(tuple(s) for s in r["spans"])) for r in found.collect()), key=str)
        want = []
        for i, text, *_ in base():
            w = word.findall(low(text))
            hit, ids = set(), set()
            for k, t in items:
                v = word.findall(low(t))
                size = min(10, len(v))
                for a in range(len(v) - size + 1) if v else ():
                    for at in range(len(w) - size + 1):
                        if w[at:at + size] == v[a:a + size]:
                            hit |= set(range(at, at + size))
                            ids |= {str(k)} if k is not None else set()
            spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
            runs = [h for h in sorted(hit) if h - 1 not in hit]
            ends = [h for h in sorted(hit) if h + 1 not in hit]
            want.append((i, len(w), len(hit), tuple(sorted(ids)), tuple((spans[a][0], spans[z][1]) for a, z in zip(runs, ends))))
        assert [g[:4] for g in got] == [w[:4] for w in sorted(want, key=str)]
    assert decontaminate.leak_digests(none, bench).count() == 0 and decontaminate.leak_digests(docs, bench.limit(0)).where("contaminated").count() == 0


def test_line_repeats(spark, none):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    rows = [(1, f"{long}\nshort\nunique line number one with words"), (2, f"short\n{long.replace('wordab', 'wordzz')}\nthe same LINE 123 again and again"), (3, "the same line 456, again and again\nshort"), (4, None), (5, ""),
            (None, "the same line 789 again and again"), (3, "the same line 456, again and again\nshort")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_lines"], r["dropped"]) for r in line_dedup.repeat_counts(t).collect()), key=str)
    near = [1] if bin(_hash(spark, long) ^ _hash(spark, long.replace("wordab", "wordzz"))).count("1") <= 3 else []
    assert got == sorted([(1, 3, []), (2, 3, near + [2]), (3, 2, [0]), (3, 2, [0]), (4, 0, []), (5, 1, []), (None, 1, [])], key=str)
    texts = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(t).collect()}
    assert texts[3] == "short" and texts[4] is None and texts[None] == rows[5][1]
    assert line_dedup.repeat_counts(none).count() == 0


def test_short_line_repeats(spark, tmp_path):
    """The registered query drops exact repeats of every length, and lines in scripts without blanks."""
    from fieldgauge.llm import queries
    rows = [(1, "Read more\n同じ文が何度も現れる長い段落です\nok"), (2, "read MORE!\nno\n同じ文が何度も現れる長い段落です"), (3, "x\nRead more\n \nok.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["dropped"] for r in queries.op5_line_repeats(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 2], 3: [1, 3]}


def test_line_repeats_recall(spark):
    """Near copies by brute-force edit similarity: one word or some letters changed, in lines of 5 to 60 words."""
    import random
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9)))
    lines = []
    for i in range(120):
        w = [word() for _ in range((5, 8, 14, 25, 60)[i % 5])]
        other = list(w)
        other[draw.randrange(len(w))] = word()
        letters = list(" ".join(w))
        for at in draw.sample(range(len(letters)), max(1, len(letters) // 20)):
            letters[at] = draw.choice("aeiou")
        lines += [" ".join(w), " ".join(other) if i % 2 else "".join(letters)]
    t = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    norm = t.select("doc_id", line_dedup.normal_line(F.col("text")).alias("x"))
    near = norm.join(norm.select(F.col("doc_id").alias("other"), F.col("x").alias("y")), F.col("doc_id") > F.col("other"))
    want = {r[0] for r in near.where(F.levenshtein("x", "y") <= 0.2 * F.greatest(F.length("x"), F.length("y"))).select("doc_id").collect()}
    got = {r["doc_id"] for r in line_dedup.repeat_counts(t).where("n_dropped = 1").collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.95 * len(want)


def test_far_hashes_lose_no_links(spark):
    """Lines that are alike are linked although their SimHashes are more than 24 bits apart (F5)."""
    import random
    draw, lines = random.Random(8), []
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    for _ in range(12):
        w = [word() for _ in range(40)]
        lines += [" ".join(w), " ".join(w[:8] + [x[:4] + ("x" if x[4] != "x" else "y") + x[5:] for x in w[8:]])]
    t = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    hashes = [r[0] for r in t.orderBy("doc_id").select(line_dedup.simhash(line_dedup.word_hashes(F.col("text")))).collect()]
    far = [bin(a ^ b).count("1") > 24 for a, b in zip(hashes[::2], hashes[1::2])]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.repeat_counts(t).collect()}
    assert sum(far) > 5 and got == {i: i % 2 for i in range(24)}


def test_short_lines_are_linked(spark, tmp_path):
    """Lines below 25 characters: every group of brute-force edit similarity, and no other (F5)."""
    import random
    from fieldgauge.llm import queries
    draw, lines = random.Random(2), []
    for i in range(120):
        line = [draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3 + i % 18)]
        lines.append("".join(line))
        for _ in range(draw.randint(1, 1 + len(line) // 5)):
            at = draw.randrange(len(line))
            line[at] = draw.choice(["", "q", line[at]]) + draw.choice(["", "z"])
        lines.append("".join(line)[:24])
    t = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    t.write.parquet(f"{tmp_path}/documents.parquet")
    two = t.join(t.select(F.col("doc_id").alias("other"), F.col("text").alias("y")), F.col("doc_id") < F.col("other"))
    root = list(range(len(lines)))
    for i, j in two.where(F.levenshtein("text", "y") <= F.floor(0.2 * F.greatest(F.length("text"), F.length("y")) + 1e-9)).select("doc_id", "other").collect():
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r["doc_id"]: r["n_dropped"] for r in queries.op5_line_repeats(spark, str(tmp_path)).collect()}
    assert got == {i: int(bool(x) and root[i] != i) for i, x in enumerate(lines)} and sum(got.values()) > 60


def test_crowded_keys_keep_all_lines(spark):
    """Lines whose only shared key is a crowded one still meet under it (F4)."""
    rows = [(name, 5, 30, [7, 1000 + name]) for name in range(100)] + [(200, 5, 30, [1]), (201, 5, 30, [1, 2])]
    t = spark.createDataFrame(rows, "name long, sim long, chars int, sketch array<long>")
    got = {(r["key"], r["name"], r["low"]) for r in line_dedup._members(t).collect()}
    assert got == {(7, name, 0) for name in range(100)} | {(1, 200, 200), (1, 201, 200)}


def test_common_words_make_no_pairs(spark, monkeypatch):
    """Unlike lines that share common words only are not paired; the pairs of op5_line_repeats exceeded its disk (round 3)."""
    import random
    draw, counts = random.Random(3), {}
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    lines = ["of man " + " ".join(f"{w} {word()}" for w in ("the", "and", "to", "in", "for", "on", "with", "at", "by")) for _ in range(200)]
    plain = line_dedup.written

    def counted(df, name):
        out = plain(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(line_dedup, "written", counted)
    got = line_dedup.repeat_counts(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert got.where("n_dropped > 0").count() == 0 and counts["line-pairs"] < 20


def _hash(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(line_dedup.simhash(line_dedup.word_hashes(F.col("t")))).first()[0]


def test_html(spark):
    site = "<nav><a>Home</a></nav><div id=x>{0}</div><p>{1}</p><div class='note'>Same words on all pages</div>"
    rows = [(1, "http://h/a/1", "<html><article><header><h1>T &amp; U</h1></header><p>a  b<br>c<script>x</p></script><form>f</form><div class='ad-box'>buy</div><p>d &eacute;</article><p>more"),
            (2, "http://h/b/1", site.format("One", "first text")), (3, "http://h/b/2", site.format("Two", "second text")), (4, None, None), (5, "odd", "plain <b>text"), (6, "http://h/b/2", site.format("Two", "second text")),
            (7, "http://z/", "<p title='a>b'>x &#233; <!-- no --> y</p><div class=comments><p>reader</p></div><div cla")]
    t = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).coalesce(1)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(t).collect()}
    assert got[1] == "T & U\na b\nc\nd é" and got[4] == "" and got[5] == "plain text" and got[7] == "x é y"
    assert got[2] == "One\nfirst text" and got[3] in ("Two\nsecond text", "Two\nsecond text\nSame words on all pages")
    assert html_extract.shared_lines(list("abcabd"), list("xbcad")) == {1, 2, 3, 5} and html_extract.shared_lines(["x"] * 3, ["x"] * 2) == {0, 1} and html_extract.extract(t.limit(0)).count() == 0


def test_html_differences_marked_pages(spark):
    """Pages that mark an article are differenced too; the marks restore and remove lines after that."""
    site = "<p>Menu of all</p><article><p>{0}</p><p>shared words</p></article><p>{1}</p><p>End of all</p>"
    rows = [(1, "http://h/a", site.format("first", "one")), (2, "http://h/b", site.format("second", "two")), (3, "http://z/", site.format("third", "three"))]
    t = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r for r in html_extract.page_texts(t).collect()}
    assert [got[i]["text"] for i in (1, 2, 3)] == ["first\nshared words", "second\nshared words", "third\nshared words"]
    assert got[3][-3:] == (0, 0, 3) and {got[i][-3:] for i in (1, 2)} <= {(3, 1, 1), (0, 0, 3)} and got[1][-3:] == got[2][-3:]
    assert html_extract.main_text([("a", False), ("b", True), ("c", True), ("d", False)], [("a", False), ("b", True)]) == ("b\nc", 2, 1, 1)


def test_lm(spark, docs, none):
    got = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r for r in lm_score.lm_scores(docs, frequent=40).collect()}
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    texts = [(r[0], WORD.findall(low(r[1])) + [None]) for r in base()]
    c = Counter(w for i, t in texts if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts:
        r = got[(i, len(t), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6))]
        assert r["held_out"] == held(i) and r["n_known"] == sum(c[w] > 0 for w in t) and r["train_tokens"] == n and r["score"] < 0
    assert lm_score.lm_scores(none).count() == 0


def test_lm_is_a_distribution():
    """Class probabilities over all next classes sum to one, at every step, and lanes do not change a text's score."""
    import numpy as np
    net, prior = lm_score.Net.fresh(), np.full(lm_score.CLASSES, 1 / lm_score.CLASSES)
    seq = np.array([3, 9, 3, 61], np.uint8)
    alone = lm_score.class_scores(net, seq, np.array([0, 4]), prior)[0]
    beside = lm_score.class_scores(net, np.concatenate((seq, np.full(90, 7, np.uint8), seq)), np.array([0, 4, 94, 94, 98]), prior)
    assert abs(alone - beside[0]) < 1e-5 and abs(alone - beside[3]) < 1e-5
    first = [lm_score.class_scores(net, np.array([k], np.uint8), np.array([0, 1]), prior)[0] for k in range(lm_score.CLASSES)]
    ends = lm_score.class_scores(net, np.empty(0, np.uint8), np.array([0, 0]), prior)[0]
    after = [lm_score.class_scores(net, np.array([5, k], np.uint8), np.array([0, 2]), prior)[0] - lm_score.class_scores(net, np.array([5], np.uint8), np.array([0, 1]), prior)[0] for k in (1, 2)]
    assert ends < 0 and len(first) == lm_score.CLASSES and all(np.isfinite(after))


def test_language(spark, docs, none):
    got = [r.asDict() for r in language_id.predictions(docs).collect()]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (103, 104, 105))
    assert all(0 <= r["score"] <= 1 for r in got) and language_id.predictions(none).count() == 0
    assert {r["lang_pred"] for r in language_id.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    train = "the cat sat on the mat and the dog sat too"
    m = language_id.Languages({"en": [train], "fr": ["le chat est sur le tapis et le chien aussi"]})

    def phrases(text, known):
        at = n = 0
        while at < len(text):
            size = 1
            while at + size <= len(text) and text[at:at + size] in known:
                size += 1
            n, at = n + 1, at + max(1, size - 1)
        return n
    known = m.codes[language_id.letters_of(train)].tobytes()
    for text in ("the cat", "zebra theca tsat", "le chien et the dog", "日本"):
        s = language_id.letters_of(text)
        assert m.phrases([s])[0, 0] == phrases(m.codes[s].tobytes(), known)


def test_language_accuracy(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hits = language_id.predictions(t).join(t.select("doc_id", "lang"), "doc_id").where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("double").alias("hit"))
    assert hits.agg(F.avg("hit")).first()[0] > 0.9


def test_quality_counts_and_verdict(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(200, 0, 0), (201, 0, 0), (202, None, 0), (None, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    junk = spark.createDataFrame([(200 + k, " ".join(f"a{k}{j}### $$$" for j in range(60)), "en", "s", 1) for k in range(3)], DOCS)
    out = quality.judge(docs.union(junk).withColumn("kept", F.lit("clash")), labels)
    rows = [r.asDict() for r in out.collect()]
    texts = {r[0]: r[1] for r in base()}
    for r in rows:
        if r["doc_id"] in texts and r["doc_id"] is not None:
            text = texts[r["doc_id"]] or ""
            w = WORD.findall(text)
            seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
            cover = {k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
            full = [x for x in text.split("\n") if WORD.search(x)]
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(cover), len(full) - len(set(full)))
            assert r["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
    assert not any(r["kept"] for r in rows if (r["doc_id"] or 0) >= 200) and all(r["kept"] for r in rows if r["doc_id"] in range(40) and not r["base_failed"])
    assert quality.judge(none, labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == len(base())


def test_quality_threshold_from_all_labels(spark):
    """The sample grows the forest only: whatever its size, all labelled rows set the threshold, rare bad ones too."""
    import random
    draw = random.Random(3)
    rows = [(i, " ".join(("W" if draw.random() < i / 3000 else "w") + f"{draw.randrange(10 ** 6)}" + "!" * (draw.random() < i / 4000) for _ in range(60)), "en", "s", 1) for i in range(600)]
    bad = [(1000 + k, " ".join(f"A{k}{j}### $$$" for j in range(60)), "en", "s", 1) for k in range(2)]
    labels = spark.createDataFrame([(i, 1) for i in range(600)] + [(1000, 0), (1001, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + bad, DOCS)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels, sample_rows=60, clean_loss=0.0, keep=["doc_id"]).collect()}
    assert all(got[i] for i in range(600)) and not got[1000] and not got[1001]
    scores = [0.1 * (i * 37 % 101) for i in range(101)] + [3.0] * 40
    t = spark.createDataFrame([(x,) for x in scores], "score double").repartition(4)
    assert [quality.kth_lowest(t, k, parts=3) for k in (0, 31, 60, 140)] == [sorted(scores)[k] for k in (0, 31, 60, 140)]


@pytest.mark.parametrize("shards", [1, 4, 24])
def test_shards(spark, docs, none, shards):
    many = spark.createDataFrame([(1000 + i, "the same text", "en", "s", 1) for i in range(2000)], DOCS).union(docs)
    rows = sharding.shard_sizes(many, shards).collect()
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    for s in range(shards):
        assert abs(sum(r["size"] for r in rows if r["shard"] == s) - total / shards) <= 0.01 * total / shards + largest
    texts = {r[0]: r[1] for r in base()}
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows if r["doc_id"] in texts)
    out = sharding.shard_documents(docs.withColumn("slot", F.lit("clash")), shards)
    assert out.count() == len(base()) and sharding.shard_sizes(none, shards).count() == 0
