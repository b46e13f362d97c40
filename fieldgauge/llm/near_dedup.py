"""MinHash near-dedup by bottom-k sketches of one hash function.

A text's set holds its distinct five-word shingles, as 64-bit hashes; its sketch is the k lowest of them. Texts with one and the same
set are one class. Classes that share a retained value meet in that value's inverted list; the union sketch of two classes estimates
their similarity, and the full sets confirm it. Linked classes form components, which are named after their lowest doc_id.

How the lists stay short without losing a link: two sets at or above the threshold share at least ``fewest`` values of their sketches
(exactly where sketches hold whole sets; six standard deviations below the expectation otherwise). So a class is listed only under its
rarest retained values, as many as such a pair cannot all miss, and classes with too few shared values are left out early, judged by
their ``screen`` lowest values. A common passage is thereby never a list of its own for texts that hold other words as well.

How a group of near copies avoids all pairs: each list first compares its members with one pivot, the most central one (whose values
are the most common). Then only members that did not join the pivot's component are compared with the others of other components,
and only where sizes and places in the two value orders still allow the needed overlap. No list or component reaches the driver.

Defined results: a null or empty text has an empty set and is linked with nothing; a text of fewer words is one shingle; documents
with a null doc_id take part, and a component of such rows alone has a null component_id; equal rows are linked and share their
verdict (``dedup`` then keeps one); an empty table gives an empty result; further columns are carried along by ``dedup``.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import mixed, runs, words
from .store import added, written

SHINGLE = 5
BITS = 1 << 25


def shingle_sets(texts):
    """The sorted distinct shingle hashes (signed 64-bit) of each text."""
    for w in words(texts):
        h, at = runs(w, SHINGLE)
        h, cut, n = h.view(np.int64), np.searchsorted(at, w.word_at), w.counts
        for i in range(len(n)):
            if n[i] >= SHINGLE:
                yield np.unique(h[cut[i]:cut[i + 1]])
            elif n[i]:
                one = np.full(1, int(n[i]), np.uint64)
                for x in w.hash[w.word_at[i]:w.word_at[i + 1]]:
                    one = mixed(one * np.uint64(5) + x)
                yield one.view(np.int64)
            else:
                yield np.empty(0, np.int64)


def class_name(s: np.ndarray) -> str | None:
    u = s.view(np.uint64)
    return f"{int(mixed(u).sum(dtype=np.uint64)):016x}{int(mixed(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)):016x}" if len(s) else None


def fewest(n: Column, k: int, percent: int) -> Column:
    """Least number of shared values among the k lowest of a set of n and of any partner at the threshold."""
    t = percent / 100
    guess = max(1, math.floor(t * k - 6 * math.sqrt(k * t * (1 - t))))
    whole = F.ceil(n * percent / 100)
    return F.when(n <= int(t * k), whole).otherwise(F.least(whole, F.lit(guess))).cast("int")


def fewest_of_pair(a: Column, b: Column, k: int, percent: int) -> Column:
    t = percent / 100
    guess = max(1, math.floor(t * k - 6 * math.sqrt(k * t * (1 - t))))
    return F.when(F.greatest(a, b) <= k, F.ceil((a + b) * percent / (100 + percent))).otherwise(F.lit(guess)).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): contract every node to its lowest neighbour until no edge is left; each round leaves at
    most half of the nodes, and every round is written to the shared folder."""
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    steps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to"))
        step = written(step, "step")
        steps.append(step)
        edges = (edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
                 .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        edges = written(edges, "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are at or above the threshold."""
    t = percent / 100
    sketch = sets.select("name", "n", F.slice("values", 1, k).alias("low"))
    two = (pairs.join(sketch.select(F.col("name").alias("a"), F.col("n").alias("n_a"), F.col("low").alias("low_a")), "a")
           .join(sketch.select(F.col("name").alias("b"), F.col("n").alias("n_b"), F.col("low").alias("low_b")), "b"))
    shared = F.size(F.array_intersect("low_a", "low_b"))
    lowest = F.slice(F.sort_array(F.array_union("low_a", "low_b")), 1, k)
    # the highest value of the union sketch, computed once for a pair, then the shared values up to it
    hits = F.element_at(F.transform(F.array(F.element_at(lowest, -1)), lambda top: F.size(F.filter(F.array_intersect("low_a", "low_b"), lambda x: x <= top))), 1)
    sure = 100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)  # sketches that hold whole sets need no estimate
    likely = hits / F.least(F.lit(k), F.size(lowest)) >= t - 5 * math.sqrt(t * (1 - t) / k)
    two = two.withColumn("whole", F.greatest("n_a", "n_b") <= k)
    two = two.where(F.when(F.col("whole"), sure).otherwise(likely)).select("a", "b", "n_a", "n_b", "whole")
    two = written(two, "estimates")
    full = two.where(~F.col("whole")).select("a", "b", "n_a", "n_b")
    full = (full.join(sets.select(F.col("name").alias("a"), F.col("values").alias("all_a")), "a").join(sets.select(F.col("name").alias("b"), F.col("values").alias("all_b")), "b"))
    both = F.size(F.array_intersect("all_a", "all_b"))
    return two.where("whole").select("a", "b").union(full.where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b"))


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """BITS bits, set at the remainders of ``h``; they come to the driver as at most BITS / 32768 pieces of 4 kB."""
    at = hashes.select(F.pmod("h", F.lit(BITS)).alias("at"))
    pieces = at.groupBy(F.floor(F.col("at") / 32768).alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in pieces:
        out[r["piece"] * 4096:(r["piece"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 1024, screen: int = 64) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, class_name (equal sets), group_name (linked classes)."""
    t, spark = percent / 100, docs.sparkSession

    def sketches(texts):
        found = [(len(s), class_name(s), s[:screen]) for s in shingle_sets(texts)]
        return {"n": [x[0] for x in found], "name": [x[1] for x in found], "low": [x[2] for x in found]}

    seen = written(added(docs.select("doc_id", "text"), "n long, name string, low array<bigint>", lambda: sketches, ["text"], ("text",)), "sketches")
    classes = seen.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "classes")
    # one document stands for its class; equal rows and null ids may stand twice, which only makes more values count as shared
    code = F.conv(F.substring("name", 1, 15), 16, 10).cast("long")
    stands = classes.select(F.col("name").alias("_name"), "first_id")
    single = seen.where("n > 0").join(stands, (F.col("name") == F.col("_name")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    listed = single.select(F.explode("low").alias("value"), code.alias("code"), fewest(F.col("n"), screen, percent).alias("need"))
    shared = written(listed.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("value"), "shared-values")
    able = listed.join(shared, "value").groupBy("code").agg(F.count(F.lit(1)).alias("have"), F.max("need").alias("need")).where("have >= need").select("code")
    able = classes.withColumn("code", code).join(able, "code", "left_semi").select("name", "first_id")
    able = written(able, "able")

    # whole sets of those documents only: a bit map of fixed size, over hashed ids, spares the others without moving any text
    bits = spark.sparkContext.broadcast(_bit_map(able.select(F.xxhash64("first_id").alias("h"))))

    def whole(texts, places):
        at = np.array(places, np.int64)
        wanted = (bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 if len(at) else at
        found = [(class_name(s), len(s), s) for s in shingle_sets([t if w else None for t, w in zip(texts, wanted)])]
        return {"name": [x[0] for x in found], "n": [x[1] for x in found], "values": [x[2] for x in found]}

    texts = docs.where("text IS NOT NULL").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("place"))
    sets = added(texts, "name string, n int, values array<bigint>", lambda: whole, ["text", "place"], ("text", "place")).where("name IS NOT NULL")
    sets = sets.join(able.select("name"), "name", "left_semi").dropDuplicates(["name"])
    sets = written(sets, "sets")

    # inverted lists of the rarest retained values
    kept = sets.select("name", "n", F.least("n", F.lit(k)).alias("size"), F.explode(F.slice("values", 1, k)).alias("value"))
    common = written(kept.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common-values")
    order = kept.join(common, "value").groupBy("name", "n", "size").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("order"))  # at most k values
    order = order.withColumn("weight", F.aggregate("order", F.lit(0.0), lambda s, x: s + F.log(x["df"].cast("double"))))
    order = order.select("name", "n", "weight", "size", F.size("order").alias("met"), F.posexplode("order").alias("pos", "at"))
    place = F.col("size") - F.col("met") + F.col("pos")  # values that nobody shares come first
    lists = order.where(place <= F.col("size") - fewest(F.col("n"), k, percent)).select("name", "n", "weight", (F.col("size") - place).alias("rest"), F.col("at.value").alias("value"))
    lists = written(lists, "lists")

    def possible(a, b):  # sizes, and the values that are still to come in both orders, allow the needed overlap
        return ((F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent)
                & (F.least(a["rest"], b["rest"]) >= fewest_of_pair(a["n"], b["n"], k, percent)))

    def pairs(left, right, on):
        found = left.join(right, on)
        return found.select(F.least("l.name", "r.name").alias("a"), F.greatest("l.name", "r.name").alias("b")).distinct()

    pivots = lists.groupBy("value").agg(F.max(F.struct("weight", "name", "n", "rest")).alias("top"), F.count(F.lit(1)).alias("many")).where("many > 1")
    pivots = written(pivots.select("value", "top.name", "top.n", "top.rest"), "pivots")
    left, right = lists.alias("l"), pivots.alias("r")
    first = pairs(left, right, (F.col("l.value") == F.col("r.value")) & (F.col("l.name") != F.col("r.name")) & possible(*({c: F.col(f"{x}.{c}") for c in ("n", "rest")} for x in "lr")))
    links = written(_confirmed(first, sets, k, percent), "links")
    found = written(components(links), "components")

    # what did not join its list's pivot is compared with what is in other components
    named = lists.join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    centre = pivots.select("value", "name").join(found.withColumnRenamed("node", "name"), "name", "left").select("value", F.coalesce("root", "name").alias("centre"))
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(1.05)).cast("int")
    named = written(named.join(centre, "value").select("value", "name", "n", "rest", "root", (F.col("root") != F.col("centre")).alias("apart"), band(F.col("n")).alias("band")), "named-lists")
    most = F.when(F.col("n") <= t * k, F.least(F.col("n") / t, F.col("rest") * (1 + t) / t - F.col("n") + 1)).otherwise(F.col("n") / t)
    reach = named.where("apart").withColumn("most", F.greatest(most, F.lit(1.0)))
    low, high = band(F.greatest(F.col("n") * t, F.lit(1.0))), band(F.col("most") + 1e-6)
    reach = reach.where(high >= low).withColumn("band", F.explode(F.sequence(low, high)))
    on = ((F.col("l.value") == F.col("r.value")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.root") != F.col("r.root")) & (~F.col("r.apart") | (F.col("l.name") < F.col("r.name")))
          & possible(*({c: F.col(f"{x}.{c}") for c in ("n", "rest")} for x in "lr")))
    second = pairs(reach.alias("l"), named.alias("r"), on)
    more = written(_confirmed(second, sets, k, percent), "links")
    if not more.isEmpty():
        found = written(components(links.union(more)), "components")

    groups = classes.join(found.withColumnRenamed("node", "name"), "name", "left")
    groups = groups.where("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "name")).select("name", "root", "first_id")
    least = groups.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = groups.join(least, "root").select("name", "least_id", "root", F.lit(True).alias("grouped"))
    out = seen.select("doc_id", "n", "name").join(named, "name", "left")
    out = out.withColumn("component_id", F.when(F.col("grouped"), F.col("least_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("name").alias("class_name"), F.coalesce("root", "name").alias("group_name"))


def dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one with the lowest doc_id.

    Rows are told from their doc_id; only rows whose doc_id is null or comes more than once are looked at again, by their sets, and
    one row of each doc_id and group stays (of those without a word: one of each doc_id and text).
    """
    verdicts = written(near_duplicates(docs, percent), "verdicts")
    each = verdicts.groupBy("doc_id").agg(F.min("kept").alias("all_kept"), F.max("kept").alias("some_kept"), F.count(F.lit(1)).alias("many"))
    # what goes or needs a look is the smaller part: rows that simply stay match nothing here
    odd = each.where("NOT all_kept OR many > 1").select(F.col("doc_id").alias("_id"), "some_kept")
    columns = [f"in_{c}" for c in docs.columns]
    given = docs.select(*[F.col(c).alias(f"in_{c}") for c in docs.columns])
    beside = given.join(odd, F.col("in_doc_id").eqNullSafe(F.col("_id")), "left")
    single = beside.where("some_kept IS NULL").select(*columns)

    def names(texts):
        return {"_name": [class_name(s) for s in shingle_sets(texts)]}

    several = added(beside.where("some_kept").select(*columns), "_name string", lambda: names, ["in_text"])
    stay = verdicts.where("kept AND class_name IS NOT NULL").join(odd, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(F.col("class_name").alias("_name"), F.col("group_name").alias("_group")).distinct()
    several = several.join(stay, "_name", "left").where("_name IS NULL OR _group IS NOT NULL").withColumn("_group", F.coalesce("_group", F.concat(F.lit("text "), F.coalesce("in_text", F.lit("")))))
    return single.union(several.dropDuplicates(["in_doc_id", "_group"]).select(*columns)).toDF(*docs.columns)


DEDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, least(doc_id, min(other)) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
