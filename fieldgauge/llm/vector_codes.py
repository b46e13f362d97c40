"""Vector code compression: product codes over integer parts, with nearest entries found by an integer Walsh-Hadamard transform.

A component x counts as the integer floor(scale * x). Vectors are cut into equal consecutive parts; a part's codebook has up to
``entries`` entries, first those of the smallest ids, then moved by ``rounds`` of assignment and floored means. To assign, parts and
entries are padded with zeros to a power of two, P, and transformed by additions and subtractions alone. As the transform keeps
P times the squared distance, squared differences of the coefficients are added up in sequency order (slow changes first, where most
of the difference lies), and an entry is dropped from a part's race as soon as its sum so far exceeds the whole sum of the entry that
led after the first coefficients. An entry with an equal sum is never dropped, so ties go to the lower index. All of it is exact: 64-bit integers
where the largest component proves that no sum can leave them, Python integers elsewhere.

A round is one pass over the written vectors. A task adds up its parts by entry, Spark adds up the tasks' sums, and the driver takes
parts x entries x width numbers, whatever the number of vectors.

Defined results: rows whose vector is null, or holds a null, NaN or infinite component, are dropped; all others are kept, repeated rows
and null ids included. A repeated id starts one entry, its smallest vector; null ids come last. Shorter vectors are padded with zeros to the
longest one, and that to a multiple of ``parts``. Fewer ids than entries give fewer entries. An error beyond a 64-bit integer becomes null.
Empty tables give no rows. Further columns are carried; the operator's own win where names clash.
"""
from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import written

_LONG = 1 << 63
LEAD = 2  # coefficients after which an entry leads


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite numbers, for a scale that is a power of two: 64-bit integers, or Python's where they would not fit."""
    if not len(values) or float(np.abs(values).max()) < 2.0 ** 50 / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0 ** 53 else math.floor(x * scale) for x in values.tolist()]
    return np.array(exact, dtype=object)


def by_sequency(size: int) -> np.ndarray:
    """Places of the transform's coefficients, those with the fewest sign changes first."""
    at = np.arange(size)
    signs = np.array([[bin(i & j).count("1") & 1 for j in at] for i in at])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(1), kind="stable")


def transformed(parts: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, padded with zeros to a power of two, in sequency order."""
    width = parts.shape[1]
    size = 1 << max(0, (width - 1).bit_length())
    out = np.zeros((len(parts), size), parts.dtype)
    out[:, :width] = parts
    step = 1
    while step < size:
        pairs = out.reshape(len(parts), size // (2 * step), 2, step)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(len(parts), size)
        step *= 2
    return out[:, by_sequency(size)]


def safe(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if no sum of squares can leave them, else as Python integers."""
    size = 1 << max(0, (max(1, parts.shape[1]) - 1).bit_length())
    most = max((int(abs(a).max()) for a in (parts, book) if a.size), default=0)
    kind = np.int64 if (2 * most * size) ** 2 * size < 1 << 62 else object
    return parts.astype(kind), book.astype(kind)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (ties: the lowest), and the squared distance."""
    parts, book = safe(parts, book)
    a, b = transformed(parts), transformed(book)
    size, lead = a.shape[1], min(LEAD, a.shape[1])
    first = sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(lead))
    leader = first.argmin(1)
    every = np.arange(len(a))
    bound = first[every, leader] + ((a[:, lead:] - b[leader, lead:]) ** 2).sum(1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    for k in range(lead, size):
        total = total + (a[row, k] - b[entry, k]) ** 2
        stays = total <= bound[row]
        row, entry, total = row[stays], entry[stays], total[stays]
    best = np.full(len(a), None, object) if total.dtype == object else np.full(len(a), np.iinfo(np.int64).max)
    code = np.zeros(len(a), np.int64)
    for e in range(len(b) - 1, -1, -1):  # the lowest index last, so that it wins ties
        mine = entry == e
        at, sums = row[mine], total[mine]
        better = np.array([best[i] is None or s <= best[i] for i, s in zip(at, sums)], bool) if total.dtype == object else sums <= best[at]
        best[at[better]], code[at[better]] = sums[better], e
    return code, best // size


@dataclass
class Codebooks:
    """``entries[part]`` is a list of entries, each a list of ``width`` integers."""
    entries: list[list[list[int]]]
    width: int
    scale: int

    @property
    def parts(self) -> int:
        return len(self.entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def arrays(self) -> list[np.ndarray]:
        return [np.array(part, dtype=object).reshape(len(part), self.width) for part in self.entries]


def _matrix(lists: pa.Array, length: int, scale: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of integers, padded to ``length``."""
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    flat = integers(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
    out = np.zeros((len(sizes), length), flat.dtype)
    out[np.arange(length)[None, :] < sizes[:, None]] = flat
    return out


def kept_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null and has finite components only."""
    x = F.col(column)
    return vectors.where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))))


def limbs(number: int) -> list[int]:
    """``number`` as 64-bit integers, the k-th of them to be multiplied by 2 ** (60 k)."""
    out = []
    while not -(1 << 62) < number < 1 << 62:
        out.append(number & ((1 << 60) - 1))
        number >>= 60
    return [*out, number]


def _sums(books: Codebooks):
    arrays, width = books.arrays(), books.width

    def run(batches):
        counts = [np.zeros(len(a), object) for a in arrays]
        totals = [np.zeros((len(a), width), object) for a in arrays]
        for b in batches:
            vectors = _matrix(b.column(0), width * len(arrays), books.scale)
            for p, book in enumerate(arrays):
                mine = vectors[:, p * width:(p + 1) * width]
                code, _ = nearest(mine, book)
                for e in range(len(book)):
                    chosen = mine[code == e]
                    counts[p][e] += len(chosen)
                    if len(chosen):
                        # halves of 32 bits, so that no batch can overflow
                        totals[p][e] += chosen.sum(0) if chosen.dtype == object else ((chosen >> 32).sum(0).astype(object) << 32) + (chosen & 0xFFFFFFFF).sum(0).astype(object)
        rows = [(p, e, k, limb, int(counts[p][e]), x) for p in range(len(arrays)) for e in range(len(arrays[p])) if counts[p][e]
                for k, t in enumerate(totals[p][e]) for limb, x in enumerate(limbs(int(t)))]
        kinds = [pa.int32()] * 4 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "entry", "place", "limb", "n", "value"])
    return run


def moved(vectors: DataFrame, column: str, books: Codebooks) -> Codebooks:
    """The codebooks after one round: entries become the floored means of their parts, unused ones stay."""
    sums = vectors.select(column).mapInArrow(_sums(books), "part int, entry int, place int, limb int, n long, value long")
    found = sums.groupBy("part", "entry", "place", "limb").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    total, counts = defaultdict(int), {}
    for r in found:
        total[r["part"], r["entry"], r["place"]] += int(r["value"]) << 60 * r["limb"]
        counts[r["part"], r["entry"]] = max(counts.get((r["part"], r["entry"]), 0), r["n"])  # higher limbs come from some tasks only
    entries = [[list(e) for e in part] for part in books.entries]
    for (part, entry, place), t in total.items():
        entries[part][entry][place] = t // counts[part, entry]
    return Codebooks(entries, books.width, books.scale)


def start_books(vectors: DataFrame, column: str, id_col: str, parts: int, entries: int, scale: int) -> Codebooks:
    """Codebooks of the parts of the smallest ids' vectors."""
    longest = vectors.agg(F.max(F.size(column))).first()[0] or 0
    width = -(-longest // parts)
    slim = vectors.select(F.col(id_col).alias("id"), F.col(column).alias("vector"))
    least: dict = {}
    rest = slim.where(F.col("id").isNotNull())
    while len(least) < entries and (rows := rest.orderBy("id", "vector").limit(entries).collect()):  # one pass, unless ids repeat
        for r in rows:
            least.setdefault(r["id"], r["vector"])
        rest = slim.where(F.col("id") > F.lit(rows[-1]["id"]))
    least = dict(list(least.items())[:entries])
    if len(least) < entries:
        least |= {None: r["vector"] for r in slim.where(F.col("id").isNull()).orderBy("vector").limit(1).collect()}
    rows = [integers(np.array(list(v) + [0.0] * (width * parts - len(v)), np.float64), scale).tolist() for v in least.values()]
    return Codebooks([[r[p * width:(p + 1) * width] for r in rows] for p in range(parts)], width, scale)


def encode(vectors: DataFrame, column: str, books: Codebooks) -> DataFrame:
    """``vectors`` plus code (two hex digits for each part) and error (squared distances added up over the parts)."""
    arrays, width = books.arrays(), books.width
    own = ("code", "error")
    carried = [c for c in vectors.columns if c not in own]
    out = vectors.select(*[F.col(c).alias(f"in_{c}") for c in carried], F.col(column).alias("vector"))
    if not arrays or not len(arrays[0]):
        coded = out.select("*", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        def run(batches):
            for b in batches:
                whole = _matrix(b.column(b.num_columns - 1), width * len(arrays), books.scale)
                found = [nearest(whole[:, p * width:(p + 1) * width], book) for p, book in enumerate(arrays)]
                digits = np.array([f"{e:02x}" for e in range(max(map(len, arrays)))], object)
                codes = ["".join(c) for c in zip(*[digits[code] for code, _ in found])]
                errors = [x if x < _LONG else None for x in map(int, sum(d.astype(object) for _, d in found))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*b.schema.names[:-1], *own])
        schema = StructType([*out.drop("vector").schema.fields, *StructType.fromDDL("code string, error long").fields])
        coded = out.mapInArrow(run, schema)
    return coded.select(*[F.col(f"in_{c}").alias(c) for c in carried], *own)


def learn(vectors: DataFrame, column: str = "embedding", id_col: str = "vec_id", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks of vectors that are all kept; ``vectors`` is read ``rounds`` + 2 times, so it should be a table. Up to 256 entries."""
    if not 0 < entries <= 256 or scale & (scale - 1):
        raise ValueError("entries must be 1 to 256, and scale a power of two")
    books = start_books(vectors, column, id_col, parts, entries, scale)
    for _ in range(rounds if books.entries[0] else 0):
        books = moved(vectors, column, books)
    return books


def compress(vectors: DataFrame, column: str = "embedding", id_col: str = "vec_id", **settings) -> tuple[DataFrame, Codebooks]:
    """The kept rows plus code and error, and the codebooks; ``settings`` are those of ``learn``."""
    kind = dict(vectors.dtypes)[column]
    if kind not in ("array<float>", "array<double>"):
        vectors = vectors.withColumn(column, F.col(column).cast("array<double>"))
    kept = written(kept_vectors(vectors, column), "vectors")
    books = learn(kept, column, id_col, **settings)
    return encode(kept, column, books), books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """The digest of each kept vector: code, error, the error of its label, and the codebooks' hash."""
    found, books = compress(vectors.select("vec_id", "embedding", "label"))
    rows = written(found.select("vec_id", "label", "code", "error"), "vector-codes")
    # written, so that Spark knows the size of the sums when it picks the join
    labels = written(rows.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("whole")), "label-errors")
    total = F.when(F.col("whole") < F.lit(str(_LONG)).cast("decimal(38,0)"), F.col("whole")).cast("long")
    return rows.join(labels, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", total.alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same by plain distances to all entries, round after round."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"p AS MATERIALIZED (SELECT id, vec_id, part, w[part * len(w) // {parts} + 1:(part + 1) * len(w) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS part))",
             f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries})"]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT id, part, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (SELECT id, p.part, e, list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d
    FROM p JOIN b{k} USING (part)) GROUP BY id, part)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (SELECT part, e, i, sum(y)::BIGINT AS s, count(*) AS n
    FROM (SELECT part, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM p JOIN a{k} USING (id, part)) GROUP BY part, e, i) GROUP BY part, e),
b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, e))""")
    last = f"""r AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN r USING (id), h"""
    return "WITH " + ",\n".join(steps) + ",\n" + last


CODES_SQL = _codes_sql()
