"""Evaluation-shaped views derived from the given tables (orders as documents, perturbed orders as predictions)."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import jsonvals as J, text as T
from ..schema import schema_leaves

SCHEMA = {
    "type": "object",
    "required": ["total", "status", "customer"],
    "properties": {
        "total": {"type": "number", "minimum": 0, "maximum": 450000},
        "order_date": {"type": "string", "format": "date"},
        "status": {"type": "string", "enum": ["F", "O", "P"]},
        "priority": {"type": "string", "pattern": "^[1-5]-"},
        "customer": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "maxLength": 18}}},
        "currency": {"type": "string", "format": "currency"},
    },
}
FIELDS = ["total", "order_date", "status", "priority", "customer.name", "currency"]


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A given table, read with Spark's own partition settings."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def width(self) -> int:
        """Partitions to deal rows out to before they are multiplied; given as a number, as Spark would otherwise join small partitions again."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @cached_property
    def leaves(self) -> DataFrame:
        return schema_leaves(self.spark, SCHEMA)

    @cached_property
    def base(self) -> DataFrame:
        """order x field with the true text ``v``.

        Orders are narrow and few against the rows made of them, so they are dealt out by document first; groupings by document need no
        further exchange.
        """
        o = self.table("orders").join(self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
        total = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
        texts = [total, F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus"), F.col("o_orderpriority"),
                 F.col("c_name"), F.lit("USD")]
        rows = F.array(*[F.struct(F.lit(i + 1).alias("f"), F.lit(p).alias("field_path"), t.alias("v"))
                         for i, (p, t) in enumerate(zip(FIELDS, texts))])
        known = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("document_id"),
                         "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority", "c_name").repartition(self.width, "document_id")
        return known.select("k", "document_id", F.explode(rows).alias("x")).select("k", "document_id", "x.*")

    @cached_property
    def documents(self) -> DataFrame:
        """One document per order."""
        return self.table("orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("document_id"))

    @staticmethod
    def _json(f, v):
        return F.when(f == 1, v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))

    @cached_property
    def truth_all(self) -> DataFrame:
        """Every revision: two for k%7=0 (revision 1 has a suffix), else one; k%23=0 has no truth."""
        k, f, v = F.col("k"), F.col("f"), F.col("v")
        revs = F.when(k % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        b = self.base.where((k % 23 != 0) & ((k + f) % 13 != 0)).withColumn("revision", F.explode(revs))
        old = (k % 7 == 0) & (F.col("revision") == 1)
        value = (F.when((k * 7 + f) % 19 == 0, "null")
                 .when(old & (f != 1), F.concat(F.lit('"'), v, F.lit('x"')))
                 .otherwise(self._json(f, v)))
        return b.select("k", "document_id", "f", "field_path", "revision", value.alias("value_json"),
                        F.when(k % 11 == 0, "unverified").otherwise("complete").alias("annotation_status"))

    @cached_property
    def truth(self) -> DataFrame:
        """Latest revisions, read directly: the newest is known from k."""
        return self.truth_all.where(F.col("revision") == F.when(F.col("k") % 7 == 0, 2).otherwise(1))

    def _predicted(self, base: DataFrame, columns: list) -> DataFrame:
        """Perturbed true values of ``base``, whose column ``r`` is the run; rows are right, wrong, variants, padded, near, invalid, null or absent."""
        k, f, v, r = F.col("k"), F.col("f"), F.col("v"), F.col("r")
        b = base.withColumn("h", (k * 31 + f * 17 + r * 5) % 20)
        h = F.col("h")
        dec = v.try_cast("decimal(12,2)")
        day = F.try_to_date(v, "yyyy-MM-dd")
        wrong = (F.when(f == 1, (dec + 100).cast("decimal(12,2)").cast("string"))
                 .when(f == 2, F.date_add(day, 1).cast("string")).otherwise(F.concat(v, F.lit(" x"))))
        variant = (F.when(f == 1, F.concat(F.lit("$"), v)).when(f == 2, F.date_format(day, "MM/dd/yyyy"))
                   .when(f == 5, F.upper(v)).when(f == 6, "$").otherwise(F.lower(v)))
        padded = (F.when(f == 1, v).when(f == 2, F.concat(F.lit("  "), v, F.lit(" ")))
                  .otherwise(F.concat(F.lit("  "), F.lower(v), F.lit(" "))))
        near = F.when(f == 1, (dec + F.lit("0.01").cast("decimal(12,2)")).cast("decimal(12,2)").cast("string")).when(f == 2, v).otherwise(F.concat(v, F.lit("z")))
        invalid = (F.when(f == 1, "n/a").when(f == 2, "not a date").when(f == 3, "Z").when(f == 6, "??").otherwise(v))
        text = (F.when(h == 1, wrong).when(h == 2, variant).when(h == 3, padded).when(h == 4, near).when(h == 5, invalid).otherwise(v))
        bare = (f == 1) & ~h.isin(2, 5)
        json = F.when(bare, text).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
        null_truth = (k * 7 + f) % 19 == 0
        value = (F.when(null_truth & ((k + r) % 9 == 0), self._json(f, v)).when(null_truth | (h == 0), "null").otherwise(json))
        conf = F.when((k + f + r) % 15 != 0, ((k * 37 + f * 11 + r * 3) % 101) / F.lit(100.0))
        out = (b.where(null_truth | (h != 0) | (k % 2 == 1))
               .select(*columns, "k", "document_id", "f", "field_path", J.apart(value, f).alias("value_json"), conf.alias("confidence")))
        return out

    def raw(self, r: int) -> DataFrame:
        """One run's predictions as they came, for readers that need no stored value."""
        return self._predicted(self.base.withColumn("r", F.lit(r)), []).drop("k", "f")

    def pred(self, r: int) -> DataFrame:
        """One run's predictions."""
        out = self._predicted(self.base.withColumn("r", F.lit(r)), [F.lit(f"run-{r}").alias("run_id")])
        return J.extraction_normalize(out, "value_json", F.when(F.col("f") == 1, "number").otherwise("string"))

    def branches(self, runs: tuple[int, ...]) -> DataFrame:
        """Raw predictions of several runs as branches 0, 1, ... of one plan."""
        named = F.array(*[F.struct(F.lit(i).alias("branch"), F.lit(r).alias("r")) for i, r in enumerate(runs)])
        base = self.base.select("k", "document_id", "f", "field_path", "v", F.inline(named))
        return self._predicted(base, ["branch"]).drop("k", "f")


    def extractions(self, r: int) -> DataFrame:
        k = F.col("o_orderkey")
        model = F.element_at(F.array(*[F.lit(m) for m in ("gpt-4.1-mini", "gpt-4o-2024-08-06", "claude-haiku-4-5", "house-model")]), (k % 4 + 1).cast("int"))
        provider = F.element_at(F.array(*[F.lit(m) for m in ("openai", "openai", "anthropic", "local")]), (k % 4 + 1).cast("int"))
        return self.table("orders").select(
            F.lit(f"run-{r}").alias("run_id"), k.alias("k"), F.concat(F.lit("o"), k.cast("string")).alias("document_id"),
            F.concat(F.lit(f"x{r}-"), k.cast("string")).alias("extraction_id"),
            (500 + (k * 13 + r * 7) % 4000).alias("latency_ms"), (200 + k % 3000).alias("input_tokens"), (20 + k % 200).alias("output_tokens"),
            model.alias("model"), F.when((k % 4 == 3) & (k % 8 == 7), "openai").otherwise(provider).alias("provider"),
            (k % 10 == 0).alias("cache_hit"), F.when(k % 17 == 0, (k % 100) / F.lit(1000.0)).alias("cost_usd"))

    @cached_property
    def runs(self) -> DataFrame:
        """Runs derived from order keys: run i groups orders with k % 8 = i of each priority."""
        k = F.col("o_orderkey")
        i = (k % 8).cast("int")
        t = self.table("orders").groupBy(i.alias("i"), F.col("o_orderpriority").alias("group_id")).agg(
            F.count(F.lit(1)).alias("documents"), F.sum((F.col("o_totalprice").cast("decimal(12,2)") * 100).cast("long") % 1000).alias("s"))
        i = F.col("i")
        return t.select(
            F.concat(F.col("group_id"), F.lit("/r"), i.cast("string")).alias("run_id"), "group_id",
            F.when(i != 6, F.concat(F.col("group_id"), F.lit("/e"), (i % 3).cast("string"))).alias("experiment_id"),
            F.concat(F.lit("ds-"), F.col("group_id")).alias("dataset_id"),
            F.concat(F.lit("2024-01-0"), (i + 1).cast("string")).alias("created_at"),
            F.when(i == 5, "failed").otherwise("completed").alias("status"),
            F.when(i == 4, "b").otherwise("a").alias("fingerprint"),
            F.when(i != 7, F.col("s") % 1000 / F.lit(1000.0)).alias("score"), "documents",
            F.when(i != 3, F.col("documents") / F.lit(100.0)).alias("cost_usd"))

    @cached_property
    def steps(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("document_id"),
            F.col("l_linenumber").alias("pos"), (F.col("l_linenumber") * 700).cast("long").alias("start_ms"),
            (100 + F.col("l_partkey") % 1500).alias("latency_ms"),
            F.element_at(F.array(F.lit("extract"), F.lit("parse"), F.lit("validate")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("kind"),
            F.when(F.col("l_suppkey") % 29 == 0, "failed").otherwise("completed").alias("status"),
            F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"))

    @cached_property
    def docs(self) -> DataFrame:
        """Text documents with content hash, name, type, dataset, tags and folder."""
        d = F.col("doc_id")
        ext = F.element_at(F.array(*[F.lit(e) for e in ("txt", "html", "pdf", "bin")]), (d % 4 + 1).cast("int"))
        return self.table("documents").select(
            F.concat(F.lit("d"), d.cast("string")).alias("document_id"), d.alias("n"), "text", F.sha2("text", 256).alias("sha256"),
            F.concat(F.lit("doc "), d.cast("string"), F.when(d % 5 == 0, "#").otherwise(""), F.lit("."), ext).alias("filename"),
            F.col("source").alias("dataset_id"), "lang", F.array("lang", F.concat(F.lit("p"), (d % 3).cast("string"))).alias("tags"),
            F.concat("source", F.lit("/"), F.col("lang"), F.lit("/")).alias("folder"),
            F.when(d % 3 == 0, F.concat(F.lit("solo"), d.cast("string"))).otherwise(F.concat(F.lit("fam"), (d % 97).cast("string"))).alias("family"), d.alias("created_at"))

    @cached_property
    def members(self) -> DataFrame:
        """Dataset members, unique by content: the oldest document of every hash."""
        from ..operators.ranking import latest
        return latest(self.docs.drop("text"), ["sha256"], -F.col("n"))

    @cached_property
    def blocks(self) -> DataFrame:
        """Document lines as layout blocks, 40 lines to a page."""
        lines = self.table("documents").select(
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        page = (1 + F.floor(F.col("line_no") / 40)).cast("int")
        top = F.col("line_no") % 40
        return (lines.withColumn("text", F.trim(F.col("line"))).where(F.col("text") != "")
                .select("document_id", page.alias("page"), F.concat(F.lit("b"), F.col("line_no").cast("string")).alias("block_id"),
                        F.col("line_no").alias("source_index"), "text",
                        F.when(F.col("line_no") % 7 != 6, F.array(F.lit(0.06), F.round(0.06 + top * 0.02, 4), F.lit(0.94), F.round(0.09 + top * 0.02, 4))).alias("bbox"),
                        F.when(F.col("line_no") % 5 == 0, "inferred").otherwise("parser").alias("bbox_source")))
