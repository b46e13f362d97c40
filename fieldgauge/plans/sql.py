"""SQL for the oracles: the same views as common table expressions, written independently of the Spark code."""
from __future__ import annotations

FIELDS_SQL = """(VALUES (1,'total'),(2,'order_date'),(3,'status'),(4,'priority'),(5,'customer.name'),(6,'currency')) fl(f, field_path)"""


def txt(x):
    return f"CASE WHEN {x} = 'null' THEN NULL WHEN {x}[1] = '\"' THEN substr({x}, 2, length({x}) - 2) ELSE {x} END"


def ntext(x):
    return rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"


def dectext(x):
    return rf"regexp_replace(CAST({x} AS VARCHAR), '\.?0+$', '')"


def num(x):
    return f"try_cast(trim(replace(replace({x}, ',', ''), '$', '')) AS DECIMAL(38,10))"


def iso(x):
    return f"strftime(try_strptime(trim({x}), ['%Y-%m-%d','%Y/%m/%d','%m/%d/%Y','%m/%d/%y','%b %d, %Y','%B %d, %Y']), '%Y-%m-%d')"


def cur(x):
    u = f"upper(trim({x}))"
    return (f"CASE WHEN {u} IN ('$','US$') THEN 'USD' WHEN {u} = '€' THEN 'EUR' WHEN {u} = '£' THEN 'GBP' WHEN {u} = '¥' THEN 'JPY' "
            f"WHEN regexp_full_match({u}, '[A-Z]{{3}}') THEN {u} WHEN contains({u}, '$') THEN 'USD' WHEN contains({u}, '€') THEN 'EUR' "
            f"WHEN contains({u}, '£') THEN 'GBP' ELSE {ntext(x)} END")


def norm(f, x):
    t = txt(x)
    return (f"CASE WHEN {x} IS NULL OR {x} = 'null' THEN 'null' "
            f"WHEN {f} = 1 THEN coalesce({dectext(num(t))}, '\"' || {ntext(t)} || '\"') "
            f"WHEN {f} = 2 THEN '\"' || coalesce({iso(t)}, {ntext(t)}) || '\"' "
            f"WHEN {f} = 6 THEN '\"' || {cur(t)} || '\"' ELSE '\"' || {ntext(t)} || '\"' END")


def canon(x):
    return f"CASE WHEN {x}[1] IN ('\"','[','{{','n','t','f') THEN {x} ELSE {dectext(f'try_cast({x} AS DECIMAL(38,10))')} END"


def errors(f, x):
    t = txt(x)
    return (f"CASE WHEN {x} IS NULL OR {x} = 'null' THEN '' "
            f"WHEN {f} = 1 AND {x}[1] = '\"' THEN 'total must be number' "
            f"WHEN {f} = 1 AND CAST({x} AS DOUBLE) < 0 THEN 'value is below minimum' "
            f"WHEN {f} = 1 AND CAST({x} AS DOUBLE) > 450000 THEN 'value is above maximum' "
            f"WHEN {f} = 2 AND {iso(t)} IS NULL THEN 'value is not a valid date' "
            f"WHEN {f} = 3 AND {x} NOT IN ('\"F\"','\"O\"','\"P\"') THEN 'value is not in enum' "
            f"WHEN {f} = 4 AND NOT regexp_matches({t}, '^[1-5]-') THEN 'value does not match pattern' "
            f"WHEN {f} = 5 AND length({t}) > 18 THEN 'value is longer than maxLength' "
            f"WHEN {f} = 6 AND NOT regexp_full_match({cur(t)}, '[A-Z]{{3}}') THEN 'value is not a supported ISO currency' ELSE '' END")


CTES: dict[str, tuple[tuple[str, ...], str]] = {}
CTES["base"] = ((), f"""
SELECT o_orderkey AS k, 'o' || o_orderkey AS document_id, f, field_path,
  CASE f WHEN 1 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 3 THEN o_orderstatus WHEN 4 THEN o_orderpriority WHEN 5 THEN c_name ELSE 'USD' END AS v
FROM orders LEFT JOIN customer ON o_custkey = c_custkey CROSS JOIN {FIELDS_SQL}""")
CTES["truth_all"] = (("base",), """
SELECT k, document_id, f, field_path, rev AS revision,
  CASE WHEN (k*7+f)%19 = 0 THEN 'null' WHEN k%7 = 0 AND rev = 1 AND f <> 1 THEN '"' || v || 'x"'
    WHEN f = 1 THEN v ELSE '"' || v || '"' END AS value_json,
  CASE WHEN k%11 = 0 THEN 'unverified' ELSE 'complete' END AS annotation_status
FROM base CROSS JOIN (VALUES (1),(2)) r(rev) WHERE k%23 <> 0 AND (k+f)%13 <> 0 AND (rev = 1 OR k%7 = 0)""")
# The newest revision is also known from k; used where the lookup itself is not under test.
CTES["truth"] = (("truth_all",), "SELECT * FROM truth_all WHERE revision = CASE WHEN k%7 = 0 THEN 2 ELSE 1 END")


def pred_cte(r: int) -> str:
    name = f"pred{r}"
    if name not in CTES:
        raw = f"""
SELECT 'run-{r}' AS run_id, k, document_id, f, field_path, CASE WHEN (k+f+{r})%15 <> 0 THEN ((k*37+f*11+{r}*3)%101)/100.0::DOUBLE END AS confidence,
 CASE WHEN (k*7+f)%19 = 0 AND (k+{r})%9 = 0 THEN CASE WHEN f = 1 THEN v ELSE '"' || v || '"' END
  WHEN (k*7+f)%19 = 0 OR h = 0 THEN 'null'
  WHEN f = 1 AND h NOT IN (2,5) THEN t ELSE '"' || t || '"' END AS value_json
FROM (SELECT *, CASE
  WHEN h = 1 THEN CASE f WHEN 1 THEN CAST(CAST(v AS DECIMAL(12,2)) + 100 AS VARCHAR) WHEN 2 THEN strftime(CAST(v AS DATE) + 1, '%Y-%m-%d') ELSE v || ' x' END
  WHEN h = 2 THEN CASE f WHEN 1 THEN '$' || v WHEN 2 THEN strftime(CAST(v AS DATE), '%m/%d/%Y') WHEN 5 THEN upper(v) WHEN 6 THEN '$' ELSE lower(v) END
  WHEN h = 3 THEN CASE f WHEN 1 THEN v WHEN 2 THEN '  ' || v || ' ' ELSE '  ' || lower(v) || ' ' END
  WHEN h = 4 THEN CASE f WHEN 1 THEN CAST(CAST(v AS DECIMAL(12,2)) + CAST(0.01 AS DECIMAL(12,2)) AS VARCHAR) WHEN 2 THEN v ELSE v || 'z' END
  WHEN h = 5 THEN CASE f WHEN 1 THEN 'n/a' WHEN 2 THEN 'not a date' WHEN 3 THEN 'Z' WHEN 6 THEN '??' ELSE v END
  ELSE v END AS t FROM (SELECT *, (k*31+f*17+{r}*5)%20 AS h FROM base))
WHERE (k*7+f)%19 = 0 OR h <> 0 OR k%2 = 1"""
        t = txt("value_json")
        CTES[f"{name}_raw"] = (("base",), raw)
        CTES[name] = ((f"{name}_raw",), f"""
SELECT *, CASE WHEN value_json = 'null' THEN NULL WHEN f = 1 AND value_json[1] = '"' THEN coalesce({dectext(num(t))}, value_json)
  WHEN f = 1 THEN {canon('value_json')} ELSE '"' || trim({t}) || '"' END AS normalized_json FROM {name}_raw""")
    return name


def scored_cte(r: int, tol: str | None = None, edit: int = 0) -> str:
    name = f"scored{r}" + (f"_t{tol}".replace(".", "_") if tol else "") + (f"_e{edit}" if edit else "")
    if name not in CTES:
        pred_cte(r)
        e, a = "expected_json", "a"
        te, ta = txt(e), txt(a)
        m = f"WHEN {canon(e)} = {canon(a)} THEN 'exact' WHEN ne = na THEN 'normalized' "
        if tol:
            m += f"WHEN abs({num(te)} - {num(ta)}) <= CAST('{tol}' AS DECIMAL(38,10)) THEN 'numeric_tolerance' "
        if edit:
            m += f"WHEN {e}[1] = '\"' AND {a}[1] = '\"' AND levenshtein({ntext(te)}, {ntext(ta)}) <= {edit} THEN 'edit_distance' "
        CTES[name + "_p"] = (("truth", f"pred{r}"), f"""
SELECT *, {norm('f', e)} AS ne, {norm('f', a)} AS na, {errors('f', a)} AS errs FROM (
 SELECT 'run-{r}' AS run_id, t.k, t.document_id, t.f, t.field_path, t.value_json AS expected_json, p.value_json AS actual_json, p.confidence,
  coalesce(nullif(p.normalized_json, 'null'), p.value_json) AS a
 FROM truth t LEFT JOIN pred{r} p ON p.document_id = t.document_id AND p.field_path = t.field_path WHERE t.annotation_status <> 'unverified')""")
        CTES[name + "_m"] = ((name + "_p",), f"""
SELECT *, CASE {m} ELSE 'none' END AS m, a IS NULL OR a IN ('null', '""') AS empty FROM {name}_p""")
        CTES[name] = ((name + "_m",), f"""
SELECT run_id, k, document_id, f, field_path, status,
 CASE WHEN status <> 'correct' THEN 'none' WHEN expected_json = 'null' THEN 'exact' ELSE m END AS match_type,
 CASE WHEN status = 'correct' THEN 1 ELSE 0 END AS score, expected_json, actual_json, ne AS normalized_expected, na AS normalized_actual,
 confidence, CASE WHEN status <> 'correct' THEN status END AS failure_type, errs AS validation_errors
FROM (SELECT *, CASE WHEN expected_json = 'null' AND empty THEN 'correct' WHEN expected_json = 'null' AND errs <> '' THEN 'validation_failed'
 WHEN expected_json = 'null' THEN 'hallucinated' WHEN empty THEN 'missing' WHEN errs <> '' THEN 'validation_failed'
 WHEN m <> 'none' THEN 'correct' ELSE 'incorrect' END AS status FROM {name}_m)""")
    return name


for _r in (0, 1):
    CTES[f"extractions{_r}"] = ((), f"""
SELECT 'run-{_r}' AS run_id, o_orderkey AS k, 'o' || o_orderkey AS document_id, 'x{_r}-' || o_orderkey AS extraction_id,
 500 + (o_orderkey*13+{_r}*7)%4000 AS latency_ms, 200 + o_orderkey%3000 AS input_tokens, 20 + o_orderkey%200 AS output_tokens,
 CASE o_orderkey%4 WHEN 0 THEN 'gpt-4.1-mini' WHEN 1 THEN 'gpt-4o-2024-08-06' WHEN 2 THEN 'claude-haiku-4-5' ELSE 'house-model' END AS model,
 CASE WHEN o_orderkey%8 = 7 THEN 'openai' WHEN o_orderkey%4 = 2 THEN 'anthropic' WHEN o_orderkey%4 = 3 THEN 'local' ELSE 'openai' END AS provider,
 o_orderkey%10 = 0 AS cache_hit, CASE WHEN o_orderkey%17 = 0 THEN (o_orderkey%100)/1000.0::DOUBLE END AS cost_usd FROM orders""")
CTES["runs"] = ((), """
SELECT group_id || '/r' || i AS run_id, group_id, CASE WHEN i <> 6 THEN group_id || '/e' || (i%3) END AS experiment_id, 'ds-' || group_id AS dataset_id,
 '2024-01-0' || (i+1) AS created_at, CASE WHEN i = 5 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN i = 4 THEN 'b' ELSE 'a' END AS fingerprint,
 CASE WHEN i <> 7 THEN (s%1000)/1000.0::DOUBLE END AS score, documents, CASE WHEN i <> 3 THEN documents/100.0::DOUBLE END AS cost_usd
FROM (SELECT o_orderkey%8 AS i, o_orderpriority AS group_id, count(*) AS documents,
 CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(12,2))*100 AS BIGINT)%1000) AS BIGINT) AS s FROM orders GROUP BY 1, 2)""")
CTES["steps"] = ((), """
SELECT 'o' || l_orderkey AS document_id, l_linenumber AS pos, CAST(l_linenumber*700 AS BIGINT) AS start_ms, 100 + l_partkey%1500 AS latency_ms,
 CASE l_linenumber%3 WHEN 0 THEN 'extract' WHEN 1 THEN 'parse' ELSE 'validate' END AS kind,
 CASE WHEN l_suppkey%29 = 0 THEN 'failed' ELSE 'completed' END AS status, l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem""")
CTES["docs"] = ((), """
SELECT 'd' || doc_id AS document_id, doc_id AS n, text, sha256(text) AS sha256,
 'doc ' || doc_id || CASE WHEN doc_id%5 = 0 THEN '#' ELSE '' END || '.' || CASE doc_id%4 WHEN 0 THEN 'txt' WHEN 1 THEN 'html' WHEN 2 THEN 'pdf' ELSE 'bin' END AS filename,
 source AS dataset_id, lang, [lang, 'p' || (doc_id%3)] AS tags, source || '/' || lang || '/' AS folder, CASE WHEN doc_id%3 = 0 THEN 'solo' || doc_id ELSE 'fam' || (doc_id%97) END AS family, doc_id AS created_at
FROM documents""")
CTES["members"] = (("docs",), "SELECT * EXCLUDE (text) FROM docs d WHERE n = (SELECT min(n) FROM docs e WHERE e.sha256 = d.sha256)")
CTES["blocks"] = ((), """
SELECT 'd' || doc_id AS document_id, CAST(1 + line_no//40 AS INTEGER) AS page, 'b' || line_no AS block_id, line_no AS source_index, trim(line, ' ') AS text,
 CASE WHEN line_no%7 <> 6 THEN 0.06::DOUBLE END AS x0, CASE WHEN line_no%7 <> 6 THEN round(0.06::DOUBLE + (line_no%40)*0.02::DOUBLE, 4) END AS y0,
 CASE WHEN line_no%7 <> 6 THEN 0.94::DOUBLE END AS x1, CASE WHEN line_no%7 <> 6 THEN round(0.09::DOUBLE + (line_no%40)*0.02::DOUBLE, 4) END AS y1,
 CASE WHEN line_no%5 = 0 THEN 'inferred' ELSE 'parser' END AS bbox_source
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)
WHERE trim(line, ' ') <> ''""")


def sql(body: str, *ctes: str) -> str:
    """``body`` preceded by the named expressions and everything they need."""
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)
    for c in ctes:
        visit(c)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body
