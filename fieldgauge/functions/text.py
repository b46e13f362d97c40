"""Text, number, date and currency normalization as JVM-side Column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# The whitespace class, currency symbols and month names used for comparison.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
CURRENCY_SYMBOLS = {"$": "USD", "US$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december")


def collapse(x: Column) -> Column:
    """Runs of (Unicode) whitespace become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(x, WHITESPACE, " "))


def casefold(x: Column) -> Column:
    return F.replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def normal_text(x: Column) -> Column:
    return casefold(collapse(x))


def normal_number(x: Column) -> Column:
    """Text to DECIMAL(38,10) after dropping thousands separators and dollar signs; else null.

    The values NaN and Infinity are treated as non-numeric.
    """
    return F.regexp_replace(collapse(x), "[,$]", "").try_cast("decimal(38,10)")


def decimal_text(x: Column) -> Column:
    """Canonical text of a decimal: no exponent, no trailing zeros."""
    s = x.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def normal_currency(x: Column) -> Column:
    upper = F.upper(collapse(x))
    out = F.when(x.isNull(), None)
    for symbol, code in CURRENCY_SYMBOLS.items():
        out = out.when(upper == symbol, code)
    return (out.when(upper.rlike("^[A-Z]{3}$"), upper)
            .when(F.contains(upper, F.lit("$")), "USD")
            .when(F.contains(upper, F.lit("€")), "EUR")
            .when(F.contains(upper, F.lit("£")), "GBP")
            .otherwise(normal_text(x)))


def parse_date(x: Column) -> Column:
    """ISO text of a date written in one of six spellings, else null.

    Two-digit years 69-99 are 19xx and 00-68 are 20xx.
    """
    t = F.trim(x)
    year4 = F.regexp_replace(F.regexp_replace(t, r"^(\d{1,2}/\d{1,2}/)(69|[7-9]\d)$", "$119$2"),
                             r"^(\d{1,2}/\d{1,2}/)(\d\d)$", "$120$2")
    one_space = F.regexp_replace(t, r"\s+", " ")
    day = (F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(t, "yyyy-M-d"))
           .when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(t, "yyyy/M/d"))
           .when(t.rlike(r"^\d{1,2}/\d{1,2}/(\d{2}|\d{4})$"), F.try_to_date(year4, "M/d/yyyy"))
           .when(t.rlike(r"^[A-Za-z]{3}\s+\d{1,2},\s+\d{4}$"), F.try_to_date(one_space, "MMM d, yyyy"))
           .when(t.rlike(r"^[A-Za-z]{4,9}\s+\d{1,2},\s+\d{4}$"), F.try_to_date(one_space, "MMMM d, yyyy")))
    return day.cast("string")


def normal_date(x: Column) -> Column:
    return F.coalesce(parse_date(x), normal_text(x))


def is_iso_date(x: Column) -> Column:
    return x.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(x, "yyyy-MM-dd").isNotNull()


def valid_confidence(x: Column) -> Column:
    """Finite number in [0, 1], else null: unknown confidence is never given a default."""
    return F.when(~F.isnan(x) & x.between(0, 1), x)


def clean_tags_cli(tags: Column, max_len: int = 80, max_tags: int = 50) -> Column:
    """Lower-cased, trimmed, first-seen order, each cut to ``max_len``."""
    cleaned = F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.slice(F.transform(F.array_distinct(cleaned), lambda t: F.substring(t, 1, max_len)), 1, max_tags)


def clean_tags_api(tags: Column) -> Column:
    """Trimmed, sorted set of non-empty tags."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")))


def folder_path(x: Column) -> Column:
    """Slash-delimited path with a trailing slash; '' for none; null when a segment is '.' or '..'."""
    slashes = F.regexp_replace(F.coalesce(x, F.lit("")), r"\\", "/")
    parts = F.filter(F.transform(F.split(slashes, "/"), lambda s: F.trim(s)), lambda s: s != "")
    bad = F.exists(parts, lambda s: s.isin(".", ".."))
    return (F.when(bad, None).when(F.size(parts) == 0, "")
            .otherwise(F.concat(F.array_join(parts, "/"), F.lit("/"))))


def clean_filename(x: Column) -> Column:
    return F.regexp_replace(F.when(x.isNull() | (x == ""), "document").otherwise(x), "[^A-Za-z0-9._ -]", "_")


# Provider names and aliases accepted in processor settings.
COMPATIBLE_PROVIDERS = ("deepseek", "groq", "lm-studio", "lmstudio", "mistral", "ollama",
                        "openai-compatible", "openrouter", "together", "vllm")


def infer_provider(model: Column) -> Column:
    n = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    return (F.when((n == "") | n.startswith("deterministic") | n.startswith("local"), "local")
            .when(F.contains(n, F.lit("claude")), "anthropic")
            .when(F.contains(n, F.lit("gemini")), "gemini")
            .when(n.startswith("gpt-") | n.startswith("o1") | n.startswith("o3") | n.startswith("o4"), "openai")
            .otherwise("openai-compatible"))


def provider_normalize(provider: Column, model: Column) -> Column:
    v = F.replace(F.lower(F.trim(F.coalesce(provider, F.lit("")))), F.lit("_"), F.lit("-"))
    return (F.when(v.isin("google", "gemini"), "gemini")
            .when(v.isin("openai", "anthropic", "local"), v)
            .when(v.isin(*COMPATIBLE_PROVIDERS), v)
            .otherwise(infer_provider(model)))


def pricing_provider(provider: Column) -> Column:
    """Provider key of the rate table; compatible servers share one key."""
    v = F.replace(F.lower(F.trim(F.coalesce(provider, F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(v.isin(*COMPATIBLE_PROVIDERS), "openai-compatible").when(v == "google", "gemini").otherwise(v)


def printable_text(x: Column) -> Column:
    """Anything outside printable ASCII, tab and line ends becomes a space; blanks collapse."""
    s = F.regexp_replace(x, r"[^\x09\x0A\x0D\x20-\x7E]", " ")
    s = F.regexp_replace(s, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(s, r"\n[ \t]+", "\n"), r"^\s+|\s+$", "")


def decoded_text(data: Column) -> Column:
    """Bytes as UTF-8 text without what is not UTF-8, or as Latin-1 if fewer than 12 ASCII letters and digits are left."""
    # a replacement character that is really there is set aside, as broken bytes become one
    marked = F.make_valid_utf8(F.replace(data.cast("string"), F.lit("\ufffd"), F.lit("\x01")))
    utf8 = F.replace(F.replace(marked, F.lit("\ufffd"), F.lit("")), F.lit("\x01"), F.lit("\ufffd"))
    return F.when(F.regexp_count(utf8, F.lit("[A-Za-z0-9]")) < 12, F.decode(data, "ISO-8859-1")).otherwise(utf8)


def printable_bytes(data: Column) -> Column:
    """Printable text of a file's bytes."""
    return printable_text(decoded_text(data))


def column_key(x: Column) -> Column:
    return casefold(F.regexp_replace(x, WHITESPACE, ""))


def unicode_form(form: str):
    """Vectorized Unicode normalization (the JVM function library has none)."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def normalize(s):
        return s.str.normalize(form)
    normalize.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return pandas_udf(normalize, "string")


def title_key(x: Column, nfc=None) -> Column:
    """Filename key: NFC, casefold, ampersand and apostrophe to underscore, trailing dashes dropped."""
    composed = (nfc or unicode_form("NFC"))(x)
    swapped = F.translate(casefold(composed), "&'", "__")
    return F.trim(F.regexp_replace(F.trim(swapped), "-+$", ""))


def compact_text(x: Column, nfkc=None) -> Column:
    """Whitespace-free NFKC text with curly apostrophes straightened."""
    folded = casefold(F.regexp_replace((nfkc or unicode_form("NFKC"))(x), WHITESPACE, ""))
    return F.translate(folded, "’‘", "''")


def normalize_answer(field: Column, raw: Column, is_impossible: Column, n_answers: Column) -> Column:
    """(included, value_json, reason) of a human benchmark answer; unknown is not explicit null."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    low = casefold(text)
    iso = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/(\d{4}|\d{2})$|^\d{4}-\d{1,2}-\d{1,2}$"), parse_date(text))

    def out(included, value, reason):
        return F.struct(F.lit(included).alias("included"), value.cast("string").alias("value_json"),
                        F.lit(reason).alias("reason"))
    null = F.lit(None)
    quoted = F.to_json(F.struct(text.alias("v")))
    as_json = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    binary = field == "termination_for_convenience"
    return (F.when(binary & low.isin("yes", "no"),
                   out(True, F.when(low == "yes", "true").otherwise("false"), "human_binary_answer"))
            .when(binary, out(False, null, "missing_binary_answer"))
            .when((text == "") & is_impossible & (n_answers == 0), out(True, F.lit("null"), "no_annotated_clause"))
            .when(text == "", out(False, null, "clause_present_but_normalized_answer_missing"))
            .when((field == "expiration_date") & (low == "perpetual"), out(True, F.lit('"perpetual"'), "human_answer"))
            .when(F.endswith(field, F.lit("_date")) & iso.isNotNull(),
                  out(True, F.concat(F.lit('"'), iso, F.lit('"')), "complete_date_to_iso"))
            .when(F.endswith(field, F.lit("_date")), out(False, null, "partial_or_non_single_date"))
            .otherwise(out(True, as_json, "human_answer")))


# The date spellings that count, and the wordings of notice periods.
EXPLICIT_DATE = r"^\d{1,2}/\d{1,2}/(\d{4}|\d{2})$|^\d{4}-\d{1,2}-\d{1,2}$"
NOTICE_SHAPE = r"(?i)^\s*(\d+)\s+(days?|months?)\s*$"
NOTICE_UNITS = {"business days": r"(?i)business\s+days", "calendar days": r"(?i)calendar\s+days"}
NOTICE_EXCLUDED = r"(?i)within|October 1|interruptible|firm transportation"


def explicit_date(raw: Column, spans: Column) -> Column:
    """The parsed date, kept only when a supporting span states it literally."""
    t = F.trim(raw)
    iso = F.when(t.rlike(EXPLICIT_DATE), parse_date(t))
    y, mm, dd = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
    m, d = mm.cast("int").cast("string"), dd.cast("int").cast("string")
    full = F.element_at(F.array(*[F.lit(n) for n in MONTHS]), F.coalesce(mm.cast("int"), F.lit(1)))
    month = F.concat(F.lit("(?:"), full, F.lit("|"), F.substring(full, 1, 3), F.lit(")"))
    pattern = F.concat(
        F.lit(r"(?i)\b"), y, F.lit("-"), mm, F.lit("-"), dd, F.lit(r"\b"),
        F.lit(r"|\b0?"), m, F.lit("/0?"), d, F.lit("/(?:"), y, F.lit("|"), F.substring(y, 3, 2), F.lit(r")\b"),
        F.lit(r"|\b"), month, F.lit(r"\.?\s+0?"), d, F.lit(r"(?:st|nd|rd|th)?\s*,?\s*"), y, F.lit(r"\b"),
        F.lit(r"|\b0?"), d, F.lit(r"(?:st|nd|rd|th)?\s+(?:day of\s+)?"), month, F.lit(r"\s*,?\s*"), y, F.lit(r"\b"))
    return F.when(F.exists(spans, lambda s: F.rlike(s, pattern)), iso)


def notice_period(raw: Column, spans: Column) -> Column:
    """struct(number, unit) for an uncomplicated duration; null for ranges and excluded wording."""
    joined = F.array_join(spans, " ")
    unit = F.when(F.lower(F.regexp_extract(raw, NOTICE_SHAPE, 2)).startswith("month"), "months")
    for name, pattern in NOTICE_UNITS.items():
        unit = unit.when(joined.rlike(pattern), name)
    return F.when(raw.rlike(NOTICE_SHAPE) & (F.size(spans) > 0) & ~joined.rlike(NOTICE_EXCLUDED),
                  F.struct(F.regexp_extract(raw, NOTICE_SHAPE, 1).alias("number"), unit.otherwise("unclear").alias("unit")))


def excerpt_queries(x: Column, limit: int = 8) -> Column:
    """Search strings for a quote: whole text, long fragments, first and last ten words."""
    text = collapse(F.regexp_replace(x, r"\.{3,}|…", " "))
    words = F.split(text, r"(?U)\s+")
    fragments = F.filter(F.split(text, r"[;.!?]\s+"), lambda s: F.size(F.split(s, r"(?U)\s+")) >= 6)
    n = F.size(words)
    ends = F.when(n > 10, F.array(F.array_join(F.slice(words, 1, 10), " "),
                                  F.array_join(F.slice(words, F.greatest(n - 9, F.lit(1)), F.lit(10)), " "))
                  ).otherwise(F.array().cast("array<string>"))
    return (F.when(text == "", F.array().cast("array<string>"))
            .otherwise(F.slice(F.array_distinct(F.concat(F.array(text), fragments, ends)), 1, limit)))


def compact_alnum(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9.]", "")


def value_matches_block(needle: Column, block: Column) -> Column:
    """Case-insensitive containment, else containment of the compact alphanumeric forms."""
    n, b = F.lower(needle), F.lower(block)
    cn = compact_alnum(needle)
    return F.coalesce((n != "") & (b != "") & (F.contains(b, n) | ((cn != "") & F.contains(compact_alnum(block), cn))), F.lit(False))
