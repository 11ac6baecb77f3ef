"""Column expressions of the usage model.  All are built-in functions, so they stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Apps whose input tokens may include cached ones.
INCLUSIVE_APPS = ("codex", "gemini", "grokbuild")
TICKS = 10_000_000_000


def fresh_input() -> Column:
    """Input tokens without cached ones, by the semantics the row states (2 fresh, 1 total, 0 unstated)."""
    app = F.col("app_type").isin(*INCLUSIVE_APPS)
    used, read, made, kind = F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_creation_tokens"), F.col("input_token_semantics")
    return (
        F.when(kind == 2, used)
        .when(app & (kind == 1) & (used >= read + made), used - read - made)
        .when(app & (kind == 0) & (used >= read), used - read)
        .otherwise(used)
    )


def real_total(fresh: Column) -> Column:
    return fresh + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")


def succeeded() -> Column:
    return F.when(F.col("status_code").between(200, 299), 1).otherwise(0).cast("long")


def lenient_double(text: str | Column) -> Column:
    """The number a text starts with; 0 where it starts with none.  Infinities and NaN are no numbers."""
    number = F.regexp_extract(text, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
    return F.coalesce(F.nullif(number, F.lit("")).try_cast("double"), F.lit(0.0))


def bucket_start(seconds: int, offset: int = 0) -> Column:
    """Start of the bucket; division truncates towards zero, for times before the epoch too."""
    return F.expr(f"((created_at + {offset}) div {seconds}) * {seconds} - {offset}")


def month_start(epoch: str = "created_at") -> Column:
    """First second of the UTC month, free of the session's time zone."""
    return F.expr(
        f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', date_trunc('MONTH', timestampadd(SECOND, {epoch}, TIMESTAMP_NTZ'1970-01-01 00:00:00')))"
    )


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def provider_label(name: str = "name", key: str = "provider_id") -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(key))


def event_id() -> Column:
    return F.concat_ws(":", "node_id", "request_id")


def rollup_key(parts: list[str]) -> Column:
    """Parts joined by a bar; a null part is empty, where concat_ws alone would leave it out."""
    return F.concat_ws("|", *[F.coalesce(F.col(p), F.lit("")) for p in parts])


#: The characters of Unicode's White_Space.
WHITE_SPACE = "\\t\\n\\x0B\\f\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def trimmed(text: str | Column) -> Column:
    """The text without white space of any kind at its ends, where ``trim`` takes spaces only."""
    return F.regexp_replace(text, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\\z", "")


def ascii_lower(text: str | Column) -> Column:
    """A-Z in lower case and nothing else, where ``lower`` folds every script."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalised_codex_model(model: str | Column) -> Column:
    """Lower case, behind the last slash, without a trailing -YYYY-MM-DD and then -YYYYMMDD."""
    name = F.regexp_replace(ascii_lower(model), "(?s)^.*/", "")
    return F.regexp_replace(F.regexp_replace(name, r"-[0-9]{4}-[0-9]{2}-[0-9]{2}\z", ""), r"-[0-9]{8}\z", "")


def is_placeholder(model: str | Column) -> Column:
    c = F.col(model) if isinstance(model, str) else model
    return F.coalesce(ascii_lower(trimmed(c)), F.lit("")).isin("", "unknown", "null", "none")


def ticks_as_cost(ticks: Column) -> Column:
    """Dollars with ten decimals, where there is anything to report."""
    whole, rest = F.floor(ticks / F.lit(TICKS)), F.pmod(ticks, F.lit(TICKS))
    return F.when(ticks > 0, F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 10, "0")))


_HYPHENED = "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"


def uuid_text(text: Column) -> Column:
    """A UUID (32 digits; hyphenated, also in braces or behind urn:uuid:; capitals count) as hyphenated lower case; null for other texts."""
    good = text.rlike(f"^([0-9a-fA-F]{{32}}|{_HYPHENED}|\\{{{_HYPHENED}\\}}|urn:uuid:{_HYPHENED})$")
    digits = F.lower(F.regexp_replace(text, "^urn:uuid:|[{}-]", ""))
    return F.when(good, F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def plain_number(x: Column) -> Column:
    """A double as decimal text that reads back as the same double, without an exponent, a trailing ".0" or other trailing zeros."""
    text = x.cast("double").cast("string")
    return F.when(text.contains("E"), F.transform(F.array(text), _without_exponent)[0]).otherwise(F.regexp_replace(text, r"\.0$", ""))


def _without_exponent(text: Column) -> Column:
    """The same number; the parts are bound once, as an expression is written out wherever it is used."""
    parts = F.struct(F.regexp_extract(text, r"^-?([0-9]+)", 1).alias("whole"), F.regexp_extract(text, r"\.([0-9]+)", 1).alias("rest"), F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int").alias("power"))
    placed = F.transform(F.array(parts), lambda p: F.struct(F.concat(p["whole"], p["rest"]).alias("digits"), (F.length(p["whole"]) + p["power"]).alias("point")))
    padded = F.transform(placed, lambda p: F.struct(
        F.concat(F.repeat(F.lit("0"), F.greatest(1 - p["point"], F.lit(0))), p["digits"], F.repeat(F.lit("0"), F.greatest(p["point"] - F.length(p["digits"]), F.lit(0)))).alias("digits"),
        F.greatest(p["point"], F.lit(1)).alias("at"),
    ))
    plain = F.transform(padded, lambda p: F.concat(F.substring(p["digits"], F.lit(1), p["at"]), F.lit("."), F.substring(p["digits"], p["at"] + 1, F.length(p["digits"]))))[0]
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.concat(F.when(text.startswith("-"), "-").otherwise(""), plain)
