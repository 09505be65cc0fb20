"""Validation of JSON requests: the first field that is refused, and values with their defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a request may hold.
MOST_CHARS = 20_000
LANGUAGES = ("js", "jsx", "ts", "tsx", "py")
NUMBERS = {"temperature": (0.0, 1.5, 0.7), "tokens": (1, 512, 200), "rep_penalty": (1.0, 1.5, 1.1)}
WHOLE = ("tokens",)


def _kind(field: Column) -> Column:
    """The JSON type of a field: ``STRING``, ``BOOLEAN``, ``VOID``, a numeric type; null where the field is missing."""
    return F.schema_of_variant(field)


def validated(df: DataFrame, body: str) -> DataFrame:
    """Adds ``refused``, the first field that is not as it must be, or ``body`` where that is no JSON object, and the
    fields with their defaults; they are null in refused rows. A field that is null is refused, one that is missing is
    not, but for the text. Booleans are no numbers; a number without fraction is whole however it is written."""
    own = df.withColumn("_v", F.try_parse_json(body))
    get = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    text = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    number = lambda name: F.try_variant_get("_v", f"$.{name}", "double")
    kinds = {name: _kind(get(name)) for name in ("text", "lang", *NUMBERS)}
    own = own.withColumns({f"_k_{n}": k for n, k in kinds.items()} | {f"_n_{n}": number(n) for n in NUMBERS} | {"_text": text("text"), "_lang": text("lang")})
    kind = lambda name: F.col(f"_k_{name}")
    bad_text = (F.coalesce(kind("text"), F.lit("")) != "STRING") | F.col("_text").rlike(r"(?U)^\s*$")
    refused = F.when(F.col("_v").isNull() | ~F.coalesce(_kind(F.col("_v")).startswith("OBJECT"), F.lit(False)), "body")
    refused = refused.when(bad_text, "text").when(F.length("_text") > MOST_CHARS, "text too long")
    refused = refused.when(kind("lang").isNotNull() & ((kind("lang") != "STRING") | ~F.col("_lang").isin(*LANGUAGES)), "lang")
    for name, (low, high, _) in NUMBERS.items():
        value = F.col(f"_n_{name}")
        wrong = (value < low) | (value > high) | ((value != F.floor(value)) if name in WHOLE else F.lit(False))
        numeric = kind(name).rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$")
        refused = refused.when(kind(name).isNotNull() & F.when(numeric, wrong).otherwise(True), name)
    own = own.withColumn("refused", refused)
    fine = F.col("refused").isNull()
    out = own.withColumn("text", F.when(fine, F.col("_text"))).withColumn("lang", F.when(fine, F.coalesce("_lang", F.lit("tsx"))))
    for name, (_, _, default) in NUMBERS.items():
        out = out.withColumn(name, F.when(fine, F.coalesce(f"_n_{name}", F.lit(float(default))).cast("int" if name in WHOLE else "double")))
    return out.drop("_v", "_text", "_lang", *(f"_k_{n}" for n in kinds), *(f"_n_{n}" for n in NUMBERS))
