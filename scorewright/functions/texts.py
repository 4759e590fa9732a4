"""Text features, keyword flags and value masking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Supported text features and the special characters they look for.
TEXT_FEATURES = [
    "length", "word_count", "has_digits", "has_chinese", "has_english", "has_special",
    "is_empty", "digit_ratio", "upper_ratio",
]
SPECIAL_CHARS = '[!@#$%^&*(),.?":{}|<>]'
CHINESE = "[一-鿿]"


def _share(text: Column, cls: str) -> Column:
    """Share of characters in a class; removing the rare ones copies less than removing the rest."""
    n = F.length(text)
    return (n - F.length(F.regexp_replace(text, f"{cls}+", ""))) / F.greatest(n, F.lit(1)).cast("double")


def text_feature(c: Column, name: str) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    if name == "length":
        return F.length(s)
    if name == "word_count":
        words = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
        return F.when(words == "", F.lit(0)).otherwise(F.size(F.split(words, r"(?U)\s+")))
    if name == "has_digits":
        return s.rlike(r"(?U)\d").cast("int")
    if name == "has_chinese":
        return s.rlike(CHINESE).cast("int")
    if name == "has_english":
        return s.rlike("[a-zA-Z]").cast("int")
    if name == "has_special":
        return s.rlike(SPECIAL_CHARS).cast("int")
    if name == "is_empty":
        return (~s.rlike(r"(?U)\S")).cast("int")
    if name == "digit_ratio":
        return _share(s, r"\p{Nd}")
    if name == "upper_ratio":
        return _share(s, r"\p{Lu}")
    raise ValueError(f"unsupported text feature: {name}")


def keyword_flag(c: Column, keywords: Sequence[str]) -> Column:
    """1 when any keyword occurs, ignoring case, taken literally."""
    low = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k.lower())
    return hit.cast("int")


def add_text_features(
    df: DataFrame, columns: Sequence[str], features: Sequence[str] = tuple(TEXT_FEATURES),
    keywords: Mapping[str, Sequence[str]] | None = None, drop_original: bool = True,
) -> DataFrame:
    """Adds ``{column}_txt_{feature}`` and one flag per keyword list."""
    new = [text_feature(F.col(f"`{c}`"), f).alias(f"{c}_txt_{f}") for c in columns for f in features]
    new += [
        keyword_flag(F.col(f"`{c}`"), ks).alias(f"{c}_txt_{name}")
        for c in columns for name, ks in (keywords or {}).items() if ks
    ]
    out = df.select("*", *new)
    return out.drop(*columns) if drop_original else out


def mask(c: Column) -> Column:
    """Four stars, or first two + stars + last two characters of longer values."""
    s = c.cast("string")
    return F.when(F.length(s) <= 4, F.lit("****")).otherwise(
        F.concat(F.substring(s, 1, 2), F.lit("****"), F.substring(s, -2, 2))
    )

