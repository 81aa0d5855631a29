"""Text functions as Column expressions; only nfkd() runs in Python (Arrow batches), as Spark has no Unicode normalization."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_WORDS = 35


def strip(x: Column) -> Column:
    """Without white space of any script at both ends (SQL's trim takes blanks only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def word_count(x: Column) -> Column:
    """Words between white space; 0 for an empty text."""
    bare = strip(x)
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+"))).cast("int")


@F.pandas_udf(T.StringType())
def nfkd(x: pd.Series) -> pd.Series:
    return x.map(lambda s: s if s is None else unicodedata.normalize("NFKD", s))


def normalize_name(x: Column) -> Column:
    """Slug of a title: compatibility form, lower case, letters, digits and `_` between words."""
    bare = F.regexp_replace(F.lower(nfkd(x)), r"[^a-z0-9\s]", "")
    return F.regexp_replace(strip(bare), r"\s+", "_")


def normalize_for_comparison(x: Column) -> Column:
    """Id without accents and, one after the other, the leading words the, don and dona."""
    out = F.lower(F.regexp_replace(nfkd(x), r"\p{M}", ""))
    for word in ("the", "don", "dona"):
        out = F.regexp_replace(out, f"^{word}_", "")
    return out


def strip_think(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?is)<think>.*?</think>", ""))


def split_sentences(x: Column) -> Column:
    """Sentences, cut after . ! ? … or — and white space; empty ones are dropped."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?…—])(?U:\s+)"), strip), lambda s: s != "")


def split_long_text(x: Column, max_words: int = MAX_WORDS) -> Column:
    """Pieces of at most max_words words, packed from whole sentences; a longer sentence is a piece of its own."""
    done = F.array().cast("array<string>")
    zero = F.struct(done.alias("done"), F.lit("").alias("line"), F.lit(-1).alias("n"))

    def pack(acc: Column, s: Column) -> Column:
        n = word_count(s)
        full = (acc["n"] >= 0) & (acc["n"] + n > max_words)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["n"] < 0), s).otherwise(F.concat_ws(" ", acc["line"], s)).alias("line"),
            F.when(full | (acc["n"] < 0), n).otherwise(acc["n"] + n).alias("n"),
        )

    packed = F.aggregate(F.split(x, r"(?<=[.!?])(?U:\s+)"), zero, pack, lambda acc: F.concat(acc["done"], F.array(acc["line"])))
    return F.when(word_count(x) <= max_words, F.array(x)).otherwise(packed)


def display_name(stem: Column) -> Column:
    """Name of a chapter file: after the first hyphen, `_` as blanks, words capitalized (a letter after a digit stays as it is)."""
    return F.initcap(F.replace(F.regexp_replace(stem, r"^[^-]*-", ""), F.lit("_"), F.lit(" ")))


def escape_metadata(x: Column) -> Column:
    """Backslash before backslash, =, ; and #."""
    return F.regexp_replace(x, r"([\\=;#])", r"\\$1")


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def strip_quotes(x: Column) -> Column:
    """Without white space, then double, then single quotes at both ends."""
    return F.btrim(F.btrim(strip(x), F.lit('"')), F.lit("'"))


def backoff_seconds(attempt: Column) -> Column:
    return F.least(attempt * 5, F.lit(60))


def preview(x: Column, n: int = 80) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def chapter_file_name(number: Column, slug: Column) -> Column:
    return F.format_string("%02d-%s.txt", number, F.substring(slug, 1, 40))


def intro_fields(intro: Column) -> tuple[Column, Column]:
    """Title and author of an intro line `TITLE by AUTHOR, narrated by ...`."""
    parts = F.split(intro, " by ", 2)
    title = F.coalesce(F.nullif(F.get(parts, 0), F.lit("")), F.lit("Unknown"))
    author = F.coalesce(F.nullif(F.get(F.split(F.get(parts, 1), ", narrated by"), 0), F.lit("")), F.lit("Unknown"))
    return title, author
