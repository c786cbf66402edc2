"""Text functions as column expressions."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .markers import MOJIBAKE

CJK = "一-鿿"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether text holds any of words, literally."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | Column) -> Column:
    """The name of the first rule of which text holds a word."""
    out = F.lit(default)
    for name, words in reversed(list(rules)):
        out = F.when(any_of(text, words), name).otherwise(out)
    return out


def runs(text: Column, least: int = 1) -> Column:
    """Runs of CJK characters, ASCII letters and digits."""
    return F.regexp_extract_all(text, F.lit(f"([{CJK}A-Za-z0-9]{{{least},}})"), F.lit(1))


def tokens(text: Column) -> Column:
    return runs(F.lower(F.coalesce(text, F.lit(""))))


def with_bigrams(found: Column) -> Column:
    """Each run, and after a run of over two characters with CJK its two-character pieces."""
    pieces = lambda r: F.when(
        r.rlike(f"[{CJK}]") & (F.length(r) > 2), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
    ).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(found, lambda r: F.concat(F.array(r), pieces(r))))


def terms(text: Column) -> Column:
    """Distinct lower-case terms in order of appearance, with CJK bigrams; the whole text where there are none."""
    return let(F.array_distinct(with_bigrams(tokens(text))), lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(text)))


def keywords(text: Column, most: int = 12) -> Column:
    """The first runs of two or more characters, without regard to case, in their first spelling."""
    return let(
        runs(F.coalesce(text, F.lit("")), 2),
        lambda r: F.slice(
            F.aggregate(
                r, F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out")),
                lambda acc, x: F.when((F.size(acc["out"]) >= most) | F.array_contains(acc["seen"], F.lower(x)), acc).otherwise(
                    F.struct(F.array_append(acc["seen"], F.lower(x)).alias("seen"), F.array_append(acc["out"], x).alias("out"))
                ),
                lambda acc: acc["out"],
            ), 1, most,
        ),
    )


def squeezed(text: Column) -> Column:
    """Lower case, outer blanks gone, every run of blanks one space."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")


def normal_content(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def fingerprint(text: Column) -> Column:
    """24 hex digits that stay equal under changes of case and blanks, from the first 4000 characters."""
    return F.substring(F.sha2(F.substring(squeezed(text), 1, 4000), 256), 1, 24)


def tokens_by_length(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def tokens_by_units(text: Column) -> Column:
    """The larger of the blank-separated words and of the CJK pairs and alphanumeric runs."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: F.length(x) > 0))
    return F.greatest(words, F.regexp_count(text, F.lit(f"[{CJK}]{{1,2}}|[A-Za-z0-9]+"))).cast("long")


def tokens_for_history(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 2)).cast("long")


def tokens_for_usage(text: Column) -> Column:
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: F.length(x) > 0))
    return F.when(words == 0, 0).when(words > 1, words).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 2))).cast("long")


def error_signature(message: Column) -> Column:
    """A message with hex runs and numbers replaced, so that like failures group together."""
    out = F.regexp_replace(F.lower(message), r"[0-9a-f]{8,}", "<hex>")
    out = F.regexp_replace(F.regexp_replace(out, r"\d{2,}", "<num>"), r"(?U)\s+", " ")
    return F.coalesce(F.when(F.trim(out) != "", F.substring(F.trim(out), 1, 120)), F.lit("unknown"))


def canary_bucket(key: Column, seed: str) -> Column:
    return (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("long") % 100).cast("int")


def term_hash(word: str) -> int:
    """The low 64 bits of a word's MD5 sum."""
    return int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[8:], "big")


def majority_bits(hashes: list[int] | np.ndarray | None) -> int:
    """The 64-bit number whose bits are set in more than half of the hashes; 0 for none. The SimHash of the hashed words."""
    if hashes is None or not len(hashes):
        return 0
    ones = np.unpackbits(np.asarray(hashes, dtype="<i8").view(np.uint8), bitorder="little").reshape(len(hashes), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def sentences(text: Column, ends: str = "。！？；.!?;") -> Column:
    """Pieces that end after one of ends or at line breaks, trimmed, none empty."""
    pieces = F.split(F.coalesce(text, F.lit("")), f"(?<=[{ends}])|\\n+")
    return F.filter(F.transform(pieces, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: F.length(x) > 0)


def effective_date(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(20\d{2}(?:[-/.年]\d{1,2})?(?:[-/.月]\d{1,2})?)", 1)
    return F.when(found != "", found)


def garbled(text: Column) -> Column:
    """Long texts in which letters of any script and digits are under half of the characters that are not blank."""
    solid = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    good = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return (F.length(text) >= 30) & (good < 0.5 * solid)


def mark_code(user: Column, stamp: Column) -> Column:
    """16 hex digits that trace a copy of a text to a reader and a time."""
    return F.substring(F.md5(F.concat_ws(":", user, stamp)), 1, 16)


def mark_hidden(code: Column) -> Column:
    """A code as invisible characters: 64 binary digits, so that leading zeros survive (a code traces back always)."""
    return F.translate(F.lpad(F.conv(code, 16, 2), 64, "0"), "10", "‌​")


def mark_read(text: Column) -> Column:
    """The code hidden in text, or null."""
    digits = F.translate(F.regexp_replace(text, "[^​‌]", ""), "‌​", "10")
    return F.when(F.length(digits) == 64, F.lpad(F.lower(F.conv(digits, 2, 16)), 16, "0"))


def mark_strip(text: Column) -> Column:
    """text without a hidden code."""
    return F.regexp_replace(text, "[​‌]", "")


def mojibake_score(text: Column) -> Column:
    """Four for each CJK character and one for each printable one, less ten for each sign of a wrong charset."""
    signs = reduce(lambda a, b: a + b, [F.size(F.split(text, re.escape(m), -1)) - 1 for m in MOJIBAKE])
    return (4 * F.regexp_count(text, F.lit(f"[{CJK}]")) + F.regexp_count(text, F.lit(r"[^\p{C}\p{Z}]| ")) - 10 * signs).cast("long")


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """HTML references as the characters they stand for."""
    return text.map(html.unescape, na_action="ignore")


def normal_spaces(text: Column) -> Column:
    """HTML references resolved, NBSP and ideographic spaces plain, runs of blanks one space, no blanks around line ends or at either end."""
    plain = F.regexp_replace(F.translate(unescaped(text), "\u00a0\u3000", "  "), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)\s*\n\s*", "\n"), r"(?U)^\s+|\s+$", "")


def fits_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most so many UTF-8 bytes that ends with a whole character."""
    # The number of characters that fit is found by halving, on lengths alone.
    search = F.aggregate(
        F.sequence(F.lit(most.bit_length()), F.lit(0), F.lit(-1)), F.lit(0),
        lambda n, i: F.when(F.octet_length(F.substr(text, F.lit(1), n + F.call_function("shiftleft", F.lit(1), i))) <= most, F.least(n + F.call_function("shiftleft", F.lit(1), i), F.length(text))).otherwise(n),
    )
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substr(text, F.lit(1), search))
