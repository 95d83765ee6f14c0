"""Rules whose results are values and counts: expressions that stay in the JVM, next to the kernel that finds offsets.

Boundaries are spelled out for ASCII, since Java's \\b and \\w differ from those of the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import checksums, patterns as P


def _java(pattern: str) -> str:
    return pattern.replace("\\Z", "\\z")


def values(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern of patterns.py."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_java(pattern)), F.lit(group))


def ipv4(text: Column) -> Column:
    return values(text, P.IPV4)


def emails(text: Column) -> Column:
    """Addresses with their owner and whether their domain is a dummy one."""
    found = F.filter(values(text, P.EMAIL), lambda e: ~e.contains(".."))
    domain = lambda e: F.regexp_replace(F.lower(F.substring_index(e, "@", -1)), r"^www\.", "")
    role = lambda e: F.substring_index(e, "@", 1).rlike("(?i)" + _java(P.ROLE))
    free = lambda e: domain(e).rlike("(?i)" + _java(P.FREE_MAIL))
    return F.transform(found, lambda e: F.struct(e.alias("value"), F.when(~role(e) & free(e), "Person Email").otherwise("Business Email").alias("label"), domain(e).rlike(_java(P.DUMMY_DOMAIN)).alias("dummy")))


def cards(text: Column) -> Column:
    """Candidates with their digits and whether they pass Luhn."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    found = F.filter(values(text, P.CARD), lambda v: F.length(digits(v)).between(13, 19) & ~digits(v).rlike(r"^(\d)\1+$"))
    return F.transform(found, lambda v: F.struct(v.alias("value"), checksums.luhn_column(v).alias("luhn")))


def phones(text: Column) -> Column:
    """International numbers of 8 to 15 digits."""
    return F.filter(values(text, P.INTERNATIONAL), lambda v: F.regexp_count(v, F.lit("[0-9]")).between(8, 15))


def digests(text: Column) -> Column:
    return F.filter(values(text, P.HASH_HEX), lambda v: v.rlike("[0-9]") & v.rlike("(?i)[a-f]"))


def secrets(text: Column) -> Column:
    """Values of token = and its like, in quotes, with how sure they are secrets."""
    found = values(text, "(?i)" + _ascii_words(P.SECRET_KEY), 2)
    value = lambda v: F.regexp_replace(v, r"[.,;:!?'\"\]}>»”’]+\z", "")
    sure = lambda v: F.when(v.rlike("[0-9]") | (v.rlike("[A-Z]") & v.rlike("[a-z]")) | (F.length(v) >= 20), 0.9).otherwise(0.6)
    return F.transform(found, lambda v: F.struct(value(v).alias("value"), sure(value(v)).alias("confidence")))


def _ascii_words(pattern: str) -> str:
    """\\b with ASCII word characters on its sides."""
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def urls(text: Column) -> Column:
    """Links, without the punctuation that ends them."""
    return F.transform(values(text, r"(?:https?://|www\.)[^\s<>\"']+"), lambda v: F.regexp_replace(v, r"[.,;:]+\z", ""))


def tokens(text: Column) -> Column:
    """Runs of letters, marks and digits, and other signs, in lower case."""
    return F.transform(values(text, r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"), lambda t: F.lower(t))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the code points, as base 36."""
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0x811C9DC5).cast("bigint"), lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("bigint"))) * F.lit(0x01000193).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def token_hash(tokens: Column) -> Column:
    """The 32-bit FNV-1a hash of a list of tokens, each closed by a 1, as a number."""
    codes = F.flatten(F.transform(tokens, lambda t: F.concat(F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.ascii(c)), F.array(F.lit(1)))))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("bigint"), lambda h, c: ((h.bitwiseXOR(c.cast("bigint"))) * F.lit(0x01000193).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def hash_tokens(tokens: Column) -> Column:
    """A key for a list of tokens: its hash as base 36, and their number."""
    return F.concat(F.lower(F.conv(token_hash(tokens).cast("string"), 10, 36)), F.lit(":"), F.size(tokens).cast("string"))
