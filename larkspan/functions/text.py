"""Text expressions: tokens, terms, normal forms, digests and snippets. All are Catalyst columns."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

TERM_LIMIT = 24
SNIPPET_CHARS = 160
# English and Portuguese function words left out of focus terms.
STOPWORDS = (
    "the and for how what where which does with from that this are when who why into used use uses its has have code "
    "project file files como onde qual quais que quem por para com uma dos das nos nas pelo pela ele ela isso esse essa "
    "este esta fica ficam usa usado usada sobre entre depois antes quando cada seu sua seus suas não sem mais código "
    "projeto arquivo arquivos decide funciona is in to of on at by an as it or be do if so we no up me my he us am de da "
    "em na os um se ao ou eu te é já só"
).split()


@cache
def _accents() -> tuple[str, str]:
    """Letters with diacritics and their bases, from the Unicode decompositions below U+2000."""
    pairs = []
    for cp in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and all(unicodedata.combining(c) for c in d[1:]):
            pairs.append((chr(cp), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def let(value: Column, fn) -> Column:
    """``fn`` of ``value``, which is evaluated once however often ``fn`` uses it, lambdas included."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip_accents(c: Column) -> Column:
    """Base letters for letters with diacritics; a text of ASCII alone is left as it is, which is much faster."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, *_accents()))


def tokens(c: Column) -> Column:
    """Index tokens: runs of letters and digits, lower case, without diacritics; an underscore separates."""
    return F.regexp_extract_all(F.lower(strip_accents(F.coalesce(c, F.lit("")))), F.lit("([\\p{L}\\p{N}]+)"), 1)


def query_terms(c: Column, limit: int = TERM_LIMIT) -> Column:
    """The first ``limit`` distinct words of two characters or more, in order, case kept."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?U)(\\w{2,})"), 1)), 1, limit)


def focus_terms(c: Column, limit: int = TERM_LIMIT) -> Column:
    """Content words of a question: camel case split, lower case, function words dropped, distinct, in order."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z])([A-Z])", "$1 $2")
    words = F.regexp_extract_all(F.lower(spaced), F.lit("(?U)(\\w{2,})"), 1)
    return F.slice(F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS])), 1, limit)


def matched(terms: Column, text: Column) -> Column:
    """How many of the terms occur in the text, whatever the case."""
    return let(F.lower(text), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))))


def normalise_query(c: Column) -> Column:
    """White space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))


def body_hash(c: Column) -> Column:
    """Digest by which equal bodies are found: lower case, white space collapsed."""
    return F.sha1(F.regexp_replace(F.lower(c), "\\s+", " "))


def stamp(c: Column) -> Column:
    """Twelve hex digits of a text without its white space."""
    return F.substring(F.sha1(F.regexp_replace(c, "\\s", "")), 1, 12)


def content_key(contract: Column, text: Column) -> Column:
    """Content address of a vector: digest of contract, NUL and text."""
    return F.sha2(F.concat(contract, F.char(F.lit(0)), text), 256)


def finding_id(prefix: str, fingerprints: Column) -> Column:
    """Identity of a finding, independent of the order of what it is about."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.array_join(F.array_sort(fingerprints), "|")), 1, 16))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{N}]+)"), 1)


def shingles(tokens: Column, n: int = 5) -> Column:
    """Distinct runs of ``n`` tokens, each joined by a space; none of a shorter list."""
    return let(tokens, lambda w: F.array_distinct(F.when(F.size(w) >= n, F.transform(
        F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "),
    )).otherwise(F.array().cast("array<string>"))))


def snippet(body: Column, terms: Column, size: int = SNIPPET_CHARS) -> Column:
    """About ``size`` characters around the first term found, a quarter of them before it, with ellipses where cut."""
    clean = F.trim(F.regexp_replace(body, "\\s+", " "))

    def cut(c):
        at = let(F.lower(c), lambda low: F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, F.lower(t)) - 1), lambda p: p >= 0)))
        start = F.greatest(F.lit(0), F.coalesce(at, F.lit(0)) - size // 4)
        return let(start, lambda s: F.concat(
            F.when(s > 0, "…").otherwise(""), F.trim(F.substring(c, s + 1, F.lit(size))), F.when(s + size < F.length(c), "…").otherwise("")))

    return let(clean, cut)


def compact_pages(c: Column) -> Column:
    """Text of pages: hyphenation undone, single line breaks joined, spaces collapsed."""
    t = F.regexp_replace(c, "\r\n?", "\n")
    t = F.regexp_replace(t, "(\\p{L})-\n(\\p{Ll})", "$1$2")
    t = F.regexp_replace(t, "(?<!\n)\n(?!\n)", " ")
    t = F.regexp_replace(t, "[ \t]+", " ")
    return F.trim(F.regexp_replace(t, "\n{2,}", "\n\n"))
