"""Column functions for text: all built-in expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_SIZE = 5

# Patterns of codes, warnings, steps and error listings.
CODE_TOKEN = r"^[A-Za-z]{0,4}-?\d[\dA-Za-z-]*$"
UNIT_NUMBER = r"^(\d+(?:\.\d+)?)[A-Za-z°%]{1,4}$"
ERROR_CODE_TOKEN = r"\b[A-Z]{1,3}-?\d{1,3}\b"
ERROR_KEYWORDS = r"(?i)\b(error|fault|alarm|diagnostic)\b"
ERROR_HEADING = r"(?i)error code|fault code|service code|alarm code|diagnostic|error message|fault message"
WARNING_LINE = r"(?i)^(WARNING|CAUTION|DANGER|NOTICE|IMPORTANT|LOCKOUT[/ ]TAGOUT)\b"
PROCEDURE_LINE = r"^\d{1,2}[\.\)]\s+\S"
QUERY_SPECIALS = r"[\"'()*:^-]"


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and spaces as spaces, spaces collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +", " "))


# Characters whose upper case is one character in SQL, or none, where Java has several or a newer one.
_SEVERAL = [c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1 and c != "ß"]
_NEWER = "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))
SINGLE_UPPER = {c: c.title() if len(c.title()) == 1 else c for c in _SEVERAL} | {c: c for c in _NEWER}


def upper_each(text: Column) -> Column:
    """Upper case character by character, as SQL has it: ß is ẞ, not SS, and ligatures stay."""
    own = "".join(SINGLE_UPPER)
    own = f"[{min(own)}-\U0010ffff&&[{own}]]"  # the range first: few characters are then compared with each
    listed = F.create_map(*[F.lit(x) for pair in SINGLE_UPPER.items() for x in pair])

    def upper(plain: Column) -> Column:
        pieces = F.regexp_extract_all(plain, F.lit(f"{own}|(?:(?!{own})[\\s\\S])+"), F.lit(0))
        return F.when(plain.rlike(own), F.array_join(F.transform(pieces, lambda p: F.coalesce(listed[p], F.upper(p))), "")).otherwise(F.upper(plain))

    return let(F.translate(text, "ß", "ẞ"), upper)


def words(text: Column) -> Column:
    """Non-empty words of a normalised text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def query_terms(query: Column) -> Column:
    """Terms of a search text: its special characters as spaces, split at white space; repeats stay."""
    return F.filter(F.split(F.regexp_replace(query, QUERY_SPECIALS, " "), r"\s+"), lambda t: t != "")


def tokens(text: Column) -> Column:
    """Search tokens: lower-cased runs of letters and digits (not stemmed)."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_rows(docs: DataFrame, size: int = SHINGLE_SIZE) -> DataFrame:
    """(doc_id, shingle): distinct word shingles of each text; shorter texts have one shingle of all their words."""

    def cut(w: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        some = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.when(F.size(w) >= size, whole).otherwise(some))

    listed = docs.select("doc_id", let(words(normalize(F.coalesce("text", F.lit("")))), cut).alias("all"))
    return listed.select("doc_id", F.explode_outer("all").alias("shingle")).filter("shingle IS NOT NULL")


def shingle_hashes(text: Column, size: int = SHINGLE_SIZE) -> Column:
    """Distinct word shingles of a text as 64-bit hashes, in the row; shorter texts have one shingle of all their words."""

    def cut(h: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
        some = F.when(F.size(h) > 0, F.array(F.xxhash64(F.lit(size), h))).otherwise(F.array().cast("array<bigint>"))
        return F.array_distinct(F.when(F.size(h) >= size, whole).otherwise(some))

    return let(F.transform(words(normalize(F.coalesce(text, F.lit("")))), lambda w: F.xxhash64(w)), cut)


def code_tokens(text: Column) -> Column:
    """Distinct identifier-like words, upper-cased: two or more characters, a digit, and the shape of a code."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9-]+)"), 1)
    kept = F.filter(found, lambda w: (F.length(w) >= 2) & w.rlike(r"\d") & w.rlike(CODE_TOKEN))
    return F.array_distinct(F.transform(kept, F.upper))


def material_tokens(text: Column) -> Column:
    """Distinct numbers and identifiers that can be checked against a source: units are stripped, codes upper-cased."""

    def one(w: Column) -> Column:
        core = F.regexp_replace(w, r"^[./-]+|[./-]+$", "")
        digits = F.regexp_replace(core, r"[^\d]", "")
        return (
            F.when((core == "") | ~core.rlike(r"\d"), None)
            .when(core.rlike(UNIT_NUMBER), F.regexp_extract(core, UNIT_NUMBER, 1))
            .when(core.rlike(CODE_TOKEN) & core.rlike("[A-Za-z]"), F.upper(core))
            .when(F.length(digits) >= 2, F.upper(core))
        )

    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9./-]*)"), 1)
    return F.array_distinct(F.array_compact(F.transform(found, one)))


def excerpt(content: Column, limit: int) -> Column:
    """The trimmed content, cut at `limit` characters: back to the last line or sentence end when that keeps over half."""
    stripped = F.regexp_replace(content, r"^\s+|\s+$", "")

    def cut(c: Column) -> Column:
        head = F.substring(c, 1, limit)
        line = F.locate("\n", F.reverse(head))
        sentence = F.locate(" .", F.reverse(head))
        last_line = F.when(line > 0, F.length(head) - line).otherwise(-1)
        last_sentence = F.when(sentence > 0, F.length(head) - sentence - 1).otherwise(-1)
        last = F.greatest(last_line, last_sentence)
        kept = F.when(last > limit * 0.5, F.substring(head, F.lit(1), last + 1)).otherwise(head)
        return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(kept, r"\s+$", ""), F.lit(" …")))

    return let(stripped, cut)


def claim_supported(tokens_: Column, cited: Column) -> Column:
    """Whether every token stands in the cited text, white space and case aside; true without tokens."""
    hay = F.upper(collapse(cited))
    return F.forall(tokens_, lambda t: F.contains(hay, F.upper(collapse(t))))


def warning_supported(warning: Column, cited: Column) -> Column:
    """Whether a warning stands verbatim in the cited text, a leading label aside."""
    own, hay = F.upper(collapse(warning)), F.upper(collapse(cited))
    bare = F.trim(F.regexp_replace(own, r"^(WARNING|CAUTION|DANGER|NOTICE|IMPORTANT)[:\s]*", ""))
    return F.when(own == "", F.lit(False)).otherwise(F.contains(hay, own) | ((bare != "") & F.contains(hay, bare)))
