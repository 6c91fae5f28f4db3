"""Many patterns over many texts: one automaton of the literals that they require, and regexes where a literal was met."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

BLOCK = 50_000  #: patterns of one automaton; a larger catalogue is dealt in blocks of so many
MOST_WORDS = 100  #: words of a pattern that is looked up by them
WORD = re.compile("[A-Za-z0-9_]+")
SPECIAL = set("\\.^$*+?{}[]()|")
CLASSES = "dDsSwWbBAZzGRhHvVNpP"  #: escapes that stand for no character of their own


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lower(text: str) -> str:
    """A-Z lower-cased, as patterns without case do by default."""
    return text.translate(_LOWER)


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at the bars outside groups and classes."""
    out, depth, inside, at, start = [], 0, False, 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            at += pattern[at + 1 : at + 2] in ("]", "^")
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(pattern[start:at])
            start = at + 1
        at += 1
    return [*out, pattern[start:]]


def _runs(pattern: str) -> list[str]:
    """Runs of characters that every match of a pattern without bars outside groups has; what is in groups or classes is passed over."""
    runs, own, at = [], "", 0

    def end() -> None:
        nonlocal own
        runs.append(own)
        own = ""

    while at < len(pattern):
        c, wide = pattern[at], 1
        literal: str | None = None
        if c == "\\":
            following = pattern[at + 1 : at + 2]
            wide = 2
            if following and following not in CLASSES and not following.isalnum():
                literal = following
            elif following in ("b", "B"):
                at += 2
                continue
            elif following in ("p", "P", "x", "u", "c", "k", "0"):
                return [""]  # of several characters: nothing is claimed
        elif c == "(" or c == "[":
            wide = _closing(pattern, at) - at + 1
        elif c not in SPECIAL:
            literal = c
        following = pattern[at + wide : at + wide + 1]
        if following and following in "*?{":  # perhaps not there at all
            literal = None
        if literal is None:
            end()
        else:
            own += literal
            if following == "+":
                end()
        at += wide
        if following and following in "*+?{":
            at = pattern.index("}", at) + 1 if following == "{" else at + 1
            while pattern[at : at + 1] in ("?", "+"):
                at += 1
    end()
    return runs


def _closing(pattern: str, at: int) -> int:
    """Where the group or class that opens here ends."""
    depth, inside = 0, False
    k = at
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            k += pattern[k + 1 : k + 2] in ("]", "^")
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        if depth == 0 and not inside and k >= at and c in ")]":
            return k
        k += 1
    raise ValueError(f"unbalanced pattern {pattern!r}")


def required_literals(pattern: str) -> list[str] | None:
    """Literals, A-Z lower-cased, of which every match of the pattern has one: the longest run of each alternative; None if some alternative has none."""
    pattern = re.sub(r"\\Q(.*?)(?:\\E|$)", lambda m: re.sub(r"([^A-Za-z0-9_])", r"\\\1", m[1]), pattern, flags=re.DOTALL)
    if re.search(r"\(\?[a-zA-Z-]*[xudms]", pattern):
        return None  # flags that change what characters mean
    found = [max(_runs(re.sub(r"\(\?i\)", "", own)), key=len) for own in _alternatives(pattern)]
    return sorted({lower(x) for x in found}) if all(found) else None


def whole_words(pattern: str) -> list[str] | None:
    """All words of which a match has one between characters outside A-Z, a-z, 0-9 and _ ; None for a pattern that says more than such words.

    The pattern names both neighbours, (^|[^A-Za-z0-9_]) and ([^A-Za-z0-9_]|$), and between them characters of words or
    classes of these, each perhaps with a question mark.
    """
    shaped = re.fullmatch(r"\(\^\|\[\^A-Za-z0-9_\]\)((?:(?:[A-Za-z0-9_]|\[(?:[A-Za-z0-9_](?:-[A-Za-z0-9_])?)+\])\??)+)\(\[\^A-Za-z0-9_\]\|\$\)", pattern)
    if not shaped:
        return None
    made = [""]
    for atom, maybe in re.findall(r"(\[[^\]]+\]|\w)(\??)", shaped[1], re.ASCII):
        # The characters of a class by the regex itself: of a range backwards, which is none, it makes an error.
        own = [c for c in map(chr, range(128)) if re.match(atom, c)] + [""] * bool(maybe)
        if not all(WORD.fullmatch(c) for c in own if c) or len(made) * len(own) > MOST_WORDS:
            return None
        made = [w + c for w in made for c in own]
    return None if "" in made else sorted(set(made))


def _matcher(literals: list[tuple[str, int]], always: list[int]) -> Callable[[str], list[int]]:
    """The numbers of the patterns of which a literal stands in a text, in one pass over it, and those that have none."""
    import ahocorasick

    by_literal: dict[str, list[int]] = {}
    for literal, number in literals:
        by_literal.setdefault(literal, []).append(number)
    automaton = ahocorasick.Automaton()
    for literal, numbers in by_literal.items():
        automaton.add_word(literal, numbers)
    if by_literal:
        automaton.make_automaton()

    def found(text: str) -> list[int]:
        out = set(always)
        if by_literal:
            for _, numbers in automaton.iter(lower(text)):
                out.update(numbers)
        return sorted(out)

    return found


def candidates(texts: Iterable[Column], patterns: list[tuple[int, str]]) -> Column:
    """For each row the numbers of the patterns that may match one of the texts, as an array.

    patterns: (number, pattern), a bounded list that goes to the workers; A-Z is taken without case. A row is passed
    over once, however many patterns there are.
    """
    literals, always = [], []
    for number, pattern in patterns:
        own = required_literals(pattern)
        literals += [(x, number) for x in own or []]
        always += [number] if own is None else []

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = _matcher(literals, always)
        for batch in batches:
            yield batch.map(lambda t: found(t or ""))

    return run(F.concat_ws("\n", *texts))


def with_candidates(rows: DataFrame, texts: list[str], catalogue: DataFrame, pattern: str) -> DataFrame:
    """rows joined with those of the catalogue whose pattern (a column) may match one of the texts: few, and none that does is lost.

    The catalogue, a list that people keep, comes to the driver in blocks of BLOCK rows, one automaton each.
    """
    blocks = max(1, -(-catalogue.count() // BLOCK))
    numbered = catalogue.withColumn("__block", F.pmod(F.xxhash64(*catalogue.columns), F.lit(blocks)))
    out = None
    for block in range(blocks):
        listed = [r.asDict() for r in numbered.filter(F.col("__block") == block).drop("__block").collect()]  # about BLOCK rows
        schema = StructType([*catalogue.schema.fields, StructField("__number", IntegerType())])
        own = catalogue.sparkSession.createDataFrame([{**r, "__number": k} for k, r in enumerate(listed)], schema)
        found = rows.withColumn("__number", F.explode(candidates([F.col(t) for t in texts], [(k, r[pattern]) for k, r in enumerate(listed)])))
        met = found.join(F.broadcast(own), "__number").drop("__number")
        out = met if out is None else out.unionByName(met)
    return out


def _said(words: dict[str, list[int]], text: Column) -> Column:
    """For each row the numbers of the patterns that have one of the text's words."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: sorted({n for w in words.keys() & set(WORD.findall(t or "")) for n in words[w]}))

    return run(text)


def matches(rows: DataFrame, text: str, catalogue: DataFrame, pattern: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of rows joined with the rows of the catalogue whose pattern (a column) regexp_like() finds in the text.

    Patterns of whole words (whole_words) are found by the words of each text, read once for all of them and without a
    regex; the others are tried where one of their literals was met. The catalogue comes to the driver in blocks of BLOCK rows.
    """
    known = catalogue.filter(F.col(pattern).isNotNull())
    blocks = max(1, -(-known.count() // BLOCK))
    numbered = known.withColumn("__block", F.pmod(F.xxhash64(*catalogue.columns), F.lit(blocks)))
    make, schema = catalogue.sparkSession.createDataFrame, StructType([*catalogue.schema.fields, StructField("__number", IntegerType())])
    parts = []
    for block in range(blocks):
        own, others, words = [], [], {}
        for r in numbered.filter(F.col("__block") == block).drop("__block").collect():  # about BLOCK rows
            spelled = whole_words(r[pattern])
            for w in spelled or []:
                words.setdefault(w, []).append(len(own))
            (others if spelled is None else own).append(tuple(r) if spelled is None else (*r, len(own)))
        if words:
            found = rows.filter(F.col(text).isNotNull()).select(*keep, F.explode(_said(words, F.col(text))).alias("__number"))
            parts.append(found.join(F.broadcast(make(own, schema)), "__number").select(*keep, *catalogue.columns))
        if others:
            parts.append(with_candidates(rows, [text], make(others, catalogue.schema), pattern).filter(F.regexp_like(text, F.col(pattern))).select(*keep, *catalogue.columns))
    return reduce(DataFrame.unionAll, parts) if parts else rows.select(*keep).crossJoin(known).limit(0)
