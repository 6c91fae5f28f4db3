"""Licence notices in files, by a positional index of rare words."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm.common import let, table, texts

#: The phrases whose places are counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Labels of the method's own: phrases that must stand whole.
PHRASES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("epl", "eclipse public license"),
    ("cc0", "cc0 1 0 universal"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
)

#: The words of public notices, by label; phrases of which all must stand in a file's notice; phrases that must not.
TEMPLATES = (
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify
        merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions""", ("free of charge", "deal in the software"), ()),
    ("apache-2", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
        license you may obtain a copy of the license at http www apache org licenses license 2 0""", ("apache license",), ()),
    ("bsd-3", """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and
        the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the
        copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission""", ("source and binary forms", "neither the name"), ()),
    ("bsd-2", """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and
        the following disclaimer in the documentation and or other materials provided with the distribution""",
        ("source and binary forms",), ("neither the name",)),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""", ("with or without fee",), ()),
    ("gpl-3", """free software you can redistribute it and or modify it under the terms of the gnu general public license as published
        by the free software foundation either version 3 of the license or at your option any later version""",
        ("gnu general public license", "version 3"), ()),
    ("gpl-2", """free software you can redistribute it and or modify it under the terms of the gnu general public license as published
        by the free software foundation either version 2 of the license or at your option any later version""",
        ("gnu general public license", "version 2"), ()),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3"), ()),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2"), ()),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at""", ("mozilla public license",), ()),
    ("mpl-2", "mozilla public license version 2 0", ("mozilla public license", "2 0"), ()),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
        compile sell or distribute this software""", ("unencumbered software",), ()),
    ("cc-by", "creative commons attribution", ("creative commons attribution",), (
        "attribution noncommercial", "attribution sharealike", "attribution noderivatives", "attribution non commercial", "attribution share alike", "attribution no derivatives")),
)
RARE = 2  #: rare words of a phrase whose places must agree before the phrase is compared
POSTINGS = 12  #: places of a template's rarest words that the index holds
SHARE = 0.6  #: of them must stand at one relative position, within ...
SLACK = 8  #: ... so many words, which leaves room for words that were added or dropped

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def phrases() -> list[tuple[str, list[str], bool]]:
    """(label, words, whether it is one of BASE), each phrase once."""
    out = [(label, words.split(), True) for words, label in BASE]
    have = {tuple(w) for _, w, _ in out}
    return out + [(label, words.split(), False) for label, words in PHRASES if tuple(words.split()) not in have]


def templates() -> list[tuple[str, list[str], tuple[str, ...], tuple[str, ...]]]:
    """(label, words, mandatory phrases, excluding phrases)."""
    return [(label, words.split(), must, never) for label, words, must, never in TEMPLATES]


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z: everything between runs of ASCII that is neither letter nor digit.

    lower() is much faster than translate() and changes other letters too, which are never part of a licence word and
    stay letters; only the Kelvin sign would become an ASCII letter, and texts with it are translated.
    """
    lowered = F.when(text.contains("\u212a"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))

    def trimmed(w: Column) -> Column:  # only the first and the last can be empty
        head, tail = (F.get(w, F.lit(0)) == "").cast("int"), (F.element_at(w, -1) == "").cast("int")
        return F.slice(w, head + 1, F.greatest(F.size(w) - head - tail, F.lit(0)))

    return let(F.split(lowered, NOT_WORD), trimmed)


def _vocabulary() -> list[str]:
    return sorted({w for _, words, *_ in [*phrases(), *templates()] for w in words})


def inverse_frequencies(words: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each licence word over all rows of words (an array column w)."""
    own = F.array(*[F.lit(w) for w in _vocabulary()])
    total = F.count(F.lit(1)).alias("n")
    held = words.select(F.array_intersect("w", own).alias("held"))
    n = held.agg(total).first()["n"]
    counts = held.select(F.explode("held").alias("word")).groupBy("word").count().collect()  # a row per licence word
    df = {r["word"]: r["count"] for r in counts}
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in _vocabulary()}


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The inverse document frequency of every licence word is counted over all documents. For each phrase the index
    holds its RARE rarest words with their places; where they stand at one phrase's relative positions, the whole
    phrase is compared, so that no place is missed. For each template, the notice of a licence, the index holds the
    POSTINGS places of its rarest words. A file's hits give, by place in the file less place in the template, where the
    notice would begin; where SHARE of the postings agree within SLACK words, the notice is there, changed or reflowed
    as it may be, once its mandatory phrases stand near and its excluding ones do not. n_base, first_word and last_word
    speak of the BASE phrases; score is the share of inverse document frequency that the best found phrase or template
    carries, scaled by the heaviest (0 without any). Null texts count as empty: no words, no labels, score 0. Null and
    repeated ids give a row each; other columns are ignored; an empty table gives an empty result.
    """
    words = texts(docs).select("doc_id", words_of(F.col("text")).alias("w"))
    return _scan(words, inverse_frequencies(words))


def _rarest(own: list[str], idf: dict[str, float], n: int) -> list[int]:
    return sorted(range(len(own)), key=lambda i: (-idf[own[i]], i))[:n]


def _phrase_hits(w: Column, at: Column, idf: dict[str, float]) -> Column:
    """Places (phrase number, first word) of every phrase in the words w; at: places of the words of the index."""
    index: dict[str, list[Column]] = {}
    for number, (_, own, _) in enumerate(phrases()):
        places = _rarest(own, idf, RARE)
        anchor, other = places[0], places[-1]
        index.setdefault(own[anchor], []).append(
            F.struct(F.lit(number).alias("n"), F.lit(anchor).alias("at"), F.lit(other).alias("other"), F.lit(own[other]).alias("word"), F.array(*map(F.lit, own)).alias("words"))
        )
    postings = F.create_map(*[x for word, rows in index.items() for x in (F.lit(word), F.array(*rows))])

    def found(i: Column) -> Column:
        start = lambda p: i - p["at"]
        rare = F.filter(postings[F.get(w, i)], lambda p: (start(p) >= 0) & F.coalesce(F.get(w, start(p) + p["other"]) == p["word"], F.lit(False)))
        whole = F.filter(rare, lambda p: F.slice(w, start(p) + 1, F.size(p["words"])) == p["words"])
        return F.transform(whole, lambda p: F.struct(p["n"].alias("n"), start(p).alias("start")))

    anchors = sorted(index)
    return F.flatten(F.transform(F.filter(at, lambda i: F.get(w, i).isin(anchors)), found))


def _template_hit(w: Column, at: Column, number: int, idf: dict[str, float]) -> Column:
    """The number of a template if the words w hold it, else null."""
    _, own, must, never = templates()[number]
    places = _rarest(own, idf, POSTINGS)
    need = max(1, math.ceil(SHARE * len(places)))
    postings: dict[str, list[int]] = {}
    for p in places:
        postings.setdefault(own[p], []).append(p)
    index = F.create_map(*[x for word, ps in postings.items() for x in (F.lit(word), F.array(*map(F.lit, ps)))])
    mine = F.filter(at, lambda i: F.get(w, i).isin(sorted(postings)))
    starts = F.array_sort(F.flatten(F.transform(mine, lambda i: F.transform(index[F.get(w, i)], lambda p: i - p))))

    def held(s: Column) -> Column:
        def there(k: Column) -> Column:
            low = F.greatest(F.get(s, k) - SLACK, F.lit(0))
            stretch = lambda n: F.concat(F.lit(" "), F.array_join(F.slice(w, low + 1, n), " "), F.lit(" "))
            near, further = stretch(len(own) + 2 * SLACK), stretch(2 * len(own) + 2 * SLACK)  # what excludes may follow the notice
            said = lambda text, phrase: F.contains(text, F.lit(f" {phrase} "))
            apt = reduce(lambda x, y: x & y, [said(near, m) for m in must] + [~said(further, m) for m in never])
            return F.when(F.get(s, k + (need - 1)) - F.get(s, k) <= SLACK, apt).otherwise(F.lit(False))

        return F.when(F.size(s) >= need, F.exists(F.sequence(F.lit(0), F.size(s) - need), there)).otherwise(F.lit(False))

    return F.when(let(starts, held), F.lit(number))


def _scan(words: DataFrame, idf: dict[str, float]) -> DataFrame:
    known, notices = phrases(), templates()
    sums = [sum(idf[w] for w in own) for _, own, *_ in [*known, *notices]]
    weight = F.array(*[F.lit(x / (max(sums) or 1.0)) for x in sums])
    label = F.array(*[F.lit(x[0]) for x in [*known, *notices]])
    is_base = [n for n, p in enumerate(known) if p[2]]
    indexed = {own[p] for _, own, _ in known for p in _rarest(own, idf, RARE)} | {own[p] for _, own, *_ in notices for p in _rarest(own, idf, POSTINGS)}

    def looked_up(w: Column) -> Column:
        """Places of the index's words."""
        return F.filter(F.transform(w, lambda x, i: F.when(x.isin(sorted(indexed)), i)), lambda i: i.isNotNull())

    def found(w: Column) -> Column:
        def by_place(at: Column) -> Column:
            hits = _phrase_hits(w, at, idf)
            more = F.array_compact(F.array(*[_template_hit(w, at, n, idf) for n in range(len(notices))]))
            nothing = F.struct(F.array().cast("array<struct<n:int,start:int>>").alias("phrases"), F.array().cast("array<int>").alias("templates"))
            return F.when(F.size(at) > 0, F.struct(hits.alias("phrases"), more.alias("templates"))).otherwise(nothing)

        return let(looked_up(w), by_place)

    row = words.select("doc_id", let(F.col("w"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), found(w).alias("found"))).alias("x"))

    def labels(numbers: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(numbers, lambda n: F.get(label, n)))), ",")

    def result(x: Column) -> Column:
        own = x["found"]["phrases"]
        base = F.filter(own, lambda f: f["n"].isin(is_base))
        starts = F.transform(base, lambda f: f["start"].cast("long"))
        numbers = F.concat(F.transform(own, lambda f: f["n"]), F.transform(x["found"]["templates"], lambda n: n + len(known)))
        return F.struct(
            x["n_words"].alias("n_words"),
            F.size(base).cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            labels(F.transform(base, lambda f: f["n"])).alias("base_labels"),
            labels(numbers).alias("labels"),
            F.coalesce(F.array_max(F.transform(numbers, lambda n: F.get(weight, n))), F.lit(0.0)).alias("score"),
        )

    return row.select("doc_id", let(F.col("x"), result).alias("r")).select("doc_id", "r.*")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES: dict[str, str] = {}
