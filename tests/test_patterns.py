"""The automaton of required literals and the fuzzy candidates against brute force."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lithograph.operators import mentions, patterns
from lithograph.plans import stored

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"\bturbo\b", ["turbo"]), (r"\bmega\b|\bgiga(x|y)z\b", ["giga", "mega"]), (r"TF[- ]?DBC", ["dbc"]), (r"\Qa.b|c\E\b", ["a.b|c"]),
        (r"(one|two)", None), (r"a*|b", None), (r"ab+c", ["ab"]), (r"x{0,2}yz", ["yz"]), (r"[a-z|]q", ["q"]), (r"CB[\]|x]-9", ["cb"]), (r"a\.b", ["a.b"]), (r"É1", ["É1"]), (r"(?x) a b", None),
    ],
)
def test_required_literals(pattern, want):
    assert patterns.required_literals(pattern) == want


PIECE = st.sampled_from(["a", "b", "ab", r"\.", "[ab]", "(a|b)", "a?", "b*", "a+", r"\b", "(ab)?", ".", r"\d", "1"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECE, min_size=1, max_size=5).map("".join), min_size=1, max_size=3).map("|".join), st.text("aAbB1. ", max_size=14))
def test_every_match_has_a_literal(pattern, text):
    literals = patterns.required_literals(pattern)
    if literals is not None and re.search(pattern, text, re.IGNORECASE | re.ASCII):
        assert any(x in patterns.lower(text) for x in literals)


def test_candidates_in_blocks(spark, monkeypatch):
    """A catalogue of several automata, patterns that require nothing, null texts, and hits equal to brute force."""
    monkeypatch.setattr(patterns, "BLOCK", 7)
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "xyz" for b in range(12)]
    listed = [(k, rng.choice([rf"\b{w}\b", rf"{w.upper()}-?\d", rf"{w}|{rng.choice(words)}s"])) for k, w in enumerate(words)] + [(99, r"\d{3}")]
    texts = [(k, " ".join(rng.choices(words, k=6)) + rng.choice(["", "s", "-7", " 123"]), rng.choice(words)) for k in range(60)] + [(60, None, None)]
    docs = spark.createDataFrame(texts, "doc_id int, body string, name string")
    found = patterns.with_candidates(docs, ["body", "name"], spark.createDataFrame(listed, "model int, pattern string"), "pattern")
    got = {(r["doc_id"], r["model"]) for r in found.collect()}
    want = {(k, m) for k, *own in texts for m, p in listed if any(t and re.search(p, t, re.IGNORECASE) for t in own)}
    assert want <= got and len(got) < 0.6 * len(texts) * len(listed)


LEFT, RIGHT = "(^|[^A-Za-z0-9_])", "([^A-Za-z0-9_]|$)"


@pytest.mark.parametrize(
    ("inner", "want"),
    [("ab[x-z]?", ["ab", "abx", "aby", "abz"]), ("a?[bC]_1", ["C_1", "aC_1", "ab_1", "b_1"]), ("a+", None), ("a|b", None), ("(a)", None), ("a?", None), ("[^a]b", None), ("[a-z][a-z]", None), (r"\bab", None), ("[Z-a]x", None), ("é", None)],
)
def test_whole_words(inner, want):
    assert patterns.whole_words(LEFT + inner + RIGHT) == want
    assert patterns.whole_words(inner) is None


def test_matches_are_those_of_the_regexes(spark, monkeypatch):
    """Whole words without a regex, others with one, in blocks: row for row what each pattern finds, copies of rows and items too."""
    monkeypatch.setattr(patterns, "BLOCK", 9)
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("x", "Y", "z_") for b in range(8)]
    listed = [(k, LEFT + w + rng.choice(["", "[a-c]?", "s?"]) + RIGHT) for k, w in enumerate(words)] + [(0, LEFT + "x0" + RIGHT), (50, "x1|z_2$"), (51, r"\d{2}"), (52, None)]
    texts = [(k, rng.choice(["", "é", "\n"]) + rng.choice([" ", "-", "é", "a", "\n"]).join(rng.choices(words, k=5)) + rng.choice(["", "s", "b", "\n", "."])) for k in range(80)] + [(3, "x0 z_2"), (3, "x0 z_2"), (90, None), (91, "")]
    docs, items = spark.createDataFrame(texts, "doc_id int, body string"), spark.createDataFrame(listed, "item_id int, pattern string")
    got = sorted((r["doc_id"], r["item_id"]) for r in patterns.matches(docs, "body", items, "pattern", ["doc_id"]).collect())
    want = sorted((r["doc_id"], r["item_id"]) for r in docs.crossJoin(items).filter("regexp_like(body, pattern)").collect())
    assert [x for x in got if x not in want] == [] and [x for x in want if x not in got] == []
    assert got == want and {0, 50} <= {k for _, k in got}


def test_whole_words_need_no_regex(spark):
    """model_hits reads each text once: no row is made for a pattern that does not match, and no regex runs."""
    plan = stored.QUERIES["model_hits"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "BroadcastNestedLoopJoin" not in plan


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=90), st.text("abc ", max_size=90))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    assert mentions.common(a, b) == row[-1]


def pairs_of(asked, named, threshold):
    return {(i, j) for i, a in asked for j, b in named if a and b and mentions.token_set_ratio(a, b) >= threshold}


@pytest.mark.parametrize("threshold", [80, 85, 95])
def test_fuzzy_pairs(spark, threshold):
    """All pairs of a table: edits within words, words left out, orders, one and two letters, empty and null texts."""
    rng = random.Random(5)
    names = [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 4))) for _ in range(70)] + ["a", "ab", "b", "tf-dbc", "", " ", "aj/ajx series"]

    def edited(text):
        own = list(text)
        for _ in range(rng.randint(0, 2)):
            if own:
                own[rng.randrange(len(own))] = rng.choice(["", "f", "ab", " "])
        return "".join(own)

    asked = [*enumerate([edited(n) for n in names * 2] + [" ".join(rng.sample(names, 2)) for _ in range(30)] + ["aj", "ajx the series aj/ajx"]), (900, None), (901, "")]
    got = mentions.fuzzy_pairs(spark.createDataFrame(asked, "ask int, text string"), spark.createDataFrame(list(enumerate(names)), "named int, text string"), threshold)
    rows = [(r["ask"], r["named"]) for r in got.collect()]
    want = pairs_of(asked, list(enumerate(names)), threshold)
    assert set(rows) == want and len(rows) == len(want)
    assert threshold > 90 or any(not set(dict(asked)[i].split()) & set(names[j].split()) for i, j in want)
    empty = spark.createDataFrame([], "named int, text string")
    assert mentions.fuzzy_pairs(spark.createDataFrame(asked, "ask int, text string"), empty, threshold).count() == 0
    with pytest.raises(ValueError, match="75"):
        mentions.fuzzy_pairs(empty, empty, 60)


def test_fuzzy_match_of_a_whole_table(spark):
    own = [(t, t) for t in {r["p_name"].lower() for r in spark.read.parquet(f"{SF}/part.parquet").collect()}]
    got = {(r["ask"], r["named"]) for r in stored.QUERIES["fuzzy_match"](spark, SF).collect()}
    assert got == {(i, j) for i, j in pairs_of(own, own, 85) if i != j}


def test_no_cross_join(spark):
    """Candidates come from equal words and pairs of characters, never from all pairs."""
    names = spark.range(50).selectExpr("id AS named", "concat('name ', id) AS text")
    plan = mentions.fuzzy_pairs(names.withColumnRenamed("named", "ask"), names)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
