"""Queries that SQL has no words for, against plain versions over whole tables."""

import math
import re
import zlib
from collections import Counter

import pytest

from lithograph.functions.stem import fold
from lithograph.plans import catalogue

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_stemmed_search(spark):
    """BM25 over stems, document by document."""
    terms = {i: Counter(fold(w) for w in re.findall(r"[^\W_]+", t)) for i, t in documents(spark).items()}
    length = {i: sum(c.values()) for i, c in terms.items()}
    n, average = len(terms), sum(length.values()) / len(terms)
    scores = Counter()
    for t in (fold("Things"), fold("doing")):
        df = sum(t in c for c in terms.values())
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        for i, c in terms.items():
            if t in c:
                scores[i] += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length[i] / average))
    want = sorted((-round(s, 6), i) for i, s in scores.items())[:50]
    got = catalogue.QUERIES["stemmed_topk"](spark, SF).collect()
    assert [r["doc_id"] for r in got] == [i for _, i in want] and [r["score"] for r in got] == pytest.approx([-s for s, _ in want], abs=2e-6)


def test_embedded_documents(spark):
    """Signed counts of hashed words at unit length, word by word."""
    got = {r["doc_id"]: r["embedding"] for r in catalogue.QUERIES["embed_documents"](spark, SF).collect()}
    texts = documents(spark)
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        own = [0.0] * 64
        for w in re.findall(r"[^\W_]+", text.lower()):
            code = zlib.crc32(w.encode())
            own[code % 64] += 1.0 if code >> 16 & 1 else -1.0
        norm = math.sqrt(sum(x * x for x in own)) or 1.0
        assert got[i] == pytest.approx([x / norm for x in own], abs=1e-6)
