"""The pipeline's decisions against a plain version over the same rows."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from lithograph.llm import common, near_dedup, toxicity

from .test_operators import BASE, EDITED, ITEM, least, prose, squeezed


def test_pipeline(spark, tmp_path):
    clean = [(i, prose(500 + i, 40)) for i in range(300)]
    toxic = [(1000 + i, prose(900 + i, 40) + " you utterblockhead") for i in range(100)]
    copies = [(2000, BASE), (2001, "  ".join(BASE.split(" "))), (2002, EDITED), (2003, prose(7, 30) + " " + ITEM + " " + prose(8, 30)), (2004, None)]
    rows = clean + toxic + copies
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(1000 <= i < 1100)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    sf = str(tmp_path)
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, toxicity.train(docs, labels)).collect()}
    want = {i for i, _ in rows if scores[i] < toxicity.THRESHOLD} - {2001, 2002, 2003}
    assert 2000 in want and 2004 in want and len(want & set(range(300))) > 290 and not want & set(range(1000, 1100))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == want
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(rows)
    assert all(r.ids == library.encode(texts[i] or "") and r.parity for i, r in got.items())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact copies", "near copies", "benchmark passages", "token ids"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns


def test_stages_match_brute_force_on_whole_tables(spark):
    """Each stage on its own input, against plain loops over all rows, pairs and windows."""
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    kept = corpus_pipeline.toxicity(spark, docs, sf)
    model = toxicity.train(docs, common.table(spark, sf, "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i, t in rows.items() if model.score(t) < toxicity.THRESHOLD}
    assert {r.doc_id for r in kept.collect()} == clean

    kept = corpus_pipeline.exact_copies(spark, kept, sf)
    groups = {}
    for i in clean:
        groups.setdefault(squeezed(rows[i]), []).append(i)
    own = {least(g) for g in groups.values()}
    assert {r.doc_id for r in kept.collect()} == own and len(own) < len(clean)

    idf = near_dedup.inverse_frequencies(*near_dedup.word_frequencies(near_dedup._keyed(kept)))
    vectors = {i: near_dedup.weighted_shingles([rows[i] or ""], idf)[:2] for i in own}
    root = {i: i for i in own}
    for a in sorted(own):
        for b in sorted(own):
            if b < a and near_dedup.weighted_jaccard(vectors[a], vectors[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    kept = corpus_pipeline.near_copies(spark, kept, sf)
    left = {r.doc_id for r in kept.collect()}
    assert left == set(root.values())

    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    items = [split(r.text) for r in common.table(spark, sf, "benchmark").collect()]
    df = Counter(s for w in items for s in set(cut(w)))
    weight = lambda s: max(1, int(16 * np.log((2 + len(items)) / df[s]) / np.log(2 + len(items)) + 0.5)) if s in df else 16
    dirty = set()
    for i in left:
        all_ = cut(split(rows[i]))
        hit = np.array([s in df for s in all_], dtype=bool)
        for item in items:
            a, n = {s: c * weight(s) for s, c in Counter(cut(item)).items()}, len(item) - 4
            for at in range(max(len(all_) - n, 0) + 1):
                if hit[at : at + n].sum() >= 0.3 * n:
                    b = {s: c * weight(s) for s, c in Counter(all_[at : at + n]).items()}
                    shared = sum(min(v, b.get(s, 0)) for s, v in a.items())
                    if shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared):
                        dirty.add(i)
    assert {r.doc_id for r in corpus_pipeline.benchmark_passages(spark, kept, sf).collect()} == left - dirty


def test_stages_take_nulls_repeats_clashes_and_nothing(spark, tmp_path):
    columns = "doc_id long, text string, lang string, `__key` string, `row` string, `a.b` string, score double"
    rows = [(None, None, "n", "k", "r", "d", 1.0), (None, "x y", "n", "k", "r", "d", 2.0), (1, "", "n", "k", "r", "d", 3.0), (2, prose(1, 300), None, None, None, None, None), (2, prose(1, 300), None, None, None, None, None), (3, prose(2, 20_000), "n", "k", "r", "d", 4.0)]
    for name, own in (("full", rows), ("empty", [])):
        folder = tmp_path / name
        docs = spark.createDataFrame(own, columns)
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(folder))
            assert kept.columns == docs.columns
            assert {tuple(r) for r in kept.collect()} <= set(own)
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted(str(r.doc_id) for r in got) == (["2", "3", "None", "None"] if own else [])
