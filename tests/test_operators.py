"""Branches that the driver tables do not reach."""

import json

from pyspark.sql import functions as F

from lithograph.functions import text as T
from lithograph.operators import answers, chunking, ingest, metadata, reports, search


def pages(spark, *own):
    """own: (doc_id, text, headings, tables)."""
    rows = [(i, [(1, text, [(h, 0) for h in headings], [(t,) for t in tables])]) for i, text, headings, tables in own]
    return spark.createDataFrame(rows, f"doc_id long, pages {chunking.PAGES}")


def chunked(spark, text="", headings=(), tables=()):
    return [r.asDict() for r in chunking.chunk_documents(pages(spark, (1, text, headings, tables))).orderBy("ordinal").collect()]


def test_chunks_follow_headings_and_types(spark):
    out = chunked(spark, "Overview\nIt washes.\nInstallation\n1. Fit the pump.\nWARNING: Disconnect power first.\nplain", ["Overview", "Installation"])
    assert [(c["section_heading"], c["chunk_type"]) for c in out] == [("Overview", "text"), ("Installation", "procedure"), ("Installation", "warning"), ("Installation", "text")]


def test_spaced_heading_keeps_its_form(spark):
    assert chunked(spark, "ACME  WASHERS\nbody", ["ACME   WASHERS"])[0]["section_heading"] == "ACME   WASHERS"


def test_error_tables_and_listings(spark):
    out = chunked(spark, "Fault Codes\nsee below", ["Fault Codes"], [[["Code", "Meaning"], ["x", "y"]]])
    assert {c["chunk_type"] for c in out} == {"error_code"}
    assert chunked(spark, "", (), [[["a", "b"], ["E1", "x"], ["E2", "y"], ["E3", "z"]]])[0]["chunk_type"] == "error_code"
    assert chunked(spark, "", (), [[["Part", "Number"], ["pump", "12"]]])[0]["chunk_type"] == "table"
    assert chunked(spark, "error E1 and E2 or E3")[0]["chunk_type"] == "error_code"


def test_large_tables_are_cut_between_rows_and_cells(spark):
    rows = [["Code", "Meaning", "Action"]] + [[f"E{i}", "meaning " * 4, "action " * 4] for i in range(200)]
    out = chunked(spark, "", (), [rows])
    assert len(out) > 1 and all(c["char_count"] <= chunking.MAX_TABLE_CHARS for c in out)
    assert all(c["content"].count("| Code |") == 1 for c in out)
    joined = "\n".join(c["content"] for c in out)
    assert all(f"| E{i} |" in joined for i in range(200))
    wide = chunked(spark, "", (), [[["a", "b"], ["x" * 1500, "y" * 1500]]])
    assert len(wide) == 2 and "x" * 1500 in wide[0]["content"] and "y" * 1500 in wide[1]["content"]
    assert "z" * 4000 in chunked(spark, "", (), [[["a"], ["z" * 4000]]])[0]["content"]


def test_empty_documents_have_no_chunks(spark):
    assert chunked(spark, " \n ") == []
    assert chunking.chunk_documents(spark.createDataFrame([(1, None)], f"doc_id long, pages {chunking.PAGES}")).count() == 0


def test_material_tokens_and_claims(spark):
    row = spark.createDataFrame([("Use part 81-118-31 at 240V, 0.5A; step 1. E4!",)], "t string")
    got = set(row.select(T.material_tokens(F.col("t"))).first()[0])
    assert got == {"81-118-31", "240", "0.5", "E4"}
    ok = lambda claim, cited: spark.range(1).select(T.claim_supported(T.material_tokens(F.lit(claim)), F.lit(cited))).first()[0]
    assert ok("Set 240V", "supply 240 V ac") and not ok("Set 208V", "supply 240 V ac") and ok("Turn it on", "")


def test_responses_are_checked(spark):
    item = lambda text, *n: {"text": text, "cited_excerpt_numbers": list(n)}
    base = {"claims": [item("Supply 240V", 1)], "steps": [item("Press E4", 2)], "warnings": [item("WARNING: Disconnect power", 1)]}
    cases = {
        1: base,
        2: base | {"claims": [item("Supply 999V", 1)]},
        3: base | {"warnings": [item("WARNING: never invented", 1)]},
        4: base | {"claims": [item("Supply 240V", 7)]},
        5: {"claims": [], "steps": [], "warnings": []},
        6: {"is_no_answer": True, "no_answer_explanation": "Not found."},
        7: {"is_no_answer": True},
    }
    rows = [(k, "```" + json.dumps(v) + "```", ["supply 240 V. Disconnect power before service", "press E4 twice"]) for k, v in cases.items()]
    rows.append((8, "no json", []))
    got = {r["query_id"]: r for r in answers.validate(spark.createDataFrame(rows, "query_id int, raw string, excerpts array<string>")).collect()}
    assert {k for k, r in got.items() if r["valid"]} == {1, 6}
    assert got[1]["answer"] == "- Supply 240V\n\n**Steps:**\n1. Press E4" and got[1]["cited"] == [1, 2] and got[6]["answer"] == "Not found."


def passages(spark, *rows):
    own = [(1, q, p, c, text, kind, float(s)) for q, p, c, text, kind, s in rows]
    return spark.createDataFrame(own, "query_id int, question string, place int, chunk_id int, content string, chunk_type string, vector_score double")


def test_answers_by_score_code_or_not_at_all(spark):
    decide = lambda *rows: answers.decide(passages(spark, *rows)).first()
    assert decide(("q", 1, 10, "a", "text", 0.7), ("q", 2, 11, "b", "text", 0.9))["top_id"] == 10
    assert decide(("q", 1, 10, "a", "text", 0.1), ("q", 2, 11, "b", "text", 0.7), ("q", 3, 12, "c", "text", 0.9))["top_id"] == 12
    found = decide(("part 81-118-31?", 1, 10, "E40", "text", 0.6), ("part 81-118-31?", 2, 11, "Order 81-118-31 here", "text", 0.6))
    assert found["top_id"] == 11 and found["reason"] == "code" and found["citations"] == [11, 10]
    assert decide(("E4?", 1, 10, "E", "text", 0.6))["reason"] == "none"
    warned = decide(("q", 1, 10, "x\nWARNING: hot surfaces inside\n", "text", 0.7), ("q", 2, 11, "CAUTION", "warning", 0.1))
    assert warned["warnings"] == ["WARNING: hot surfaces inside", "CAUTION"]


def test_boosts_are_substring_rules(spark):
    row = spark.createDataFrame([("error_code", "service_repair", True), ("table", "x", False), ("warning", "x", True)], "k string, t string, c boolean")
    got = [round(r[0], 2) for r in row.select(search.rerank_boost("Won't heat: decode the particular fault, safe?", F.col("k"), F.col("t"), F.col("c"))).collect()]
    assert got == [0.55, 0.05, 0.3]


def test_ingestion_actions(spark):
    docs = spark.createDataFrame([(1, "a", "s1", "indexed", None), (2, "b", "s2", "failed", None), (3, "c", "s3", "indexed", None), (4, "d", "s4", "indexed", None)], "id int, source_ref string, sha256 string, status string, deactivated_at timestamp")
    listing = spark.createDataFrame([("a", "s1", "ok", 3), ("b", "s2", "ok", 2), ("c", "new", "failed", 0), ("d", "s4b", "ok", 2), ("e", "s1", "ok", 3), ("f", "s9", "ok", 1), ("g", "s9", "ok", 1), ("h", "s10", "unsupported", 0)], "source_ref string, sha256 string, extract_status string, n_chunks int")
    got = {r["source_ref"]: r["action"] for r in ingest.actions(listing, docs).collect()}
    assert got == {"a": "skipped_unchanged", "b": "indexed", "c": "kept_previous", "d": "replaced", "e": "duplicate", "f": "indexed", "g": "duplicate", "h": "unsupported"}


def test_keyed_writes(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, ingest.insert_missing(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, ingest.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "c")]
    for run, df in (("1", old), ("2", new)):
        ingest.publish(df, str(tmp_path), run)
    assert sorted(map(tuple, ingest.current(spark, str(tmp_path)).collect())) == [(2, "x"), (3, "c")]


def test_metadata(spark):
    makers = (("Acme", (r"\bACME\b",)),)
    text = "ACME Turbo\nTurbo, Mega, Giga\nX, Y, Z are trademarks of Acme\nSERVICE MANUAL Rev. 2.08B 58039.0002 D\nMega....... 13"
    rows = [(1, "turbo.pdf", [(1, text, [("Title", 0)], [])]), (2, "unknown.pdf", [(1, "nothing", [], [])])]
    described = metadata.describe(spark.createDataFrame(rows, f"doc_id int, filename string, pages {chunking.PAGES}"), makers)
    first, second = described.orderBy("doc_id").collect()
    assert (first["manufacturer"], first["doc_type"], first["revision"], first["doc_number"], first["title"]) == ("Acme", "service_repair", "2.08B", "58039.0002 D", "Title")
    assert (second["manufacturer"], second["doc_type"], second["title"]) == (None, "unknown", "nothing")
    catalogue = spark.createDataFrame([("Acme", "Turbo", r"\bturbo\b"), ("Acme", "Mega", r"\bmega\b")], "manufacturer string, model_name string, pattern string")
    got = {(r["doc_id"], r["model_name"]): (r["confidence"], r["linked"]) for r in metadata.match_models(described, catalogue).collect()}
    assert got == {(1, "Turbo"): (0.97, True)}


def test_file_types(spark, tmp_path):
    from lithograph.sources.files import folder

    for name, raw in (("a.pdf", b"%PDF-1.4"), ("b.docx", b"%PDF-1.7"), ("c.doc", bytes.fromhex("D0CF11E0A1B11AE1")), ("d.xyz", b"?")):
        (tmp_path / name).write_bytes(raw)
    got = {r["source_ref"]: (r["file_type"], r["note"]) for r in folder(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("pdf", None), "b.docx": ("pdf", "named as docx, content is pdf"), "c.doc": ("doc", None), "d.xyz": ("unknown", None)}


def test_evaluation_rates(spark):
    cases = spark.createDataFrame([("1", "turbo", ["k"], ["mega"], False), ("2", None, [], [], True)], "id string, expected_filename_contains string, expected_keywords array<string>, must_not_come_from array<string>, expect_no_answer boolean")
    found = spark.createDataFrame([("1", ["Turbo.pdf"], "has K", False), ("2", [], "", True)], "id string, filenames array<string>, content string, is_no_answer boolean")
    assert tuple(reports.evaluate(cases, found).first()) == (2, 2, 1.0, 1.0, 1.0, 1.0, None)


def test_streams(spark, tmp_path):
    from lithograph.streaming.ingestion import ingest_new

    source, seen = tmp_path / "in", []
    spark.createDataFrame([(1, "a")], "k int, v string").write.mode("append").parquet(str(source))
    take = lambda df, n: seen.extend(map(tuple, df.collect()))
    for _ in range(2):
        ingest_new(spark, str(source), "k int, v string", str(tmp_path / "state"), take)
    assert seen == [(1, "a")]


def test_stems_and_folding():
    from lithograph.functions.stem import fold, stem

    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
        "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file",
        "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "valenci": "valenc", "digitizer": "digit", "operator": "oper", "feudalism": "feudal",
        "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr",
        "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt",
        "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "as": "as",
    }
    assert {w: stem(w) for w in pairs} == pairs
    assert fold("Résumés") == stem("resumes") and fold("ÉLAN") == "elan"


def test_index_with_positions_phrases_and_stems(spark, tmp_path):
    from lithograph.operators import index

    rows = [(1, "Replace the water pump. The pump leaks."), (2, "pump water"), (3, "Pumping café waters"), (4, None), (5, "water/pump and a pump"), (6, "error E4 (code)")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, stems = index.build_index(docs, str(tmp_path / "a")), index.build_index(docs, str(tmp_path / "b"), stemmed=True)
    ids = lambda i, q, **k: [r["doc_id"] for r in index.search(i, q, **k).collect()]
    assert sorted(ids(plain, "water/pump")) == [1, 5] and sorted(ids(plain, "water pump")) == [1, 2, 5]
    assert sorted(ids(stems, "pumps")) == [1, 2, 3, 5] and ids(stems, "CAFE") == [3] and ids(plain, "cafe") == []
    assert sorted(ids(plain, "pump", eligible=docs.filter("doc_id < 3"))) == [1, 2]
    for odd in ('error "code" (E4)', "what's -this: code?"):
        assert ids(plain, odd) == [6]
    assert ids(plain, "***") == ids(plain, "") == ids(plain, "/") == []
    once, twice = (index.search(plain, q).collect()[0]["score"] for q in ("leaks", "leaks leaks"))
    assert abs(twice - 2 * once) < 1e-5
    want = {r["doc_id"]: r["score"] for r in search.bm25(docs, ["pump", "water"]).collect()}
    assert {r["doc_id"]: r["score"] for r in index.search(plain, "pump water").collect()} == want
    plan = index.search(plain, "pump")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,pump)" in plan


def test_eligibility(spark):
    docs = spark.createDataFrame(
        [(1, "indexed", None, "approved", True), (2, "partial", None, "approved", False), (3, "failed", None, "approved", True), (4, "indexed", 1, "approved", True), (5, "indexed", None, "pending", True)],
        "id int, status string, deactivated_at int, review_status string, is_current_revision boolean",
    )
    links = spark.createDataFrame([(1, 7, "approved"), (2, 7, "pending")], "document_id int, machine_id int, review_status string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(ingest.eligible(docs)) == [1] and ids(ingest.eligible(docs, include_superseded=True)) == [1, 2]
    assert ids(ingest.eligible(docs, links, 7, True)) == [1] and ids(ingest.eligible(docs, links, 8)) == []


def test_near_duplicates_of_copies(spark):
    from lithograph.operators import dedup

    base, other = "a b c d e f g h i j k l", "q r s t u v w x y z"
    rows = [(1, base), (2, base + " m n"), (3, base.upper()), (4, other), (5, None), (6, "x y"), (7, "x y"), (8, base + " m n"), (9, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["dup_id"]: (r["kept_id"], r["containment"]) for r in dedup.near_duplicates(docs).collect()}
    assert got == {2: (1, 1.0), 3: (1, 1.0), 7: (6, 1.0), 8: (1, 1.0), 9: (1, 1.0)}
    assert [tuple(r) for r in dedup.containment_pairs(docs).collect()] == [(1, 2, 1.0)]
    assert {r["doc_id"]: r["class_id"] for r in dedup.shingle_classes(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 6: 6, 7: 6, 8: 2, 9: 1}


def test_verbatim_support_of_short_and_edge_items(spark):
    docs = spark.createDataFrame([(1, "Set the  valve to 240V\nnow"), (2, "SET THE VALVE TO 240VOLTS"), (3, "*** !!! ***"), (4, "reset the valve to 240v today"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "set the valve to 240v"), (2, "valve"), (3, "!!!"), (4, "!!! ***"), (5, ""), (6, "et the valve to 240"), (7, "no such words here"), (8, "the valve to")], "item_id long, text string")
    got = {}
    for r in answers.supporting_documents(items, docs).collect():
        got.setdefault(r["item_id"], set()).add(r["doc_id"])
    assert got == {1: {1, 2, 4}, 2: {1, 2, 4}, 3: {3}, 4: {3}, 6: {1, 2, 4}, 8: {1, 2, 4}}


def test_support_is_sqls_contains(spark, monkeypatch):
    """Row for row what the registered SQL gives: copies of ids, letters whose upper case is several, other white space, empty items."""
    import duckdb

    from lithograph.functions.text import SINGLE_UPPER, upper_each
    from lithograph.plans import catalogue

    texts = ["in der Straße nach Norden geht es", "IN DER STRASSE NACH NORDEN GEHT ES", "a\x0bb c d e", "a b c d e", "\u00a0ﬁne\u2003words  here, too\u3000", "FINE WORDS HERE", "", " \t", None, "ᾳ ᾼ one", "ΑΙ one"]
    docs = [(i // 2, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    items = [(k, t) for k, t in enumerate(["der straße nach norden geht", "der strasse nach norden geht", "A B C D", "a\x0bb c", "\u00a0ﬁne\u2003words here", "fine words", "", " ", None, "ᾳ", "αι", "one"])] + [(0, "der straße nach norden geht")]
    made, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", made), ("benchmark", asked)):
        own = df.toPandas()  # noqa: F841
        con.sql(f"CREATE TABLE {name} AS SELECT * FROM own")
    want = sorted(con.sql(catalogue.ORACLES["claim_support"]).fetchall())
    for few in (20_000, 1):
        monkeypatch.setattr(answers, "BROADCAST_ITEMS", few)
        assert sorted(map(tuple, answers.supporting_documents(asked, made, empty=True).collect())) == want
    letters = [chr(k) for k in (*range(128, 0xD800), *range(0xE000, 0x11000)) if chr(k) in SINGLE_UPPER or k < 0x3000]
    got = spark.createDataFrame([(c,) for c in letters], "c string").select("c", upper_each(F.concat(F.lit("a"), F.col("c"), F.lit("z"))).alias("u")).collect()
    assert {r["c"]: r["u"] for r in got} == {c: u for c in letters for (u,) in con.execute("SELECT upper('a' || ? || 'z')", [c]).fetchall()}


def test_models_are_judged_hit_by_hit(spark):
    text = "compatible with Turbo grinders and also thirty more characters, Turbo setup follows here; " + "x" * 80 + " used with Mega."
    described = spark.createDataFrame([(1, "f.pdf", text, "Acme", "parts"), (2, "g.pdf", "works with Mega and optional Mega", None, "unknown")], "doc_id int, filename string, body string, manufacturer string, doc_type string")
    catalogue = spark.createDataFrame([("Acme", "Turbo", r"\bturbo\b"), ("Acme", "Mega", r"\bmega\b|\bgiga\b")], "manufacturer string, model_name string, pattern string")
    matches = metadata.match_models(described, catalogue)
    assert {(r["doc_id"], r["model_name"]): r["confidence"] for r in matches.collect()} == {(1, "Turbo"): 0.9, (1, "Mega"): 0.2, (2, "Mega"): 0.2}
    notes = {r["doc_id"]: r["notes"] for r in metadata.review_notes(described, matches).collect()}
    assert notes == {1: [], 2: [metadata.NO_MAKER, metadata.NO_MODEL, metadata.NO_TYPE]}
    tiers = spark.createDataFrame([(1, "turbo.pdf", "Mega here", "Acme", "x"), (2, "h.pdf", "Mega here", None, "x")], described.schema)
    got = {(r["doc_id"], r["model_name"]): (r["confidence"], r["linked"]) for r in metadata.match_models(tiers, catalogue).collect()}
    assert got == {(1, "Turbo"): (0.97, True), (1, "Mega"): (0.4, False), (2, "Mega"): (0.6, True)}


def test_mentions(spark):
    from lithograph.operators import mentions

    assert mentions.token_set_ratio("the tf dbc brewer", "tf dbc") == 100 and mentions.token_set_ratio("", "a") == 0
    assert abs(mentions.token_set_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bare") - 100 * 2 * 21 / 44) < 5
    machines = spark.createDataFrame([(1, "Acme", "AJ/AJX Series", None), (2, "Acme", "TF-DBC", ["dual brewer"]), (3, "Beta", "AJ", None), (4, "Beta", "X", None)], "id int, manufacturer string, model_name string, aliases array<string>")
    asked = ["the AJX Series leaks", "the AJ machine", "my Dual Brewer?", "how is the TF-DBCC", "ajar doors", "x"]
    got = {r["query_id"]: (r["machine_id"], r["options"]) for r in mentions.resolve(spark.createDataFrame(list(enumerate(asked)), "query_id int, question string"), machines).collect()}
    assert got == {0: (1, []), 1: (None, ["Acme AJ/AJX Series", "Beta AJ"]), 2: (2, []), 3: (2, []) if mentions.token_set_ratio(asked[3].lower(), "tf-dbc") >= 85 else (None, []), 4: (None, []), 5: (None, [])}


def test_word_files(spark, tmp_path):
    import io
    import zipfile

    from lithograph.operators import extraction

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{para(text)}</w:tc>"
    table = f'<w:tbl><w:tr>{cell("Code", "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}</w:tr><w:tr>{cell("E1", "<w:vMerge w:val=" + chr(34) + "restart" + chr(34) + "/>")}{cell("a")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("b")}</w:tr></w:tbl>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body>{para("Setup", "H1")}{para("Fit it.")}{table}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    line = "A line of the body text number %d of an old file"
    old = bytes.fromhex("D0CF11E0A1B11AE1") + "\r".join([line % i for i in range(8)] + [line % 1, "Normal", "ab"]).encode("utf-16-le")
    files = [("a", "a.docx", buffer.getvalue()), ("b", "b.doc", old), ("c", "c.doc", old[:100]), ("d", "d.indd", b"x"), ("e", "e.docx", b"PK\x03\x04broken"), ("f", "f.xyz", None)]
    got = {r["source_ref"]: r for r in extraction.extract(spark.createDataFrame(files, "source_ref string, filename string, content binary")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "ok", "b": "partial", "c": "failed", "d": "unsupported", "e": "failed", "f": "unsupported"}
    page = got["a"]["pages"][0]
    assert page["text"] == "Setup\nFit it." and [(h["text"], h["rank"]) for h in page["headings"]] == [("Setup", 0)]
    assert page["tables"][0]["rows"] == [["Code", "Code"], ["E1", "a"], ["E1", "b"]]
    assert got["b"]["pages"][0]["text"].split("\n") == [line % i for i in range(8)]
    own = {"xyz": lambda content: ("ok", None, [])}
    assert extraction.extract(spark.createDataFrame(files[-1:], "source_ref string, filename string, content binary"), {"unknown": own["xyz"]}).first()["status"] == "ok"


def test_answers_quote_and_support(spark):
    rows = [(1, "q", p, 10 + p, f"text {p}", "text", s, f"f{p}.pdf", p, "Acme", p, True) for p, s in ((1, 0.7), (2, 0.9), (3, 0.65), (4, 0.1), (5, 0.8), (6, 0.95))]
    passages_ = spark.createDataFrame(rows, "query_id int, question string, place int, chunk_id int, content string, chunk_type string, vector_score double, filename string, page_number int, machine_label string, document_id int, is_current boolean")
    got = {r["query_id"]: r for r in answers.answer_all(spark.createDataFrame([(1,), (2,)], "query_id int"), passages_).collect()}
    assert got[1]["answer"] == "From the manual for **Acme**:\n\ntext 1\n\n**Additional relevant passages:**\n\n*f6.pdf, p.6*\ntext 6\n\n*f2.pdf, p.2*\ntext 2\n\n*f5.pdf, p.5*\ntext 5"
    assert got[1]["supporting"] == [16, 12, 15] and got[1]["citations"] == [11, 12, 13, 14, 15] and got[1]["conflict"] is False
    assert (got[2]["reason"], got[2]["answer"]) == ("nothing", answers.NOTHING_FOUND)
    cited = answers.cited_excerpts(answers.decide(passages_), passages_).orderBy("place").collect()
    assert [(r["place"], r["chunk_id"], r["excerpt"]) for r in cited][:2] == [(1, 11, "text 1"), (2, 12, "text 2")]
    old = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False), (3, 1, True), (3, 2, True)], "query_id int, document_id int, is_current boolean")
    assert {r["query_id"]: r["conflict"] for r in answers.revision_conflict(old).collect()} == {1: True, 2: False, 3: False}


def test_runs_are_recorded_and_exclusive(spark, tmp_path):
    import pytest

    root = str(tmp_path / "runs")
    listing = lambda: spark.createDataFrame([("a", "indexed", None)], "source_ref string, event string, detail string")
    assert ingest.run(spark, root, listing, lambda f: f) == "completed"
    assert ingest.run(spark, root, listing, lambda f: f.withColumn("event", F.lit("failed"))) == "completed_with_errors"

    def broken():
        raise OSError("no access")

    def nested():
        with pytest.raises(RuntimeError):
            ingest.run(spark, root, listing, lambda f: f)
        return listing()

    with pytest.raises(OSError, match="no access"):
        ingest.run(spark, root, broken, lambda f: f)
    assert ingest.run(spark, root, nested, lambda f: f) == "completed"
    runs = ingest.run_status(spark, root).collect()
    assert sorted(r["status"] for r in runs) == ["completed", "completed", "completed_with_errors", "failed"] and all(r["finished_at"] >= r["started_at"] for r in runs)
    assert spark.read.parquet(f"{root}/events").filter("source_ref = '(run)'").first()["detail"].startswith("run aborted")


def test_keys_copies_and_backfills(spark):
    old = spark.createDataFrame([(4, "a", "x")], "id long, name string, note string")
    got = sorted((r["id"], r["name"], r["note"]) for r in ingest.with_new_keys(old, spark.createDataFrame([("a",), ("b",), ("b",)], "name string"), ["name"]).collect())
    assert got[0] == (4, "a", "x") and len(got) == 2 and got[1][0] > 4 and got[1][1:] == ("b", None)
    files = spark.createDataFrame([("A.PDF", "0123456789abcdef99", b"1"), ("b.pdf", "0123456789abcdef99", b"1"), ("c", "ffff", b"2")], "filename string, sha256 string, content binary")
    assert [r["storage_path"] for r in ingest.new_copies(files, spark.createDataFrame([("ffff",)], "storage_path string")).collect()] == ["0123456789abcdef.pdf"]
    docs = spark.createDataFrame([(1, None, None), (2, None, 1), (3, "pending", None)], "id int, review_status string, deactivated_at int")
    assert {r["id"]: r["review_status"] for r in ingest.grandfathered(docs).collect()} == {1: "approved", 2: None, 3: "pending"}


def test_embeddings(spark):
    from lithograph.operators import embedding

    rows = spark.createDataFrame([(1, "a pump leaks"), (2, "A PUMP, leaks!"), (3, None), (4, "other words")], "chunk_id long, text string")
    got = {r["chunk_id"]: r["embedding"] for r in embedding.embed(rows, "chunk_id").collect()}
    assert got[1] == got[2] != got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and not any(got[3])
    assert embedding.embed_question("a pump leaks") == got[1]
    known = spark.createDataFrame([(1, [0.0])], "chunk_id long, embedding array<float>")
    assert sorted(r["chunk_id"] for r in embedding.embed_pending(rows, known, "chunk_id").collect()) == [2, 3, 4]


def test_nearest_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    v = np.random.default_rng(0).normal(size=(200, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in search.nearest(rows, rows.filter("vec_id % 25 = 0"), 3).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 200, 25):
        s = v.astype(float) @ v[q].astype(float)
        s[q] = -np.inf
        assert got[q] == set(np.argsort(-s)[:3].tolist())


def test_cases_are_judged(spark):
    cases = spark.createDataFrame(
        [("1", "m", "turbo", ["k"], ["mega"], False, False), ("2", None, None, [], [], True, False), ("3", None, None, [], [], False, True), ("4", "none", "turbo", [], [], False, False), ("5", None, "x", [], [], False, False), ("6", None, "turbo", [], ["turbo"], False, False)],
        "id string, machine string, expected_filename_contains string, expected_keywords array<string>, must_not_come_from array<string>, expect_no_answer boolean, expect_clarifying_question boolean",
    )
    found = spark.createDataFrame([(str(i), ["Turbo.pdf"], "has K", i == 2, i == 3) for i in (1, 2, 3, 4, 6)], "id string, filenames array<string>, content string, is_no_answer boolean, is_clarifying_question boolean")
    machines = spark.createDataFrame([("m",)], "model_name string")
    got = {r["id"]: (r["hit"], r["support"], r["isolated"], r["ok"]) for r in reports.case_results(cases, found, machines).collect()}
    assert got == {"1": (True, True, True, True), "2": (None, None, None, True), "3": (None, None, None, True), "4": (True, None, None, False), "5": (False, None, None, False), "6": (True, None, False, False)}
    assert reports.evaluate(cases, found, machines).first()["passed"] == 3


def test_sources(spark, tmp_path):
    from lithograph.sources import files

    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"cases": [{"id": "1", "question": "q", "expected_keywords": ["a"]}, {"id": "2", "expect_no_answer": True}]}))
    rows = files.ground_truth(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["expected_keywords"], r["expect_no_answer"]) for r in rows] == [("1", ["a"], None), ("2", None, True)]
    docs = spark.createDataFrame([("a", "1", "x", None), ("b", "2", "x", None), ("c", "3", "x", None), ("d", "4", "x", None), ("e", "5", "x", 1)], "source_ref string, sha256 string, filename string, deactivated_at int")
    listing = spark.createDataFrame([("a", "1", "x"), ("b", "9", "x"), ("c", "3", "y")], "source_ref string, sha256 string, filename string")
    assert {r["source_ref"]: r["finding"] for r in files.listing_audit(listing, docs).collect()} == {"a": "ok", "b": "mismatch", "c": "renamed", "d": "missing"}
    assert spark.range(1).select(files.safe_name(F.lit("a b/ç.pdf"))).first()[0] == "a_b__.pdf"


def test_rate_limit_stream(spark, tmp_path):
    from lithograph.streaming.ingestion import rate_limit_stream

    source = str(tmp_path / "events")
    spark.sql("SELECT 1 AS user_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts FROM range(5)").write.parquet(source)
    stream = rate_limit_stream(spark.readStream.schema("user_id int, ts timestamp").parquet(source), 3)
    query = stream.writeStream.format("memory").queryName("breaches").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["user_id"], r["n"]) for r in spark.table("breaches").collect()] == [(1, 5)]
