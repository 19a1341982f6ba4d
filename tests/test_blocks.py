from lexigraph.sources import blocks as BL

FILE = """ARCHIVE_FOLDER: WESA 1
DOCUMENT_ID: D1
DATE:
PLACE: Newham
--------------------
body one
====================
no header here
====================
DOCUMENT: D2
text without a rule
"""


def parse(spark, lenient=False):
    files = spark.createDataFrame([("f_cleaned.txt", FILE)], "source_file string, content string")
    docs, rej = BL.parse_blocks(BL.split_blocks(files), lenient=lenient)
    return {r["doc_id"]: r.asDict() for r in docs.collect()}, rej.collect()


def test_blocks_strict(spark):
    docs, rej = parse(spark)
    assert set(docs) == {"D1", "D2"}
    d1, d2 = docs["D1"], docs["D2"]
    assert (d1["archive_folder"], d1["place"], d1["text"], d1["date"]) == ("WESA 1", "Newham", "body one", "Unknown")
    assert (d2["archive_folder"], d2["date"], d2["place"], d2["text"]) == ("", "Unknown", "Not stated",
                                                                        "text without a rule")
    assert len(rej) == 1 and rej[0]["block"] == "no header here"


def test_blocks_lenient_header_runs_over_line(spark):
    docs, _ = parse(spark, lenient=True)
    assert docs["D1"]["date"] == "PLACE: Newham"


def test_fallback_body_after_last_header(spark):
    f = "DOCUMENT_ID: X\nPAGES: 3\nthe body\nsecond line"
    files = spark.createDataFrame([("a.txt", f)], "source_file string, content string")
    docs, _ = BL.parse_blocks(BL.split_blocks(files))
    assert docs.first()["text"] == "the body\nsecond line"


def test_streaming_ingest(spark, tmp_path):
    from lexigraph.streaming.ingest import stream_documents
    src = tmp_path / "in"
    src.mkdir()
    body = " ".join(f"word{i}" for i in range(25))
    (src / "A_cleaned.txt").write_text(f"DOCUMENT_ID: A1\nPLACE: X\n{'-' * 20}\n{body}\n{'=' * 20}\nno id\n")
    (src / "TBUK_b.txt").write_text(f"DOCUMENT: B1\n{body}\n")
    out = str(tmp_path / "out")
    q = stream_documents(spark, str(src), out)
    q.awaitTermination(120)
    rows = {r["doc_id"]: r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {"A1", "B1"}
    assert rows["B1"]["series"] == "TBUK" and rows["A1"]["word_count"] == 25
