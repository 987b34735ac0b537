import hashlib
import io
import json
import sqlite3
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.functions import text as T
from tidewater.operators import chunker, fusion, lines, match
from tidewater.plans import catalog
from tidewater.settings import Settings, local_limit, parse_duration
from tidewater.sources import extract, web


def lengths(text, target, overlap):
    return [len(c.text.encode()) for c in chunker.chunk_text(text, target, overlap)]


def test_chunker_carry_only_chunks():
    assert lengths("x" * 500, 100, 30) == [100, 30, 131, 30, 131, 30, 131, 30, 131]
    assert lengths("x" * 500, 100, 0) == [100] * 5
    assert all(c.line_start == c.line_end == 1 for c in chunker.chunk_text("x" * 500, 100, 30))


def test_chunker_structure():
    found = chunker.chunk_text("# One\nalpha\n\n# Two\nbravo\n", 3072, 256)
    assert [c.text.splitlines()[0] for c in found][0] == "# One" and len(found) == 2 and "# Two" in found[1].text
    pages = chunker.chunk_text("A\fB", 3072, 0)
    assert [p.text for p in pages] == ["A", "B"]
    words = chunker.chunk_text("alpha " * 20 + "\n\n" + "bravo " * 20, 100, 30)
    assert len(words) > 2 and any("alpha" in c.text and "bravo" in c.text for c in words)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é#\n\f", max_size=400), st.integers(8, 60))
def test_chunks_without_overlap_keep_all_content(text, target):
    strip = lambda s: "".join(s.split())
    assert strip("".join(c.text for c in chunker.chunk_text(text, target, 0))) == strip(text)


def test_registered_chunks_have_no_cap(spark, tmp_path):
    numbered = "\n\n".join(f"paragraph {k} " + f"w{k} " * 700 for k in range(80))
    docs = [(5, "x" * 3072 * 40), (10, numbered), (15, "short")]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in docs], "doc_id long, text string, lang string, source string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in catalog.queries()["chunk_documents"](spark, str(tmp_path)).orderBy("chunk_index").collect():
        got.setdefault(int(r["file_path"].split("doc-")[1].split(".")[0]), []).append(r)
    # each piece after the first gives its carry and the carry with the piece
    assert [len(r["text"]) for r in got[5]] == [3072, *[256, 256 + 1 + 3072] * 39]
    assert len(got[10]) > 64 and len(got[15]) == 1
    for i, text in docs[1:]:
        assert {w for r in got[i] for w in r["text"].split()} == set(text.split())
        assert [r["chunk_index"] for r in got[i]] == list(range(len(got[i])))
    assert max(r["line_end"] for r in got[10]) == len(numbered.split("\n"))
    stats = {r["file_path"]: (r["n_chunks"], r["bytes"], r["last_line"]) for r in catalog.queries()["chunk_stats"](spark, str(tmp_path)).collect()}
    want = {rows[0]["file_path"]: (len(rows), sum(len(r["text"].encode()) for r in rows), max(r["line_end"] for r in rows)) for rows in got.values()}
    assert stats == want


@pytest.mark.parametrize("line,yes", [("# a", True), ("###### a", True), ("####### a", False), ("#a", False), ("  ## a", True), ("#", True), ("a # b", False)])
def test_heading(spark, line, yes):
    assert spark.createDataFrame([(line,)], "l string").select(T.is_heading(T.F.col("l"))).first()[0] is yes


def test_bm25_against_fts5(spark):
    docs = [(1, "the café rest and heed the rest"), (2, "rest heed"), (3, "nothing here"), (4, "heed the shard_id rest of it all"), (5, "other words only"), (6, "more of them")]
    df = spark.createDataFrame(docs, "id long, text string")
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(text, tokenize='unicode61')")
    db.executemany("insert into t(rowid, text) values (?, ?)", docs)
    for q, fts in (("rest heed", '"rest" AND "heed"'), ("shard_id rest", '"shard_id" AND "rest"'), ("cafe", '"cafe"')):
        want = {i: round(s, 9) for i, s in db.execute("select rowid, bm25(t) from t where t match ?", (fts,))}
        got = {r["id"]: round(r["score"], 9) for r in match.bm25(df, "id", "text", q).collect()}
        assert got == want, q
    assert match.bm25(df, "id", "text", "rest ---").count() == 0
    with pytest.raises(ValueError):
        match.bm25(df, "id", "text", "  ")


def test_rrf(spark):
    def leg(ids):
        return spark.createDataFrame([(x, i) for i, x in enumerate(ids, 1)], "id string, rank int")

    got = [r["id"] for r in fusion.rrf([leg("abc"), leg("bad")], 60, 3).collect()]
    assert got == ["a", "b", "c"]
    assert [r["id"] for r in fusion.rrf([leg("bad"), leg("abc")], 0, 3).collect()] == got


def test_line_search(spark):
    df = spark.createDataFrame([("f", "alpha line\r\nbeta alpha line\nnothing here\n")], "p string, t string")
    assert [(r["line"], r["score"], r["n_terms"]) for r in lines.line_search(df, "p", "t", "alpha 'beta'").collect()] == [(2, 4, 2), (1, 1, 1)]
    assert lines.line_search(df, "p", "t", "ALPHA", case_sensitive=True).count() == 0


def test_snippet_cuts_on_characters(spark):
    df = spark.createDataFrame([("é" * 200,), ("x" * 299 + "é",), ("ab",)], "t string")
    got = [r[0] for r in df.select(T.snippet(T.F.col("t"))).collect()]
    assert got == ["é" * 150 + "...", "x" * 299 + "...", "ab"]


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), body)
    return out.getvalue()


def test_extractors():
    r = extract.Registry()
    w = 'xmlns:w="urn:w"'
    doc = zipped(word__document_DOT_xml=f"<w:document {w}><w:body><w:p><w:r><w:t>first</w:t></w:r></w:p><w:p><w:t>second</w:t></w:p></w:body></w:document>")
    assert r.extract(".docx", doc)[:2] == ("ok", "first\nsecond")
    book = zipped(
        xl__workbook_DOT_xml='<workbook xmlns:r="urn:r"><sheets><sheet name="S1" r:id="x"/></sheets></workbook>',
        xl__sharedStrings_DOT_xml="<sst><si><t>hello</t></si></sst>",
        xl__worksheets__sheet1_DOT_xml='<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>',
    )
    assert r.extract(".xlsx", book)[1] == "S1\nhello\t7"
    page = b"<html><style>x</style><body><p>vis&amp;ible<script>no</script></p><div>two</div></body></html>"
    assert r.extract(".html", page)[1] == "vis&ible\ntwo"
    assert r.extract(".csv", b'a,"b,c"\nd\n')[1] == "a\tb,c\nd"
    assert r.extract(".rtf", rb"{\rtf1 one\par two \'e9}")[1] == "one\ntwo"
    assert r.extract(".eml", b"Subject: Hi\r\nFrom: a@b\r\n\r\nbody")[1] == "Hi\nFrom: a@b\n\nbody"
    assert r.extract(".pdf", b"%PDF-1.4\nstream\nBT (hello \\(x\\)) Tj ET\nendstream")[1] == "hello (x)"
    assert r.extract(".pdf", b"junk")[0] == "error" and r.extract(".png", b"x")[0] == "skip"
    assert r.extract(".txt", b"a\xc0\xc0b")[1:3] == ("a�b", ["invalid UTF-8 replaced"])
    assert r.extract(".html", b"<p></p>")[0] == "error"


def test_registered_extraction_is_whole(spark, tmp_path):
    text = "".join(f"word{k} é " for k in range(60_000))
    assert len(text.encode()) > 600_000
    spark.createDataFrame([(5, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.queries()["extract_text"](spark, str(tmp_path)).first()["hash"] == hashlib.sha256(text.encode()).hexdigest()
    spark.createDataFrame([(1, "u", f"<p>{text}</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert catalog.queries()["html_to_text"](spark, str(tmp_path)).first()["text"] == text.strip()
    cut = extract.extract_files(spark.createDataFrame([("a.txt", text)], "path string, content string"), "path", "content", 1000).first()
    assert len(cut["text"].encode()) <= 1000 and cut["warn"] == ["cut at 1000 bytes"]


def test_web_client(spark):
    calls, naps = [], []

    def transport(path, body):
        calls.append(path)
        return (429, b"") if len(calls) == 1 else (200, json.dumps({"code": 200, "data": {"webPages": {"value": [{"id": "", "name": "n", "url": "u", "snippet": "s", "summary": " "}]}}}).encode())

    client = web.WebClient(transport, naps.append)
    raw = client.search("q")
    assert client.search("q") == raw and len(calls) == 2 and len(naps) == 1 and 0.2 <= naps[0] <= 0.3
    row = web.decode(spark.createDataFrame([(1, raw.decode())], "k int, raw string"), "raw", "k").first()
    assert (row["id"], row["snippet"], row["score"]) == ("u", "s", 1.0)
    with pytest.raises(RuntimeError):
        web.WebClient(lambda *_: (429, b"slow down"), naps.append).search("other")
    with pytest.raises(ValueError):
        client.search("q", freshness="never")


def test_cache_limits():
    now = [0.0]
    c = web.Cache(10, 2, lambda: now[0])
    c.put("a", b"1"), c.put("b", b"2"), c.put("c", b"3")
    assert c.get("a") is None and c.get("c") == b"3"
    now[0] = 11
    assert c.get("c") is None


def test_settings(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d in (a, b):
        d.mkdir()
        (d / "same.md").write_text("x")
    (a / "one.md").write_text("x")
    s = Settings([str(a), str(b)], str(tmp_path / "i"))
    assert s.resolve("one.md") == str(a / "one.md")
    for bad, kind in (("same.md", ValueError), ("none.md", FileNotFoundError), ("../x", PermissionError), (".", ValueError), ("/etc/passwd", PermissionError)):
        with pytest.raises(kind):
            s.resolve(bad)
    assert Settings([str(a), str(b)], "i", path_base=str(b)).resolve("same.md") == str(b / "same.md")
    with pytest.raises(ValueError):
        Settings([str(a)], "i", embed_model="none")
    assert parse_duration("1m30s") == 90 and [local_limit(n) for n in (0, 7, 99)] == [10, 7, 50]


def test_postings_carry_no_token_array_beside_a_token(spark):
    """A text's tokens beside each of its tokens would be its length squared."""
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "doc_id long, text string")
    found = match.index_postings(df, "doc_id", "text")
    assert sorted(found.select("term", "id", "positions", "dl").collect()) == [("a", 1, [0, 2], 3), ("b", 1, [1], 3), ("b", 3, [0], 1)]
    plan = found._jdf.queryExecution().optimizedPlan()
    exploded = [n for n in (plan.apply(i) for i in range(plan.treeString().count("\n"))) if n is not None and n.nodeName() == "Generate"]
    assert exploded and all(a.dataType().typeName() == "long" for n in exploded for a in (n.requiredChildOutput().apply(i) for i in range(n.requiredChildOutput().size())))
