import io
import json
import sqlite3
import zipfile

import pytest

from loomspark.functions import names
from loomspark.functions import germanic
from loomspark.functions.stemmer import english
from loomspark.operators import chunking, profile
from loomspark.sources import documents, readers, sinks
from loomspark.sources.infer import infer_types, typed


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(("name", "body"), [("a.csv", "site,stage,at\nx,1.5,2024-01-02\ny,,2024-01-03\n"), ("a.tsv", "site\tstage\tat\nx\t1.5\t2024-01-02\ny\t\t2024-01-03\n"), ("b.csv", "site;stage;at\nx;1.5;2024-01-02\ny;;2024-01-03\n")])
def test_delimited(spark, tmp_path, name, body):
    (tmp_path / name).write_text(body)
    df = readers.read_table(spark, str(tmp_path / name))
    assert [t for _, t in df.dtypes] == ["string", "double", "date"]
    assert [r[:2] for r in rows(df)] == [("x", 1.5), ("y", None)]


def test_json_lines_arrays_and_sniffing(spark, tmp_path):
    data = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    (tmp_path / "a.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, data)))
    (tmp_path / "c").write_text(json.dumps(data))
    for f in ("a.json", "b.jsonl", "c"):
        assert rows(readers.read_table(spark, str(tmp_path / f)).orderBy("a")) == [(1, "x"), (2, "y")]
    spark.range(2).write.parquet(str(tmp_path / "d.parquet"))
    assert readers.read_table(spark, str(tmp_path / "d.parquet")).count() == 2
    assert readers.sniff(b"PAR1...") == "parquet" and readers.sniff(b" [1]") == "json" and readers.sniff(b"a,b") == "csv"


def test_yaml_records_or_text(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("- {site: x, cots: 3}\n- {site: y, generator: true}\n")
    assert sorted(rows(readers.read_yaml(spark, str(tmp_path / "a.yaml")))) == [("x", 3, None), ("y", None, True)]
    assert readers.yaml_records("a: 1\nb: 2") is None and readers.yaml_records("top:\n - {a: 1}") == [{"a": 1}]


def test_long_yaml_is_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "yaml_records", lambda text: [{"size": len(text), "end": text[-9:].strip()}])
    (tmp_path / "a.yaml").write_text("#" * (64 << 20) + "\n- {a: 2}\n")
    assert rows(readers.read_yaml(spark, str(tmp_path / "a.yaml"))) == [((64 << 20) + 10, "- {a: 2}")]


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="inlineStr"><is><t>day</t></is></c><c r="D1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2</v></c><c r="C2" s="1"><v>45293</v></c><c r="D2" t="b"><v>1</v></c></row><row><c r="B3"><v>2.5</v></c></row></sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "my book.xlsx")
    (name, df), = readers.read_workbook(spark, str(tmp_path / "my book.xlsx")).items()
    assert name == "my_book" and df.dtypes == [("name", "string"), ("n", "double"), ("day", "date"), ("n_2", "boolean")]
    assert [(r[0], r[1], str(r[2]), r[3]) for r in df.collect()] == [("x", 2.0, "2024-01-02", True), (None, 2.5, "None", None)]


def test_sqlite_address_and_pointer(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(1, "x"), (2, None)])
    con.commit()
    con.close()
    assert rows(readers.read_sqlite(spark, str(tmp_path / "a.db"), "SELECT * FROM t ORDER BY a", limit=1)) == [(1, "x")]
    with pytest.raises(sqlite3.OperationalError):
        readers.read_sqlite(spark, str(tmp_path / "a.db"), "DELETE FROM t")
    (tmp_path / "a.json").write_text('{"data": {"a/b": [{"x": 1}, {"x": 2}]}}')
    assert rows(readers.read_address(spark, (tmp_path / "a.json").as_uri(), pointer="/data/a~1b", limit=1)) == [(1,)]


def test_folder_and_registry(spark, tmp_path):
    for n, body in (("a", "1"), ("b", "1"), ("c", "2")):
        (tmp_path / f"{n}.txt").write_text(body)
    new, gone = readers.folder(spark, str(tmp_path))
    assert sorted(r.path[-5:] for r in new.collect()) == ["a.txt", "c.txt"] and gone.count() == 0
    registry = spark.createDataFrame([(r.path, r.sha256) for r in new.collect()] + [("file:/gone", "0")], "path string, sha256 string")
    (tmp_path / "c.txt").write_text("3")
    new, gone = readers.folder(spark, str(tmp_path), registry)
    assert [r.path[-5:] for r in new.collect()] == ["c.txt"] and [r.path for r in gone.collect()] == ["file:/gone"]


def test_type_inference(spark):
    df = spark.createDataFrame([("1", "1", "2024-01-02", "true", "x", " "), ("2", "2.5", "2024-01-02T03:04:05", "FALSE", "3", None)], "a string, b string, c string, d string, e string, f string")
    assert list(infer_types(df).values()) == ["BIGINT", "DOUBLE", "TIMESTAMP", "BOOLEAN", "VARCHAR", "VARCHAR"]
    assert [t for _, t in typed(df).dtypes] == ["bigint", "double", "timestamp_ntz", "boolean", "string", "string"]


HTML = b"<html><head><title>T</title><meta name=author content=Me><meta name=keywords content='a, b'></head><body><nav>skip</nav><p>Intro <b>one</b></p><h1>Head</h1><div>Body<br>next</div><table><tr><th>a<th>b</tr><tr><td>1<td>2</tr></table><table><tr><td>only</td></tr></table><script>x</script></body></html>"


def test_html():
    d = documents.parse("x.html", HTML)
    assert (d.title, d.author, d.tags) == ("T", "Me", ["a", "b"])
    assert [(s.heading, s.text, s.kind) for s in d.sections] == [("", "Intro one", "text"), ("Head", "Body\nnext", "text"), ("Head", "| a | b |\n| --- | --- |\n| 1 | 2 |", "table"), ("Head", "only", "text")]
    with pytest.raises(documents.Unsupported):
        documents.parse("x.html", b"<html><body><script>1</script></body></html>")


def test_markdown_mail_captions_rtf_office():
    d = documents.parse("a.md", b"---\ntitle: T\ntags: [x, y]\n---\nintro\n# H\ntext `c`\n```\n# not\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    assert d.title == "T" and d.tags == ["x", "y"] and [(s.heading, s.kind) for s in d.sections] == [("", "text"), ("H", "text"), ("H", "table")]
    assert "# not" in d.sections[1].text
    m = documents.parse("a.eml", b"From: a@x\nSubject: Hi\nContent-Type: text/plain\n\nBody\n")
    assert m.title == "Hi" and m.sections[0].text.endswith("Body")
    box = documents.parse("a.mbox", b"From x Mon Jan  1 00:00:00 2024\nSubject: A\n\none\n\nFrom x Mon Jan  1 00:00:00 2024\nSubject: B\n\ntwo\n")
    assert [s.heading for s in box.sections] == ["A", "B"]
    c = documents.parse("a.vtt", b"WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<v A>hi\n\n00:00:20.000 --> 00:00:21.000\nthere\n")
    assert [(s.text, s.locator) for s in c.sections] == [("hi", "0:01"), ("there", "0:20")]
    assert documents.parse("a.rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}Stra\'dfe\par " + b"\\" + b"u8364?x}").sections[0].text == "Straße\n€x"
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>')
    assert [(s.heading, s.text) for s in documents.parse("a.docx", out.getvalue()).sections] == [("H", "text")]
    with pytest.raises(documents.Unsupported):
        documents.parse("a.pdf", b"%PDF")


def test_sections_keep_faults_as_rows(spark):
    files = spark.createDataFrame([(1, b"plain", "a.txt"), (2, b"%PDF", "a.pdf"), (3, None, "a.html"), (4, b"x", None)], "k int, content binary, name string")
    got = {r.k: (r.text, r.error is None) for r in documents.sections(files, "k", "content", "name").collect()}
    assert got[1] == ("plain", True) and not got[2][1] and not got[3][1] and not got[4][1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), bytearray(b"ab"), [1, None], None)], "a int, b double, c binary, d array<int>, e string")
    out = io.StringIO()
    assert sinks.to_csv(df, out) == 1 and out.getvalue() == 'a,b,c,d,e\n1,,YWI=,"[1, null]",\n'
    out = io.StringIO()
    sinks.to_ndjson(df, out)
    assert json.loads(out.getvalue()) == {"a": 1, "b": None, "c": "YWI=", "d": [1, None], "e": None}
    out = io.StringIO()
    sinks.to_json_array(df.limit(0), out)
    assert json.loads(out.getvalue()) == []
    assert sinks.to_markdown(df).splitlines()[-1] == "| 1 |  | YWI= | [1, null] | NULL |"
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_names():
    assert names.table_name("/x/my file.v2.csv") == "my_file_v2" and names.header_names(["a", "", "A", None]) == ["a", "column2", "A_2", "column4"]
    assert names.snake_id("Policy No. 7!") == "policy_no_7" and names.snake_id("7x") == "t_7x" and names.snake_id("!!") == "unnamed"
    assert [names.singular(x) for x in ("policies", "class", "bus", "claims")] == ["policy", "class", "bus", "claim"]
    assert names.relation_name("policy_id") == "has_policy" and names.normalized_label("  A  b ") == "a b"
    with pytest.raises(ValueError, match="begin"):
        names.check_reserved("graph_x")


def test_stems():
    for word, stem in (("running", "run"), ("policies", "polici"), ("nationally", "nation"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("skies", "sky"), ("relational", "relat"), ("consistency", "consist"), ("by", "by")):
        assert english(word) == stem


@pytest.mark.parametrize(
    ("stemmer", "pairs"),
    [
        (germanic.german, "aufeinander aufeinand kategorischen kategor aufgegriffen aufgegriff häuser haus straße strass auferlegt auferlegt kenntnisse kenntnis freundlichkeit freundlich zeitungen zeitung bauen bau es es"),
        (germanic.swedish, "jaktkarlarne jaktkarl flickorna flick klockan klockan friskt frisk hjälplöst hjälplös och och"),
        (germanic.danish, "indtager indtag undersøgelse undersøg husene hus løsningerne løsning bestemmelse bestem og og"),
        (germanic.norwegian, "havnedistriktene havnedistrikt bilene bil nyheter nyhet regjeringens regjering og og"),
    ],
)
def test_germanic_stems(stemmer, pairs):
    words = pairs.split()
    assert [stemmer(w) for w in words[::2]] == words[1::2]
    assert all(isinstance(stemmer(w), str) for w in ("", "s", "st", "es", "1", "igst", "東京", "ss", "keit"))


def test_chunking_edges():
    count = lambda t: len(t.split())
    pieces = list(chunking.code_pieces("a b\nc d\n\ne f g h i j\nk\n", count, 4))
    assert [(p.locator, p.content) for p in pieces] == [("line 1", "a b\nc d\n\n"), ("line 4", "e f g h i j\n"), ("line 5", "k\n")]
    assert [p.content for p in chunking.table_pieces("h", "-", ["r1", "r2", "r3"], count, 4)] == ["h\n-\nr1\nr2", "h\n-\nr3"]
    pages = list(chunking.page_pieces([(1, "a b c"), (2, "d e")], str.split, 3, 1))
    assert [(p.page, p.locator, p.content) for p in pages] == [(1, "", "a b c"), (1, "through page 2", "c\n\nd e"), (2, "", "e")]
    assert chunking.clock(59) == "0:59" and chunking.clock(3661) == "1:01:01"


def test_retypes_and_values(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y")], "a string, b string")
    assert rows(profile.retype(df, profile.parse_retypes("A=BIGINT"))) == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="not bigint"):
        profile.retype(df, [("b", "BIGINT")]).collect()
    with pytest.raises(ValueError, match="no column"):
        profile.retype(df, [("z", "BIGINT")])
    assert profile.value_form("AB-12 cd") == "AA-99 aa" and profile.stale({"a": 1, "b": 2}, {"a": 1, "c": 3}) == (["c"], ["b"])
