from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspan.operators import redact as R
from veilspan.sources import office, records, sinks
from veilspan.streaming import redaction


def put(path, *rows):
    path.write_text("\n".join(json.dumps(r) if not isinstance(r, str) else r for r in rows))
    return str(path)


def test_records_and_gold_spans(spark, tmp_path):
    a = {"text": "Ann x", "spans": {"private_person: Ann": [[0, 3]]}, "label": [{"category": "no", "start": 0, "end": 1}], "info": {"id": "1"}}
    b = {"text": "Bob", "label": [{"category": "private_person", "start": 0, "end": 3}]}
    df = records.read_records(spark, put(tmp_path / "a.jsonl", a, "", b)).withColumn("example_id", F.col("text"))
    got = {(r.example_id, r.label, r.span_start, r.span_end) for r in records.validated(records.gold_spans(df), df, ["private_person"]).collect()}
    assert got == {("Ann x", "private_person", 0, 3), ("Bob", "private_person", 0, 3)}


@pytest.mark.parametrize("bad", ["{nope", json.dumps({"text": "a", "label": [{"category": "x", "start": True, "end": 1}]}), json.dumps({"text": "a", "spans": {"x": [[0.5, 1]]}})])
def test_bad_records_fail(spark, tmp_path, bad):
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        records.read_records(spark, put(tmp_path / "a.jsonl", bad)).collect()


def test_bad_spans_fail(spark):
    texts = spark.createDataFrame([("e", "abc")], "example_id string, text string")
    for span in ((0, 9), (2, 1), (-1, 2)):
        spans = spark.createDataFrame([("e", "x", *span)], "example_id string, label string, span_start long, span_end long")
        with pytest.raises(Exception, match="out of bounds"):
            records.validated(spans, texts).collect()
    spans = spark.createDataFrame([("e", "x", 0, 1)], "example_id string, label string, span_start long, span_end long")
    with pytest.raises(Exception, match="unknown label"):
        records.validated(spans, texts, ["y"]).collect()


def test_messages(spark):
    text = "lost\n\nuser: hi Ann\n\nassistant: ok\n\nuser: "
    df = spark.createDataFrame([("t", text, {"p: Ann": [[15, 18]], "q: lost": [[0, 4]]}, {"id": "1"})], "k string, text string, spans map<string,array<array<bigint>>>, info map<string,string>")
    rows = sorted(records.explode_messages(df, "k").collect(), key=lambda r: r.message_index)
    assert [r.text for r in rows] == ["hi Ann", "ok"]
    assert rows[0].spans == {"p: Ann": [[3, 6]]} and rows[1].spans == {} and rows[1].info == {"id": "1", "message_index": "1"}
    plain = spark.createDataFrame([("t", "no marker")], "k string, text string")
    assert records.explode_messages(plain, "k").first().text == "no marker"


def test_example_ids(spark):
    df = spark.createDataFrame([('a "q"\n\té', 0, {"x: a": [[0, 1]]}, None)], records.RECORD.split(", spans")[0] + ", index long, spans map<string,array<array<bigint>>>, label array<struct<category:string,start:bigint,end:bigint>>")
    row = records.stable_ids(df).first()
    want = json.dumps({"text": row.text, "index": 0, "spans": {"x: a": [[0, 1]]}}, sort_keys=True, ensure_ascii=False)
    assert row.example_id == hashlib.sha256(want.encode()).hexdigest()


def test_numbering_and_files(spark, tmp_path):
    df = spark.createDataFrame([(c,) for c in "dcba"], "text string")
    assert {r["text"]: r["index"] for r in records.numbered(df, ["text"]).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    (tmp_path / "x.txt").write_bytes(b"ok \xff\n")
    (tmp_path / "y.exe").write_bytes(b"no")
    assert [r.text for r in records.read_uploads(spark, str(tmp_path)).collect()] == ["ok �\n"]
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "l.txt").write_text("one\r\n \n two\n")
    assert sorted(r.text for r in records.read_lines(spark, str(tmp_path / "z")).collect()) == [" two", "one"]
    assert records.read_texts(spark, str(tmp_path / "z")).first().text == "one\r\n \n two\n"


def test_predictions(spark, tmp_path):
    df = spark.createDataFrame([("e", "Ann Ann", [("p", 0, 3), ("p", 4, 7)])], "example_id string, text string, s array<struct<label:string,span_start:bigint,span_end:bigint>>")
    sinks.write_predictions(df, str(tmp_path / "out"), "s")
    row = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*.json")))
    assert row == {"example_id": "e", "text": "Ann Ann", "predicted_spans": {"p: Ann": [[0, 3], [4, 7]]}}
    metrics = spark.createDataFrame([("a", 1.0), ("by_class.x.f1", 0.5)], "metric string, value double")
    sinks.write_metrics(metrics, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text())["summary"] == {"a": 1.0}


@pytest.mark.parametrize(
    "runs, want",
    [(["Hello John"], "Hello [NAME]"), (["Hel", "lo Jo", "hn!"], "Hello [NAME]!"), (["Hello"], "Hello"), (["John went home"], "[NAME] went home"), (["John", " John"], "[NAME] John")],
)
def test_replacement_over_runs(runs, want):
    out = office.replace_in_runs(runs, "John", "[NAME]")
    assert "".join(out) == want and len(out) == len(runs)


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join("<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in p) + "</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("other.xml", "<x/>")
    return out.getvalue()


def test_docx(spark, tmp_path):
    data = docx(["Hel", "lo Jo", "hn!"], ["John"])
    assert office.docx_paragraphs(office.redact_docx(data, [("John", "[N]")])) == [["Hel", "lo [N]", "!"], ["[N]"]]
    (tmp_path / "a.docx").write_bytes(data)
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in office.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "Hello John!\nJohn", "b.docx": None}


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("mail b@x.io\n\n+1 (555) 123-4567 x\n")
    query = redaction.redacted(redaction.read_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("redacted").start()
    query.processAllAvailable()
    query.stop()
    stream = {r.redacted_text for r in spark.table("redacted").collect()}
    batch = {r.redacted_text for r in R.redact(records.read_lines(spark, str(tmp_path / "in"))).collect()}
    assert stream == batch == {"mail <PRIVATE_EMAIL>", "<PRIVATE_PHONE> x"}


def test_unique_ids_refuse_repeats_and_nulls(spark):
    rows = lambda ids: spark.createDataFrame([(x,) for x in ids], "example_id string")
    assert sorted(r[0] for r in records.unique_ids(rows(["a", "b"])).collect()) == ["a", "b"]
    assert records.unique_ids(rows([])).collect() == []
    for bad in (["a", "a"], ["a", None]):
        with pytest.raises(Exception, match="missing or repeats"):
            records.unique_ids(rows(bad)).collect()


def test_records_are_numbered_as_they_stand(spark, tmp_path):
    for name, texts in (("a.jsonl", ["z", "same", "b"]), ("b.jsonl", ["same", "a"])):
        (tmp_path / name).write_text("".join(json.dumps({"text": t}) + "\n" for t in texts))
    df = records.numbered(records.read_records(spark, str(tmp_path / "*.jsonl"), placed=True), records.PLACE)
    assert [r.text for r in df.orderBy("index").collect()] == ["z", "same", "b", "same", "a"]
