"""Archives, files and HTML tables."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from reqspark.functions.html_tables import html_tables
from reqspark.functions.responses import confidence, logprobs_of
from reqspark.operators import images, raft, reports
from reqspark.sources import archives, files, sinks

XML = """<?xml version="1.0"?><REQ-IF xmlns="http://www.omg.org/spec/ReqIF/20110401/reqif.xsd" xmlns:h="http://www.w3.org/1999/xhtml">
<SPEC-OBJECT-TYPE IDENTIFIER="t" LONG-NAME="System Requirement"><SPEC-ATTRIBUTES><ATTRIBUTE-DEFINITION-STRING IDENTIFIER="f" LONG-NAME="ReqIF.ForeignID"/>
<ATTRIBUTE-DEFINITION-XHTML IDENTIFIER="x" LONG-NAME="ReqIF.Text"/></SPEC-ATTRIBUTES></SPEC-OBJECT-TYPE>
<SPEC-OBJECT IDENTIFIER="o1"><TYPE><SPEC-OBJECT-TYPE-REF>t</SPEC-OBJECT-TYPE-REF></TYPE><VALUES>
<ATTRIBUTE-VALUE-STRING THE-VALUE="REQ_1"><DEFINITION><ATTRIBUTE-DEFINITION-STRING-REF>f</ATTRIBUTE-DEFINITION-STRING-REF></DEFINITION></ATTRIBUTE-VALUE-STRING>
<ATTRIBUTE-VALUE-XHTML><DEFINITION><ATTRIBUTE-DEFINITION-XHTML-REF>x</ATTRIBUTE-DEFINITION-XHTML-REF></DEFINITION><THE-VALUE><h:p>shall work</h:p></THE-VALUE></ATTRIBUTE-VALUE-XHTML></VALUES></SPEC-OBJECT>
<SPEC-OBJECT IDENTIFIER="o2"/>
<SPEC-RELATION IDENTIFIER="r"><SOURCE><SPEC-OBJECT-REF>o1</SPEC-OBJECT-REF></SOURCE><TARGET><SPEC-OBJECT-REF>o2</SPEC-OBJECT-REF></TARGET></SPEC-RELATION>
<SPEC-RELATION IDENTIFIER="half"><SOURCE><SPEC-OBJECT-REF>o1</SPEC-OBJECT-REF></SOURCE></SPEC-RELATION></REQ-IF>"""


def archive(members, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    good = {"a.reqif": XML, "b.reqif": "later", "1/p.PNG": b"\x89PNG"}
    whole = archive(good)
    at = whole.index(XML[:20].encode())
    damaged = bytearray(archive({"a.reqif": XML}, zipfile.ZIP_DEFLATED))
    damaged[30 + len("a.reqif")] = 7  # a block of a type that there isn't
    locked = bytearray(archive({"a.reqif": XML}))
    locked[6] |= 1
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    spoilt = bytearray(archive({"a.reqif": XML, "1/q.png": b"0123456789"}))
    spoilt[spoilt.index(b"0123456789")] = 65  # the checksum of an image
    contents = {
        "good": whole, "empty": b"no zip", "nothing": archive({"x.txt": "x"}), "sub/broken": archive({"a.reqif": "<a>"}), "cut": whole[: at + 50], "damaged": bytes(damaged), "locked": bytes(locked),
        "image": bytes(spoilt), "late": archive({"a.reqif": XML.replace("</REQ-IF>", "")}),
    }
    for name, content in contents.items():
        (tmp_path / f"{name}.reqifz").write_bytes(content)
    (tmp_path / "other.zip").write_bytes(b"x")
    parsed = archives.parse_archives(archives.read_archives(spark, str(tmp_path))).withColumn("source_file", F.regexp_extract("source_file", r"(\w+)\.reqifz", 1)).cache()
    rows = [(r.seq, r.id, r.type, r.text) for r in archives.artifacts_of(parsed).where("source_file = 'good'").orderBy("seq").collect()]
    assert rows == [(0, "REQ_1", "System Requirement", "<p>shall work</p>"), (1, "o2", "", "")]
    assert [(r.source_id, r.target_id) for r in archives.relations_of(parsed).where("source_file = 'good'").collect()] == [("REQ_1", "o2")]
    assert [r.name for r in archives.images_of(parsed).collect()] == ["1/p.PNG"]
    lookups = {tuple(r)[1:] for r in archives.lookups_of(parsed).where("source_file = 'good'").collect()}
    assert lookups == {("object_type", "t", "System Requirement"), ("attribute", "f", "ReqIF.ForeignID"), ("attribute", "x", "ReqIF.Text"), ("foreign_id", "t", "f")}
    report = {r.source_file: (r.objects, r.errors) for r in archives.scan_report(parsed).collect()}
    assert report == {
        "good": (2, []), "empty": (0, ["BadZipFile"]), "nothing": (0, ["no ReqIF member"]), "broken": (0, ["ParseError"]), "cut": (0, ["BadZipFile"]), "damaged": (0, ["error"]),
        "locked": (0, ["RuntimeError"]), "image": (2, ["BadZipFile"]), "late": (0, ["ParseError"]),
    }
    assert archives.scan_report(archives.parse_archives(spark.createDataFrame([("x", None)], "path string, content binary"))).first().errors == ["BadZipFile"]


def test_large_documents_are_read_in_pieces(monkeypatch):
    """Types after the objects and relations before them give the same rows, and no more than one object is in the tree."""
    objects = "".join(f'<SPEC-OBJECT IDENTIFIER="o{k}"><TYPE><SPEC-OBJECT-TYPE-REF>t</SPEC-OBJECT-TYPE-REF></TYPE></SPEC-OBJECT>' for k in range(3000))
    types = '<SPEC-TYPES><SPEC-OBJECT-TYPE IDENTIFIER="t" LONG-NAME="Heading"/></SPEC-TYPES>'
    relation = '<SPEC-RELATION IDENTIFIER="r"><SOURCE><SPEC-OBJECT-REF>o1</SPEC-OBJECT-REF></SOURCE><TARGET><SPEC-OBJECT-REF>o2</SPEC-OBJECT-REF></TARGET></SPEC-RELATION>'
    rows = [sorted((sorted(r.items(), key=str) for r in archives.parse_xml(lambda x=x: io.BytesIO(f"<R>{x}</R>".encode()))), key=str) for x in (types + objects + relation, relation + objects + types)]
    assert rows[0] == rows[1] and len(rows[0]) == 3002
    most = 0
    for _, x in archives._pulled(io.BytesIO(f"<R>{types}<A>{objects}</A></R>".encode())):
        most = max(most, sum(1 for _ in x.iter()))
    assert most < 10


def test_named_files(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("b", "2\n"), ("a", "1\n"), ("b", "3\n"), ("d/e", "4\n")], "name string, content string").repartition("name").sortWithinPartitions("name", "content")
    sinks.write_named(rows, out, head="h\n")
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a": "h\n1\n", "b": "h\n2\n3\n", "d/e": "h\n4\n"}
    images = spark.createDataFrame([("x:1", 1, "p/a.png", b"old"), ("x:1", 2, "q/a.png", b"new"), ("x_1", 1, "a.png", b"else")], "source_file string, seq long, name string, content binary").repartition(3)
    files.write_images(images, f"file://{tmp_path}/images")
    found = {str(p.relative_to(tmp_path / "images")): p.read_bytes() for p in (tmp_path / "images").rglob("*") if p.is_file()}
    assert sorted(found.values()) == [b"else", b"new"] and "x_1/a.png" in found and len(found) == 2


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    fails = F.when(F.col("id") == 70, F.raise_error(F.lit("no"))).otherwise(F.lit("text"))
    rows = spark.range(0, 100, 1, 4).select(F.concat(F.lit("f"), "id").alias("name"), fails.cast("string").alias("content"))
    with pytest.raises(Exception, match="no"):
        sinks.write_named(rows, f"file://{folder}")
    assert not folder.exists() or not list(folder.rglob("*"))
    sinks.write_named(rows.where("id < 50"), f"file://{folder}")
    assert len([p for p in folder.rglob("*") if p.is_file()]) == 50 and not [p for p in folder.iterdir() if p.is_dir()]


def test_case_tables(spark, tmp_path):
    rows = [("s/1", 'a "q"', "x\ny", None), ("s/1", "b", ",", "z"), ("s_1", "c", "", "w"), (None, "d", "e", "f")]
    table = spark.createDataFrame(rows, "source_file string, `Issue ID` string, text string, `Data, old` string")
    files.write_cases(table, f"file://{tmp_path}/t", "source_file", order=("Issue ID",))
    got = files.read_cases_csv(spark, str(tmp_path / "t")).na.fill("").collect()
    assert got[0].asDict().keys() == {"Issue ID", "text", "Data, old"}
    assert sorted(tuple(r) for r in got) == sorted((a, b, c or "") for _, a, b, c in rows)
    assert len(list((tmp_path / "t").iterdir())) == 3 and (tmp_path / "t" / "unknown.csv").exists()


def test_case_tables_take_little_disk(spark, tmp_path):
    fixed = [F.lit("AI Generated TCs").alias(f"c{k}") for k in range(16)]
    table = spark.range(20_000).select(F.concat(F.lit("F"), F.col("id") % 3).alias("source_file"), F.concat(F.lit('a "q",\n'), "id").alias("Issue ID"), *fixed)
    files.write_cases(table, f"file://{tmp_path}/t", "source_file", order=("Issue ID",), gzip=True)
    got = files.read_cases_csv(spark, str(tmp_path / "t"))
    assert sorted(r[0] for r in got.select("Issue ID").collect()) == sorted(f'a "q",\n{k}' for k in range(20_000)) and got.where(F.col("c15") != "AI Generated TCs").count() == 0
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["F0.csv.gz", "F1.csv.gz", "F2.csv.gz"]
    assert sum(p.stat().st_size for p in (tmp_path / "t").iterdir()) < 20_000 * 20
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()
    before = held()
    files.write_cases(table, f"file://{tmp_path}/u", "source_file", gzip=True)
    assert held() <= before  # no shuffle files of this write stay


def test_chat_issues_of_files_read_in_pieces(spark, tmp_path):
    three = json.dumps({"messages": [{"role": r, "content": "x"} for r in "sua"]})
    odd = {3: ('{"metadata": {}}', "Missing 'messages' field"), 500: ('{"messages": []}', "Expected 3 messages, got 0"), 777: ('{"messages": [1', "not JSON"), 999: ('{"messages": 5}', "'messages' is no list"), 1000: ('{"messages": [1,2,3,4]}', "Expected 3 messages, got 4")}
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("".join(odd.get(k, (three,))[0] + "\n" for k in range(1200)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = raft.chat_issues(spark.read.text(str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {(name, k, f"Example {k}: {text}") for name in "ab" for k, (_, text) in odd.items()}
    assert {(r.file.rpartition("/")[2][0], r.number, r.issue) for r in got} == want and len(got) == len(want)


def test_log_probabilities(spark):
    shapes = ["[-0.5, -1.5]", '[{"token": "a", "logprob": -0.5}, {"token": "b"}, {"logprob": -1.5}]', '{"tokens": ["a"], "token_logprobs": [-0.5, -1.5]}', "[-1]", "[]", "{}", "no", None, '[-1, "x", null]']
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(shapes)], "k int, t string").select("k", confidence(logprobs_of(F.col("t"))).alias("c")).orderBy("k").collect()
    assert [None if r.c is None else round(r.c, 6) for r in rows] == [0.367879] * 4 + [None] * 4 + [0.367879]


def test_image_sizes(spark):
    w, h = 300, 70
    app = b"\xff\xe1" + struct.pack(">H", 70) + b"\xff\xc0" * 34  # a frame's marker inside another segment
    jpeg = b"\xff\xd8\xff\xe0\x00\x04JF" + app + b"\xff\xff\xc4\x00\x03\x00\xff\xc0\x00\x0b\x08" + struct.pack(">HH", h, w) + b"\x01\x11\x00"
    tiff = lambda e: ((b"II*\0" if e == "<" else b"MM\0*") + struct.pack(e + "I", 10) + b"xx" + struct.pack(e + "H", 3) + struct.pack(e + "HHIHH", 254, 3, 1, 0, 0)
                      + struct.pack(e + "HHIHH", 256, 3, 1, w, 0) + struct.pack(e + "HHII", 257, 4, 1, h))
    riff = b"RIFF\0\0\0\0WEBP"
    lossless = riff + b"VP8L\0\0\0\0\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14)
    lossy = riff + b"VP8 " + b"\0" * 4 + b"abc\x9d\x01\x2a" + struct.pack("<HH", w | 0x4000, h)
    extended = riff + b"VP8X" + b"\0" * 8 + struct.pack("<I", w - 1)[:3] + struct.pack("<I", h - 1)[:3]
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", w, h)
    good = [jpeg, tiff("<"), tiff(">"), lossless, lossy, extended, png, b"GIF89a" + struct.pack("<HH", w, h), b"BM" + b"\0" * 16 + struct.pack("<II", w, h)]
    bad = [x[:-9] for x in good] + [b"", b"text", None, b"\xff\xd8\xff", b"\xff\xd8\xff\xe0\x00\x00" + b"\xff" * 50, b"<svg/>"]
    rows = images.image_checks(spark.createDataFrame(list(enumerate(good + bad)), "k int, content binary")).orderBy("k").collect()
    assert [(r.width, r.height, r.error) for r in rows] == [(w, h, None)] * len(good) + [(None, None, "unreadable")] * len(bad)


def test_open_logs(spark, tmp_path):
    lines = ['{"session_id": "s", "timestamp": "2024-01-01T00:00:02", "final_metrics": {"files_processed": 3, "performance_stats": {"peak_cpu_percent": 9.5}}}', '{"session_id": "s", "timestamp": "2024-01-01T00:00:01", "extra": {"a": [1], "b": {}}, "final_metrics": {"files_processed": 1}}', '{"session_id": "s", "extra": {"c": 1}}', '{"session_id": "t", "level": "INFO"}']
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    got = {r.session_id: (r.records, r["keys"], r.files, r.tests, r.peak_cpu) for r in reports.final_metrics(files.read_open_logs(spark, str(tmp_path))).collect()}
    assert got == {"s": (3, ["a", "b", "c"], 3, None, 9.5), "t": (1, [], None, None, None)}


def test_html_tables(spark):
    html = [
        "<table><tr><th>a</th><th colspan=2>Details</th></tr><tr><td rowspan='2'>x</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr><tr><td></td></tr></table>",
        None, "", "<html:table><html:tr><html:td>h</html:td><html:td/></html:tr><tr><td>v<br>w</td></tr>",
    ]
    rows = spark.createDataFrame([(h,) for h in html], "h string").select(html_tables(F.col("h")).alias("t")).collect()
    assert [[x.cells for x in r.t] for r in rows] == [
        [{"a": "x", "Details": "1", "Details_2": "2"}, {"a": "x", "Details": "3", "Details_2": "4"}], [], [], [{"h": "v w", "Column_2": ""}],
    ]


def test_examples_and_csv(spark, tmp_path):
    (tmp_path / "raft_1.json").write_text('{\n"id": 1}')
    (tmp_path / "raft_2.json").write_text("{broken")
    assert [r.id for r in files.read_examples(spark, str(tmp_path), "id long", "raft_*.json").collect()] == [1]
    (tmp_path / "c.csv").write_text('﻿a,b\n1,"two\nlines ""q"""\n', encoding="utf-8")
    table = files.read_cases_csv(spark, str(tmp_path / "c.csv"))
    assert table.columns == ["a", "b"] and tuple(table.first()) == ("1", 'two\nlines "q"')


def test_images(spark):
    text = '<p><html:img src="data:image/PNG;base64,aGk=" /><img src="a/b.png"><object type="x" data="c.svg">'
    rows = spark.createDataFrame([("f", "r", text)], "source_file string, id string, text string")
    found = images.embedded_images(rows, "id").first()
    assert (found.format, bytes(found.content)) == ("png", b"hi")
    keys = [("f", found.hash, "i1"), ("f", "b.png", "i2"), ("g", "c.svg", "i3")]
    linked = images.link_images(rows, spark.createDataFrame(keys, "source_file string, ref_key string, image_id string"))
    assert linked.first().images == ["i1", "i2"]


def test_no_chat_rows_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no chat rows"):
        files.write_chat(spark.createDataFrame([], files.CHAT), str(tmp_path / "chat"))
    assert not (tmp_path / "chat").exists()
    rows = [{"example_id": k, "messages": [{"role": "user", "content": "x\ny"}]} for k in range(3)]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "lines.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    for name, lines in (("array.json", False), ("lines.jsonl", True)):
        got = files.read_chat(spark, str(tmp_path / name), lines=lines).orderBy("example_id").collect()
        assert [(r.example_id, r.messages[0].content) for r in got] == [(k, "x\ny") for k in range(3)]
