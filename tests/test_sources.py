import datetime
import json

import pytest
from pyspark.sql import functions as F

from strataloom.sources import extract, readers, sinks
from strataloom.streaming import watch


def test_python_extraction(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\n\nclass C:\n    @property\n    def m(self) -> int:\n        return helper(self.x())\n\ndef helper(v):\n    return v\n")
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / "bin.py").write_bytes(b"x = 1\x00")
    (tmp_path / "note.txt").write_text("no source")
    files = readers.source_files(spark, str(tmp_path))
    assert {p.path.rsplit("/", 1)[1] for p in files.collect()} == {"a.py", "bad.py"}
    s, e = extract.python_symbols(files), extract.python_edges(files)
    assert {(r.name, r.kind) for r in s.collect()} == {("<module>", "module"), ("C", "class"), ("m", "method"), ("helper", "function")}
    assert s.where("name = 'm'").collect()[0].decorators == ",property,"
    names = {r.id: r.name for r in s.collect()}
    assert {(names[r.from_id], r.to_name, r.kind, r.target_kind) for r in e.collect()} == {("<module>", "os", "imports", None), ("m", "helper", "calls", "function"), ("m", "x", "calls", "method")}


def test_ignore_rules(spark, tmp_path):
    text = "# note\n*.gen.py\n/out/\ndocs/*.py\n!docs/keep.py\ncache\n"
    cases = {"a.gen.py": True, "x/b.gen.py": True, "out/a.py": True, "x/out/a.py": False, "docs/a.py": True, "docs/keep.py": False, "docs/x/a.py": False, "cache/a.py": True, "x/cache/y/a.py": True, "cached.py": False}
    got = spark.createDataFrame([(p,) for p in cases], "p string").select("p", readers.ignored(F.col("p"), readers.ignore_rules(text)).alias("i")).collect()
    assert {r.p: r.i for r in got} == cases
    for p in ("a.py", "out/b.py"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    assert {r.path.rsplit("/", 1)[1] for r in readers.source_files(spark, str(tmp_path), text).collect()} == {"a.py"}


def test_markdown_history(spark, tmp_path):
    (tmp_path / "adr").mkdir()
    (tmp_path / "adr" / "one.md").write_text("# One\n")
    (tmp_path / "z.md").write_text("# Z\n")
    (tmp_path / "secret.md").write_text("-----BEGIN PRIVATE KEY-----\n")
    (tmp_path / "large.md").write_text("x" * (readers.HISTORY_BYTES + 1))
    (tmp_path / "no.txt").write_text("# no")
    got = readers.markdown_history(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.kind, r.skipped, r.truncated) for r in got] == [("one.md", "decision", 2, False), ("z.md", "document", 2, False)]
    assert [r.truncated for r in readers.markdown_history(spark, str(tmp_path), cap=1).collect()] == [True]


def test_changed_files(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = lambda *p: spark.createDataFrame(list(p), "path string, mtime timestamp")
    again, gone = readers.changed_files(rows(("a", t), ("b", t), ("c", t)), rows(("a", t), ("b", t + datetime.timedelta(1)), ("d", t)))
    assert {r.path for r in again.collect()} == {"b", "c"} and {r.path for r in gone.collect()} == {"d"}


def test_reports(spark, tmp_path):
    (tmp_path / "l.info").write_text("TN:\nSF:src/a.py\nDA:1,2\nDA:2,0\nend_of_record\nSF:/src/b.py\nDA:7,-1\nend_of_record\n")
    assert {tuple(r) for r in readers.lcov(spark, str(tmp_path / "l.info")).collect()} == {("src/a.py", 1, 2), ("src/a.py", 2, 0), ("src/b.py", 7, 0)}
    (tmp_path / "c.xml").write_text('<coverage><classes><class filename="a.py"><lines><line number="1" hits="3"/><line number="2" hits="0"/></lines></class></classes></coverage>')
    assert {tuple(r) for r in readers.cobertura(spark, str(tmp_path / "c.xml")).collect()} == {("a.py", 1, 3), ("a.py", 2, 0)}
    (tmp_path / "j.xml").write_text('<testsuite><testcase name="x" classname="p.q" time="0.5"/><testcase name="y" file="t.py"><failure>no</failure></testcase></testsuite>')
    assert {tuple(r) for r in readers.junit(spark, str(tmp_path / "j.xml")).collect()} == {("p/q", "x", "passed", 0.5), ("t.py", "y", "failed", 0.0)}
    (tmp_path / "s.json").write_text(json.dumps({"runs": [{"tool": {"driver": {"name": "t", "rules": [{"id": "R0"}]}}, "results": [{"ruleIndex": 0, "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "file:///a.py"}, "region": {"startLine": 4}}}]}]}]}))
    found = readers.sarif(spark, str(tmp_path / "s.json"))
    assert [tuple(r) for r in found.collect()] == [("t", "R0", "warning", "a.py", 4, "m")]
    assert json.loads(sinks.sarif_results(found).collect()[0][0])["ruleId"] == "R0"
    (tmp_path / "o.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "a" * 32, "spanId": "b" * 16, "name": "n", "attributes": [{"key": "code.filepath", "value": {"stringValue": "/x.py"}}]}, {"traceId": "bad", "spanId": "b" * 16, "name": "n"}]}]}]}))
    assert [(r.span_id, r.parent_id, r.file_path) for r in readers.otlp(spark, str(tmp_path / "o.json")).collect()] == [("b" * 16, None, "x.py")]
    (tmp_path / "g.log").write_text("commit abc1\nauthor Ann\n\n3\t1\ta.py\n-\t-\tb.bin\ncommit abc2\nauthor Bo\n\n1\t0\ta.py\n")
    assert {(r.sha, r.author, r.path, r.added, r.binary) for r in readers.git_log(spark, str(tmp_path / "g.log")).collect()} == {("abc1", "Ann", "a.py", 3, False), ("abc1", "Ann", "b.bin", None, True), ("abc2", "Bo", "a.py", 1, False)}
    (tmp_path / "OWNERS").write_text("# all\n*.py @a\n/docs/ @b @c\n![x] @d\n")
    assert [(r.owners, r.rule_no) for r in readers.codeowners(spark, str(tmp_path / "OWNERS")).collect()] == [("@a", 1), ("@b,@c", 2)]
    (tmp_path / "OWNERS").write_text("/docs @a\n/src/* @b\n")
    import re

    rules = [r.pattern for r in readers.codeowners(spark, str(tmp_path / "OWNERS")).collect()]
    assert [[bool(re.match(p, x)) for x in ("docs", "docs/a/b", "docsx", "src/a", "src/a/b")] for p in rules] == [[True, True, False, False, False], [False, False, False, True, False]]
    older = {"resourceSpans": [{"scopeSpans": [], "instrumentationLibrarySpans": [{"spans": [{"traceId": "c" * 32, "spanId": "d" * 16, "name": "n"}]}]}]}
    (tmp_path / "p.json").write_text(json.dumps(older))
    assert readers.otlp(spark, str(tmp_path / "p.json")).count() == 1


def test_facts_are_strict(spark, tmp_path):
    import hashlib

    row = {"source_id": "s", "kind": "annotation", "severity": "error", "path": "a", "line": 1, "body": "b", "sha256": hashlib.sha256(b"b").hexdigest()}
    (tmp_path / "f.json").write_text(json.dumps(row))
    assert readers.facts(spark, str(tmp_path / "f.json")).count() == 1
    (tmp_path / "f.json").write_text(json.dumps(row | {"sha256": "0"}))
    with pytest.raises(Exception, match="digest of s"):
        readers.facts(spark, str(tmp_path / "f.json")).collect()


def test_sections(spark):
    text = "intro\n# A\n```\n# no\n```\n<!--\n# no\n-->\n## B ##\nx\n# Decision log\n### One\n- Decision: do it\n- Status: Accepted\n### Two\nDecision: a\nDecision: b\nStatus: x\n"
    got = readers.markdown_sections(text)
    assert [(s[0], s[1], s[2]) for s in got] == [("", 1, 1), ("A", 2, 8), ("A > B", 9, 10), ("Decision log", 11, 11), ("Decision log > One", 12, 14), ("Decision log > Two", 15, 19)]
    docs = spark.createDataFrame([("d.md", text), ("e.md", None)], "path string, text string")
    claims = readers.decision_claims(readers.document_sections(docs)).collect()
    assert [(c.statement, c.status) for c in claims] == [("do it", "accepted")]
    many = readers.markdown_sections("\n".join(f"# h{i}" for i in range(130)))
    assert len(many) == 128 and many[-1][2] == 130


def test_snapshots(spark, tmp_path):
    store = sinks.Snapshots(spark, str(tmp_path / "s"))
    assert store.current() is None
    store.publish("one", {"t": spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")})
    fresh, gone = spark.createDataFrame([("a", 2)], "k string, v int"), spark.createDataFrame([("b",)], "k string")
    store.publish("two", {"t": store.updated("t", "k", fresh, gone)})
    assert store.current() == "two" and [tuple(r) for r in store.read("t").collect()] == [("a", 2)]
    assert store.read("t", "one").count() == 2
    late = sinks.Snapshots(spark, str(tmp_path / "s"))
    late._pointers = lambda: ["0"]
    with pytest.raises(RuntimeError, match="before three"):
        late.publish("three", {"t": fresh})
    assert store.current() == "two"


def test_diagram(spark):
    got = sinks.mermaid(spark.createDataFrame([("a", 'b"', 3)], "from_component string, to_component string, observations long"))
    assert got.startswith("graph LR") and '["b"]' in got and "|3|" in got


def _stream(spark, folder, rows):
    spark.createDataFrame(rows, "ts timestamp, path string, kind string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("ts timestamp, path string, kind string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_coalesces_and_overflows(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    at = lambda ms: t + datetime.timedelta(milliseconds=ms)
    folder = str(tmp_path / "in")
    events = _stream(spark, folder, [(at(0), "a", "write"), (at(300), "a", "write"), (at(2000), "a", "delete"), (at(100), "b", "write")])
    _stream(spark, folder, [(at(60_000), "z", "write")])
    seen = []
    q = watch.watch(events, lambda rows, full: seen.append((sorted((r.path, r.events) for r in rows.collect()), full)), str(tmp_path / "c"), availableNow=True)
    q.awaitTermination()
    assert seen == [([("a", 1), ("a", 2), ("b", 1)], True)]
    q = watch.watch(_stream(spark, folder, [(at(61_000), "y", "write")]), lambda rows, full: None, str(tmp_path / "d"), pending=1, availableNow=True)
    with pytest.raises(Exception, match="may be pending"):
        q.awaitTermination()


def test_settled_files_replace_their_rows(spark, tmp_path):
    store, files = sinks.Snapshots(spark, str(tmp_path / "s")), {"a": 1, "b": 1}
    all_rows = lambda: spark.createDataFrame(list(files.items()), "file string, v int")
    read = lambda paths: all_rows() if paths is None else all_rows().join(paths, F.col("file") == F.col("path"), "left_semi")
    failures = [RuntimeError("once")]

    def flaky(rows, full):
        if failures:
            raise failures.pop()
        watch.refresher(store, "t", "file", read)(rows, full)

    settled = lambda *p: spark.createDataFrame([(x, 1) for x in p], "path string, events int")
    apply = watch.retried(flaky, wait=0)
    apply(settled("a", "b"), False)
    files["a"] = 2
    apply(settled("a"), False)
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 2), ("b", 1)]
    del files["b"]
    apply(settled("b"), False)
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 2)]
    files.update(c=3)
    apply(settled("x"), True)
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 2), ("c", 3)]
    failures.extend(RuntimeError("again") for _ in range(3))
    with pytest.raises(RuntimeError, match="again"):
        apply(settled("a"), False)


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"session":"s","ts":"2024-01-01T00:00:00Z","role":"user","text":"hi"}\n{"session":"s","role":"assistant","text":"yo"}\n')
    assert [r.text for r in readers.transcripts(spark, str(tmp_path / "t.jsonl")).collect()] == ["hi"]
    assert F.col("x") is not None


def test_episodes(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(t + datetime.timedelta(minutes=i), s, k) for i, s, k in [(0, "a", "x"), (1, "a", "end"), (0, "b", "x"), (2, "b", "x"), (3, "b", "x"), (4, "b", "x"), (5, "c", "x")]]
    for k, part in enumerate((rows, [(t + datetime.timedelta(hours=5), "z", "x")], [(t + datetime.timedelta(hours=6), "z", "x")])):
        spark.createDataFrame(part, "ts timestamp, session string, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, session string, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = watch.episodes(events, cap=3).writeStream.format("memory").queryName("episodes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.session, r.events, r.ended) for r in spark.sql("select * from episodes").collect()}
    assert {("a", 2, "end"), ("b", 3, "full"), ("b", 1, "lease"), ("c", 1, "lease")} <= got
