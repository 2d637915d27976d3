"""Parsers, documents, histories, sinks and streams on small fixtures."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquilt import plugins
from graphquilt.operators import linking
from graphquilt.sources import code, sinks
from graphquilt.sources import text as S
from graphquilt.streaming import ingest

PY = '''import os
from .util import helper as h

class Base:
    def run(self):
        return helper2()

class Job(Base, mod.Mixin):
    """A job."""

    async def go(self):
        """Runs it."""
        self.run()
        h(1)

@app.get("/jobs/{id}")
def read_job(id):
    def inner():
        pass
    return Job().go()
'''


def kinds(rows, *which):
    return [r[:5] for r in rows if r[0] in which]


def test_python_by_ast():
    rows = code.parse(PY, "python")
    assert kinds(rows, "function", "class") == [("class", "Base", "Base", 4, 6), ("function", "run", "Base.run", 5, 6), ("class", "Job", "Job", 8, 14), ("function", "go", "Job.go", 11, 14), ("function", "read_job", "read_job", 17, 20), ("function", "inner", "read_job.inner", 18, 19)]
    assert [(r[1], r[2]) for r in rows if r[0] == "import"] == [("os", ""), (".util", "helper")]
    assert ("call", "run", "Job.go", 13, 13, "self") in rows and [r[5] for r in rows if r[0] == "class"] == ["", "Base,mod.Mixin"]
    assert [(r[1], r[2], r[5]) for r in rows if r[0] == "route"] == [("GET", "/jobs/{id}", "fastapi:app")]


def test_broken_python_is_read_by_lines():
    rows = code.parse("def a(:\n    x\n\nclass B:\n    def c(self):\n        y = '''def no():'''\n\nz = 1\n", "python")
    assert kinds(rows, "function", "class") == [("function", "a", "a", 1, 2), ("class", "B", "B", 4, 6), ("function", "c", "B.c", 5, 6)]


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("typescript", "import { a } from './x';\nexport function f(a: string): void {\n  if (a) { go('}'); }\n}\nexport class C extends B {\n  m(x?: number): string {\n    return this.n();\n  }\n}\nconst g = async (x) => {\n  f(x);\n};\n", [("class", "C", "C", 5, 9), ("function", "f", "f", 2, 4), ("function", "g", "g", 10, 12), ("function", "m", "C.m", 6, 8)]),
        ("java", "package a;\nimport b.C;\npublic class Foo extends Bar {\n    // void no() {\n    public Object run(Ctx c, Object d) {\n        return x.call();\n    }\n}\n", [("class", "Foo", "Foo", 3, 8), ("function", "run", "Foo.run", 5, 7)]),
        ("go", 'package x\n\nimport (\n\t"fmt"\n\t"a/b"\n)\n\ntype S struct {\n\ta int\n}\n\nfunc (s *S) M(a int) error {\n\treturn nil\n}\n\nfunc F(ctx Ctx) error {\n\tif x {\n\t}\n}\n', [("class", "S", "S", 8, 10), ("function", "F", "F", 16, 19), ("function", "M", "S.M", 12, 14)]),
        ("rust", "use a::b;\npub struct S { a: u8 }\nimpl S {\n    pub fn m(&self) -> u8 {\n        self.a\n    }\n}\npub async fn f<T>(x: &str) -> usize {\n    0\n}\n", [("class", "S", "S", 2, 2), ("function", "f", "f", 8, 10), ("function", "m", "S.m", 4, 6)]),
        ("csharp", "using System;\npublic class Foo : Bar {\n    public override int Run(int x) {\n        return 1;\n    }\n}\n", [("class", "Foo", "Foo", 2, 6), ("function", "Run", "Foo.Run", 3, 5)]),
        ("ruby", "require 'x'\nclass A < B\n  def m(x)\n    if x\n      1\n    end\n  end\nend\n", [("class", "A", "A", 2, 8), ("function", "m", "A.m", 3, 7)]),
        ("vue", "<template><a/></template>\n<script>\nexport function s() {\n  return 1;\n}\n</script>\n", [("function", "s", "s", 3, 5)]),
    ],
)
def test_other_languages(lang, text, want):
    assert sorted(set(kinds(code.parse(text, lang), "function", "class"))) == want
    assert not code.parse(None, lang) and not code.parse("", lang)


def test_terraform_sql_and_routes():
    tf = code.parse('variable "a" {\n  default = 1\n}\nresource "x_y" "z" {\n  v = var.a\n  d = x_y.other.id\n}\n', "terraform")
    assert ("tf_variable", "a", "var.a", 1, 3, "") in tf and ("tf_resource", "z", "x_y.z", 4, 7, "x_y") in tf
    assert {r[1] for r in tf if r[0] == "tf_ref"} == {"var.a", "x_y.other"}
    sql = code.parse("create table if not exists a.b (\n  id bigint,\n  n decimal(3, 2), -- note\n  primary key (id)\n);\nalter table a.b add column c text;\n", "sql")
    assert sql == [("sql_table", "a.b", "a.b", 1, 5, "id,n"), ("sql_column", "c", "a.b", 6, 6, "")]
    assert [(r[1], r[2]) for r in code.parse_routes("router.post('/x/:id', h)\n", "javascript")] == [("POST", "/x/:id")]
    assert [(r[1], r[2]) for r in code.parse_routes('    @GetMapping("/y")\n', "java")] == [("GET", "/y")]


def test_parsed_tables_link(spark, rows):
    f = spark.createDataFrame([("a/job.py", PY), ("a/util.py", "def helper():\n    pass\n"), ("x.bin", "zz"), (None, "x"), ("e.py", None)], "path string, body string")
    d = code.definitions(f)
    assert rows(code.has_method(d)) == [("a/job.py::Base", "a/job.py::Base.run"), ("a/job.py::Job", "a/job.py::Job.go")]
    imps = linking.import_edges(d.where("kind = 'import'").select("path", "name", F.col("qualified")), f.select("path"))
    assert rows(imps, "from_path", "to_path") == [("a/job.py", "a/util.py")]
    inh = linking.inherit_edges(code.name_refs(d), code.classes(d), imps)
    assert rows(inh) == [("a/job.py::Job", "a/job.py::Base")]
    calls = linking.call_edges(code.call_sites(d), code.functions(d), imps, code.has_method(d), inh)
    assert ("a/job.py::Job.go", "a/job.py::Base.run") in rows(calls, "from_id", "to_id")


# ---------------------------------------------------------------- documents


def test_markdown_sections(spark, rows):
    body = "# One\ntext\n## Two ##\n```\n# not a heading\n```\n### Three\nx\n## Four\n# Five\n"
    f = spark.createDataFrame([("d", body), ("n", None), ("e", "")], "path string, body string")
    s = S.sections(f)
    assert rows(s, "start_line", "end_line", "level", "title") == sorted([(1, 9, 1, "One"), (3, 8, 2, "Two"), (7, 8, 3, "Three"), (9, 9, 2, "Four"), (10, 11, 1, "Five")], key=repr)
    assert rows(S.section_tree(s), "start_line", "parent_line") == sorted([(1, None), (3, 1), (7, 3), (9, 1), (10, None)], key=repr)
    l = spark.createDataFrame([("d", "see [a](b.md) ![i](x.png)\n```\n[no](n)\n```\n`run_it(x)` and `Foo.bar`")], "path string, body string")
    assert rows(S.links(l), "label", "target") == [("a", "b.md")]
    assert rows(S.code_mentions(l), "name") == [("Foo.bar",), ("run_it",)]
    fn = spark.createDataFrame([("f::bar", "bar")], "id string, name string")
    assert rows(S.symbol_mentions(l, fn), "to_id") == [("f::bar",)]
    assert [r.text for r in S.read_lines(f, "d", 2, 3).collect()] == ["text", "## Two ##"]


def test_config_manifests_and_csv(spark, rows):
    f = spark.createDataFrame(
        [
            ("a.json", '{"x": {"y": 1}, "l": [1], // c\n "s": "//no"}'),
            ("b.toml", "[t]\nk = 1\n"),
            ("c.yml", "a: 1\nb:\n  c: 2\n  - d\n# e: 3\n"),
            ("d.json", "{broken"),
            ("p/package.json", '{"name": "n1", "version": "1", "dependencies": {"n2": "^1", "ext": "*"}}'),
            ("q/package.json", '{"name": "n2"}'),
            ("pyproject.toml", '[project]\nname = "p"\ndependencies = ["x>=1", "y"]\n'),
            ("t.csv", "a;b;c\n1;2;3\n\n4;5;6\n"),
        ],
        "path string, body string",
    )
    got = rows(S.config_sections(f).where("path in ('a.json', 'b.toml', 'c.yml', 'd.json')"))
    assert got == sorted([("a.json", "x", 1, "object"), ("a.json", "x.y", 2, "scalar"), ("a.json", "l", 1, "list"), ("a.json", "s", 1, "scalar"), ("b.toml", "t", 1, "object"), ("b.toml", "t.k", 2, "scalar"), ("c.yml", "a", 1, "scalar"), ("c.yml", "b", 1, "object"), ("c.yml", "b.c", 2, "scalar")], key=repr)
    m = S.manifests(f)
    assert rows(S.internal_dependencies(m)) == [("n1", "n2", "dependencies")]
    assert {r.dependency for r in m.where("path = 'pyproject.toml'").collect()} == {"", "x", "y"}
    assert rows(S.csv_summary(f)) == [("t.csv", ";", 3, 2, "a;b;c")]


def test_history_and_diffs(spark, rows):
    us = "\x1f"
    log = [f"commit{us}s1{us}ann{us}100", "", "3\t1\ta.py", "-\t-\tbin/{x => y}/i.png", f"commit{us}s2{us}bob{us}bad", "1\t0\told.py => new.py", "not a stat"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(log)], "line long, value string")
    assert rows(S.git_log(df)) == sorted([("s1", "ann", 100, "a.py", 3, 1), ("s1", "ann", 100, "bin/y/i.png", None, None), ("s2", "bob", 0, "new.py", 1, 0)], key=repr)
    diff = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n d\n@@ -10,2 +10,3 @@\n x\n+y\n z\ndiff --git a/g b/g\nBinary files differ\n"
    assert S.parse_diff(diff) == {"f": [(2, 2), (10, 11)], "g": None}
    r = S.diff_ranges(spark.createDataFrame([(7, diff), (8, None)], "pr long, diff string")).collect()
    assert {(x.pr, x.path, None if x.ranges is None else tuple((y.lo, y.hi) for y in x.ranges)) for x in r} == {(7, "f", ((2, 2), (10, 11))), (7, "g", None)}


def test_pages_and_chunks(spark):
    html = "<html><head><title> A  b </title><style>x{}</style></head><body><p>One&amp;two</p><script>no()</script><li>three</li></body></html>"
    r = S.pages(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).orderBy("url").collect()
    assert (r[0].title, r[0].text) == ("A b", "One&two\n\nthree") and (r[1].title, r[1].text) == ("", "")
    t = "aa\n\nbb\n\n" + "c" * 30 + "\n\ndd"
    c = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(S.paragraphs_packed("t", 10).alias("c")).collect()
    assert c[0].c == ["aa\n\nbb", "c" * 30, "dd"] and not c[1].c and c[2].c == []
    m = S.memory_entry(spark.createDataFrame([("memory/project_x.md", "---\nname: \"T\"\ntype: project\n---\nBody", 1.0), ("note_y.md", "# Head\nB", 2.0)], "path string, body string, mtime double")).collect()
    assert [(x.kind, x.title, x.body) for x in m] == [("project", "T", "Body"), ("note", "Head", "# Head\nB")]


def test_discovery_hashes_and_changes(spark, rows, tmp_path: Path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\n")
    (tmp_path / "src" / "b.log").write_bytes(b"skip me")
    (tmp_path / "c.md").write_bytes(b"# t\n")
    (tmp_path / "d.bin").write_bytes(b"\x00")
    f = S.discover(spark, str(tmp_path), ["*.log"])
    import hashlib

    assert {r.path: r.git_blob_sha for r in f.collect()} == {"src/a.py": hashlib.sha1(b"blob 6\x00x = 1\n").hexdigest(), "c.md": hashlib.sha1(b"blob 4\x00# t\n").hexdigest()}
    old = spark.createDataFrame([("c.md", "other"), ("gone.py", "h")], "path string, git_blob_sha string")
    assert rows(S.changed_files(old, f)) == [("c.md", "modified"), ("gone.py", "deleted"), ("src/a.py", "added")]


# ---------------------------------------------------------------- sinks and streams


def test_graphml_and_charts(spark, tmp_path: Path):
    n = spark.createDataFrame([("a<b", "py", 1), ("c", None, 2)], "id string, lang string, size long")
    e = spark.createDataFrame([("a<b", "c", 0.5)], "src string, dst string, weight double")
    sinks.graphml(n, e, str(tmp_path / "g"))
    doc = "\n".join(p.read_text() for part in sorted((tmp_path / "g").iterdir()) for p in sorted(part.glob("part-*")))
    root = ET.fromstring(doc.replace('<?xml version="1.0" encoding="UTF-8"?>', "").strip())
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert {x.get("id") for x in root.iter(f"{ns}node")} == {"a<b", "c"} and [x.get("target") for x in root.iter(f"{ns}edge")] == ["c"]
    assert "-->|0.5|" in sinks.mermaid(e) and '"a<b" -> "c"' in sinks.dot(e) and "a&lt;b" in sinks.html(e, "t")


def test_notes_travel(spark, rows, tmp_path: Path):
    n = spark.createDataFrame([(1, "note", "t1", "b1", "x, y", 5.0), (2, "note", "t2", "b2", "", 9.0)], "id long, kind string, title string, body string, tags string, ts double")
    sinks.export_notes(n, str(tmp_path / "j"), since=1.0)
    assert rows(sinks.import_notes(spark, str(tmp_path / "j"), n.limit(1)), "id") == [(1,), (2,)]


def test_incremental_equals_rebuild(spark, rows, tmp_path: Path):
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("sha", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("deleted", T.BooleanType())])
    batches = [[("a", "1", 1, False), ("b", "1", 2, False)], [("a", "2", 3, False), ("b", None, 4, True), ("c", "1", 5, None)], [("a", "3", 6, False), ("a", "4", 7, False), ("b", "9", 8, False)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "path", "seq").awaitTermination()
    kept = T.StructType(schema.fields[:3])
    last = ingest.latest_version(spark, str(tmp_path / "out"))
    got = rows(ingest.snapshot(spark, str(tmp_path / "out"), kept, last), "path", "sha")
    assert last == 2 and ingest.latest_version(spark, str(tmp_path / "nothing")) == -1
    # an earlier version still reads as it was, and the last batch left the part of c alone
    assert rows(ingest.snapshot(spark, str(tmp_path / "out"), kept, 0), "path", "sha") == [("a", "1"), ("b", "1")]
    assert len(list((tmp_path / "out" / "data" / "v=2").glob("bucket=*"))) <= 2
    store = spark.createDataFrame([], kept)
    assert got == rows(ingest.apply_changes(store, spark.createDataFrame([r for b in batches for r in b], schema), "path", "seq"), "path", "sha") == [("a", "4"), ("b", "9"), ("c", "1")]
    q = ingest.scan_queue(spark.createDataFrame([("s1",), ("s1",), (None,), ("s2",)], "git_blob_sha string"), spark.createDataFrame([("s2",)], "git_blob_sha string"))
    assert rows(q) == [("s1",)]


def test_registered_extensions():
    @plugins.register_scanner("s1", deferred=True)
    def scanner(df):
        return df

    @plugins.register_query("x1")
    def query(spark, folder):
        return spark.range(1)

    plugins.register_extension("point", 5)
    assert plugins.scanners(True) == {"s1": scanner} and plugins.scanners(False) == {} and plugins.queries() == {"x1": query} and plugins.extensions("point") == [5]

    @plugins.register_parser("madeup")
    def parse(text):
        return [("function", text, text, 1, 1, None)]

    assert code.parse("abc", "madeup") == [("function", "abc", "abc", 1, 1, None)]


def test_entry_works_without_the_text_subpackage(monkeypatch):
    import importlib.util as u

    import __spark_entry__ as e

    full = set(e.queries())
    monkeypatch.setattr(u, "find_spec", lambda name, *a: None)
    core = set(e.queries())
    assert "p7_found" in core and "p1_found" not in core and core < full | {"p1_found"}
    assert set(e.oracle_sql()) <= core


def test_rationale_terraform_and_context(spark, rows):
    from graphquilt.operators import context, rationale, terraform

    body = "# WHY: rows are kept\n# because order matters (ADR-0007)\ndef f():\n    # TODO later\n    # FIXME(x): slow\n    pass\n\n# plain comment\n"
    f = spark.createDataFrame([("a.py", body), ("docs/adr/0007-order.md", "# x"), ("n.py", None)], "path string, body string")
    b = rationale.comment_blocks(f)
    assert rows(b, "line", "end_line", "tag", "text", "adr") == sorted([(1, 2, "WHY", "rows are kept because order matters (ADR-0007)", "7"), (4, 4, "TODO", "later", None), (5, 5, "FIXME", "slow", None)], key=repr)
    s = spark.createDataFrame([("a.py::f", "f", "a.py", 3, 6)], "id string, name string, file_path string, start_line long, end_line long")
    assert rows(rationale.with_symbol(b, s), "line", "symbol") == [(1, "f"), (4, "f"), (5, "f")]
    assert rows(rationale.cited_records(b, f), "line", "record") == [(1, "docs/adr/0007-order.md")]

    tf = spark.createDataFrame([("m/a.tf", 'variable "v" {\n}\nresource "t_x" "one" {\n  a = var.v\n}\n'), ("m/b.tf", 'output "o" {\n  value = t_x.one.id\n}\n'), ("other/c.tf", 'variable "v" {\n}\n')], "path string, body string")
    d = code.definitions(tf)
    blks = terraform.blocks(d)
    e = terraform.references(d, blks)
    assert rows(e) == [("m/a.tf::t_x.one", "m/a.tf::var.v"), ("m/b.tf::output.o", "m/a.tf::t_x.one")]
    hit = terraform.impacted_files(e, blks, spark.createDataFrame([("m/a.tf", 1, 1)], "file_path string, lo long, hi long"))
    assert rows(hit, "file_path", "depth") == [("m/a.tf", 1), ("m/b.tf", 2)]
    assert terraform.source_folder("a/b", "../c") == "a/c" and terraform.source_folder("a", "hashicorp/x") is None

    ev = spark.createDataFrame([("s", 1, "user", "fix it", None, None, None), ("s", 2, "tool", "", "edit", "a.py", None), ("s", 3, "tool", "", "run", None, "pytest"), ("s", 4, "tool", "", "edit", "a.py", None)], "session_id string, seq long, role string, text string, tool string, path string, command string")
    r = context.transcript_digest(ev).first()
    assert (r.requests, r.files, r.commands) == (["fix it"], ["a.py"], ["pytest"])
    items = spark.createDataFrame([("alpha", 1), ("beta", 2), ("gamma", 3)], "name string, n int")
    assert [x.n for x in context.focus(items, F.col("name"), ["BET"], 2, F.col("n")).collect()] == [2] and context.focus(items, F.col("name"), ["bet"], 9, F.col("n")).count() == 3
    hits = spark.createDataFrame([("q", "a.py::f", 0.5)], "query string, doc string, score double")
    assert rows(context.locations(hits, s), "file_path", "start_line", "rank") == [("a.py", 3, 0)]


def test_reasons_are_whole_unless_cut_for_display(spark):
    from graphquilt.operators import rationale

    f = spark.createDataFrame([("a.py", "# WHY: " + "x" * 400 + " end\ndef f():\n    pass")], "path string, body string")
    assert rationale.comment_blocks(f).first().text == "x" * 400 + " end"
    assert rationale.comment_blocks(f, 300).first().text == "x" * 300


def test_parsed_functions_of_one_line_are_listed(spark, rows, tmp_path):
    from graphquilt.plans import catalogue

    spark.createDataFrame([("a.py", "s")], "path string, git_blob_sha string").write.parquet(f"{tmp_path}/file_node.parquet")
    spark.createDataFrame([("s", "def f(): return 1\n\ndef g():\n    return 2\n")], "git_blob_sha string, body string").write.parquet(f"{tmp_path}/source_blob.parquet")
    got = catalogue.QUERIES["q_parse_functions"](spark, str(tmp_path))
    assert rows(got, "name", "start_line", "end_line") == [("f", 1, 1), ("g", 3, 4)]
