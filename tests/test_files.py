"""Files as sources: discovery, size gates, Markdown, suites, snapshots, and the item parser."""

from pyspark.sql import functions as F

from quarry.functions import parse
from quarry.sources import files

SOURCE = '''//! crate
use std::{fmt, io};
/// Doc one.
/// Doc two.
#[derive(Debug)]
pub struct Foo<'a, T: Clone + Send = u8> {
    name: String, // { not a brace
    x: [u8; 3],
}
struct Pair(u8, Vec<T>);
static S: &str = "}{ fn no() {}";
pub trait Show<T>: Base where T: A + B, U: C {
    const K: u8;
    fn later<T>(&self, f: impl Fn(u8) -> u8) { let c = '{'; fn inner() {} }
}
impl<'a, T: Vec<u8>> a::Show<T> for Foo<'a, T> {
    pub async fn show(&self) -> [u8; 2] { match 1 { _ => {} } }
}
pub mod deep {
    pub fn run(x: fn(u8) -> u8) -> u8 { struct Hidden; 1 }
    mod more { macro_rules! mac { (a) => { fn bad() {} }; } fn last() {} }
}
extern "C" fn ffi();
'''


def test_source_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.rs").write_text("fn é() {}")
    (tmp_path / "a" / "b" / "y.rs").write_text("z" * 200)
    (tmp_path / "a" / "n.txt").write_text("no")
    got = {r.path.split("/")[-1]: (r.bytes, r.text) for r in files.source_files(spark, str(tmp_path), most=100).collect()}
    assert got == {"x.rs": (10, "fn é() {}")}
    both = spark.createDataFrame([("a", "b"), ("a", "b" * 50), ("a", None)], "text string, expanded string")
    assert [r.text for r in files.within_expansion(both, most=10).collect()] == ["b", "a", "a"]
    many = spark.createDataFrame([("a", "impl X " * n) for n in (500, 501)], "text string, expanded string")
    assert [len(r.text) for r in files.within_expansion(many).collect()] == [3500, 1]


def test_markdown_files(spark, tmp_path):
    for name in ("docs/a.md", "docs/tasks-1.md", "docs/skip/b.md", "README.md", "docs/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\nline")
    got = {r.path: r.text for r in files.documents(spark, str(tmp_path), ("tasks",), ("docs/skip",)).collect()}
    assert got == {"docs/a.md": "# docs/a.md\nline", "README.md": "# README.md\nline"}
    assert files.whole_texts(spark, str(tmp_path / "docs/a.md")).first().text == "# docs/a.md\nline"


def test_suite_files(spark, tmp_path):
    (tmp_path / "s.yaml").write_text('name: x\ncases:\n  - id: one  # first\n    repo: "a/b"\n    pr: 12\n    expected_outcome: pass\n    tags: [fast, "two words"]\n  - id: two\n    weight: 2.5\n    tags:\n      - slow\nafter: 1\n')
    rows = {r.id: r for r in files.suite_file(spark, str(tmp_path / "s.yaml")).collect()}
    assert (rows["one"].repo, rows["one"].pr, rows["one"].weight, rows["one"].tags) == ("a/b", 12, 1.0, ["fast", "two words"])
    assert (rows["two"].weight, rows["two"].tags, rows["two"].repo) == (2.5, ["slow"], None) and len(rows) == 2


def test_snapshots(spark, tmp_path):
    files.snapshot({"a": spark.range(3), "b": spark.range(5)}, str(tmp_path / "snap"))
    files.snapshot({"a": spark.range(4)}, str(tmp_path / "snap"))
    back = files.restore(spark, str(tmp_path / "snap"), ("a", "b"))
    assert {k: v.count() for k, v in back.items()} == {"a": 4, "b": 5}
    assert sorted(r.row for r in files.as_json(spark.range(2).select("id", F.lit(None).cast("string").alias("n"))).collect()) == ['{"id":0,"n":null}', '{"id":1,"n":null}']


def test_items_of_a_text(spark):
    got = {i[0]: i for i in parse.items_of(SOURCE, "c::m")}
    assert set(got) == {"c::m::" + x for x in ("fmt,io", "Foo", "Pair", "S", "Show", "Show::K", "Show::later", "Show_Foo", "Foo::show", "deep", "deep::run", "deep::more", "deep::more::mac", "deep::more::last", "ffi")}
    foo, later = got["c::m::Foo"], got["c::m::Show::later"]
    assert foo[2:6] == ("struct", "pub", "pub struct Foo<'a, T: Clone + Send = u8>", "Doc one.\nDoc two.") and foo[7:] == (["#[derive(Debug)]"], [("a", "lifetime", [], None), ("T", "type", ["Clone", "Send"], "u8")], [], 6, 9)
    assert later[6].endswith("fn inner() {} }") and got["c::m::Show"][9] == [("T", ["A", "B"]), ("U", ["C"])]
    assert got["c::m::Show_Foo"][7] == ["impl_for=a::Show<T>"] and got["c::m::Foo::show"][7] == ["impl_type=Foo"] and got["c::m::ffi"][6] == ""
    df = spark.createDataFrame([("c::m", SOURCE, "c", "f.rs"), ("d", None, "d", "g.rs"), ("e", "fn broken( {", "e", "h.rs")], "module_path string, text string, crate_name string, file_path string")
    rows = parse.parsed(df).collect()
    assert sum(r.file_path == "f.rs" for r in rows) == len(got) and {r.fqn for r in rows if r.file_path == "h.rs"} <= {"e::broken"}
