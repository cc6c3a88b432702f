"""Graph, item texts and pattern finds of a small made-up crate."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import extract, itemtext
from quarry.functions import scalar as S
from quarry.plans import build

ITEM = """fqn string, name string, item_type string, visibility string, signature string, doc_comment string, body_source string, attributes array<string>,
 generic_params array<struct<name: string, kind: string, bounds: array<string>, default: string>>, where_clauses array<struct<subject: string, bounds: array<string>>>,
 start_line int, end_line int, crate_name string, file_path string"""


def item(fqn, kind, signature="", body="", attributes=(), generics=(), visibility="pub", doc="", where=(), line=1, file="src/lib.rs"):
    return (fqn, fqn.split("::")[-1], kind, visibility, signature, doc, body, list(attributes), [(n, k, list(b), d) for n, k, b, d in generics], [(s, list(b)) for s, b in where], line, line + 9, fqn.split("::")[0], file)


RUN = """fn run(x: &Foo, y: Vec<Bar>) -> Result<Foo, E2> {
    // helper(1)
    helper(2);
    let mut f: Foo = Foo::new();
    f.size();
    other::deep::helper(3);
    Foo::make::<u8>(1);
    nowhere::helper(4);
    if (a) { stray() }
    let z = q as Baz;
    let w = Wide { a: 1 };
    self.step();
    run(1);
}"""
ITEMS = [
    item("c::m", "module"),
    item("c::m::Foo", "struct", "pub struct Foo<T>", "pub struct Foo<T> {\n    name: String,\n    #[serde]\n    bar: Bar,\n    far: other::Thing,\n    pub open: u8,\n}", ["#[derive(Debug, Clone)]"], [("T", "type", ["Clone", "Send"], "u8"), ("a", "lifetime", [], None)], doc=" A foo. "),
    item("c::m::Bar", "enum", "pub enum Bar", "{\n    One,\n    Two(u8),\n    // Three,\n    Four { x: u8 },\n}"),
    item("c::m::Show", "trait", "pub trait Show: Base", "trait Show {\n    fn show(&self);\n    async fn later<T>(x: T) {}\n}", generics=[("T", "type", ["Base", "lower"], None)]),
    item("c::Base", "trait"),
    item("c::m::Show::show", "function", "fn show(&self)", ""),
    item("c::m::Show::later", "function", "fn later(x: T)", "{ }"),
    item("c::m::Show::show::inner", "function", "fn inner()", ""),
    item("c::m::Show_Foo", "impl", "impl<T: Vec<u8>> Show for Foo<T> {", "impl {\n    fn show(&self) {}\n}", ["impl_for=Show<T>"]),
    item("c::m::Far_Foo", "impl", "unsafe impl Far for Foo", "", ["impl_for=Far"]),
    item("c::m::Foo_own", "impl", "impl Foo", "", []),
    item("c::m::Foo::new", "function", "fn new() -> Self", ""),
    item("c::m::Foo::size", "function", "fn size(&self) -> usize", ""),
    item("c::m::Foo::make", "function", "fn make()", ""),
    item("c::m::Foo::step", "function", "fn step()", ""),
    item("c::m::helper", "function", "fn helper(n: u8)", "helper(1); alone()"),
    item("c::other::deep::helper", "function", "fn helper(n: u8)", ""),
    item("c::aaa::helper", "function", "fn helper(n: u8)", ""),
    item("d::stray", "function", "fn stray()", "c::aaa::helper(1)"),
    item("c::m::run", "function", "fn run(x: &Foo, y: Vec<Bar>) -> Result<Foo, E2>", RUN, ["impl_type=Foo"], line=40),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, ITEM).cache()


def edges(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_containment_and_methods(items):
    got = edges(build.contains(items), "src", "dst", "detail")
    assert ("c", "c::Base", "Crate") in got and ("c", "c::m", "Crate") in got and ("c::aaa", "c::aaa::helper", "Module") in got and len(got) == len(ITEMS)
    assert edges(build.has_method(items), "src", "dst", "detail") == [("c::m::Show", "c::m::Show::later", "false"), ("c::m::Show", "c::m::Show::show", "true")]


def test_traits(items):
    impl, own, outside = build.implements(items)
    assert edges(impl, "src", "dst") == [("c::m::Far_Foo", "c::m::Far"), ("c::m::Show_Foo", "c::m::Show")]
    assert edges(own, "src", "dst") == [("c::m::Far_Foo", "c::m::Foo"), ("c::m::Foo_own", "c::m::own"), ("c::m::Show_Foo", "c::m::Foo")]
    assert edges(outside, "fqn", "name", "external") == [("c::m::Far", "Far", True)]
    assert edges(build.extends(items), "src", "dst") == [("c::m::Show", "c::Base")]


def test_fields_and_variants(items):
    assert edges(build.fields(items), "detail", "dst", "line") == [("bar", "c::m::Bar", 4), ("far", "other::Thing", 5), ("name", "String", 2)]
    assert edges(build.variants(items), "detail", "line") == [("Four", 5), ("One", 2), ("Two", 3)]


def test_calls(items):
    got = edges(build.calls(items), "src", "dst", "line", "detail")
    assert got == [
        ("c::m::run", "c::m::Foo::new", 4, "static"), ("c::m::run", "c::m::Foo::size", 5, "static"), ("c::m::run", "c::m::Foo::step", 12, "static"),
        ("c::m::run", "c::m::helper", 3, "static"), ("c::m::run", "c::other::deep::helper", 6, "static"), ("c::m::run", "d::stray", 9, "static"), ("d::stray", "c::aaa::helper", 1, "static"),
    ]
    sites = items.sparkSession.createDataFrame([("c::m::run", "x::y", 1, "trait")], "caller_fqn string, callee_fqn string, line_number int, dispatch string")
    assert edges(build.calls(items, sites), "src", "dst", "detail") == [("c::m::run", "x::y", "trait"), ("d::stray", "c::aaa::helper", "static")]


def test_method_calls_by_receiver(items):
    functions = items.where("item_type = 'function'").select("fqn", "name")
    assert edges(build.method_calls(items, functions), "fqn", "callee", "line") == [("c::m::run", "c::m::Foo::size", 5), ("c::m::run", "c::m::Foo::step", 12)]


def test_types(items):
    got = edges(build.uses_type(items).where("src = 'c::m::run'"), "dst", "detail", "line")
    assert got == [("c::m::Bar", "parameter", 40), ("c::m::Baz", "body", 10), ("c::m::E2", "return", 40), ("c::m::Foo", "body", 4), ("c::m::Foo", "parameter", 40), ("c::m::Foo", "return", 40), ("c::m::Wide", "body", 11)]
    impls = edges(build.uses_type(items).where("src LIKE '%_Foo'"), "src", "dst", "detail")
    assert impls == [("c::m::Far_Foo", "c::m::Far", "impl_trait"), ("c::m::Far_Foo", "c::m::Foo", "impl_self_type"), ("c::m::Show_Foo", "c::m::Foo", "impl_self_type"), ("c::m::Show_Foo", "c::m::Show", "impl_trait")]


def test_dependencies(spark):
    toml = '[package]\nname = "a"\n[dependencies]\nb-c = { path = "x" }\nserde = "1"\nd.workspace = true\n[dev-dependencies]\na = "1"\ne = "1"\n[build-dependencies.d]\npath = "y"\n[features]\nb = []\n'
    manifests = spark.createDataFrame([("a", toml)], "crate_name string, content string")
    crates = spark.createDataFrame([(x,) for x in ("a", "b_c", "d", "e", "f")], "crate_name string")
    assert edges(build.dependencies(manifests, crates), "src", "dst", "detail") == [("a", "b_c", ""), ("a", "d", ""), ("a", "d", "build"), ("a", "e", "dev")]


def test_graph_joins_all_families(items):
    g = build.graph(items)
    assert {r.rel for r in g.edges.select("rel").distinct().collect()} == {"CONTAINS", "IMPLEMENTS", "FOR", "HAS_FIELD", "HAS_VARIANT", "EXTENDS", "CALLS", "USES_TYPE", "HAS_METHOD"}
    assert g.nodes.where("external").select("fqn").first()[0] == "c::m::Far" and g.nodes.where("label = 'Crate'").count() == 2
    assert g.edges.groupBy("src", "rel", "dst").count().where("count > 1").count() == 0
    ends = g.edges.select(F.col("src").alias("fqn")).union(g.edges.select("dst")).distinct()
    assert ends.join(g.nodes, "fqn", "left_anti").count() == 0
    assert g.edges.where("NOT resolved").join(g.nodes.where("external"), F.col("dst") == F.col("fqn"), "left_anti").count() == 0
    empty = build.graph(items.where("false"))
    assert empty.edges.count() == empty.nodes.count() == 0


def test_item_texts(items):
    t = {r.fqn: r.t for r in items.select("fqn", itemtext.item_text().alias("t")).collect()}
    assert t["c::m::Foo"] == "pub struct Foo<T: Clone + Send = u8, 'a> { name, bar, far, pub open }\nDocumentation: A foo.\nDerives: Debug, Clone\nModule: c::m\nCrate: c"
    assert t["c::m::Bar"].startswith("pub enum Bar { One, Two, Four }\nNo documentation\nDerives: none\n")
    assert t["c::m::Show"].startswith("pub trait Show<T: Base + lower>: Base { show, later }\n")
    assert t["c::m::Show_Foo"].startswith("impl <T: Vec<u8>> Show for Foo<T> { show }\n")
    assert t["c::m"] == "pub mod m\nNo documentation\nModule: c\nCrate: c"
    assert t["c::m::run"].startswith("pub fn run(x: &Foo, y: Vec<Bar>) -> Result<Foo, E2>\nNo documentation\nModule: c::m\nCrate: c\nTraits used: none\nBody preview:\n   1: fn run(")


def test_texts_of_other_kinds(spark):
    rows = [
        item("c::A", "const", "const A: u8 = 3;"), item("c::B", "static", "static B"), item("c::N", "type_alias", "type N = Vec<u8>;"), item("c::u", "use", "use a::b;", visibility=""),
        item("c::mac", "macro", "", "macro_rules! mac { (a) => { one { x } }; (b) => { two }; () => {}; (c) => {3}; (d) => {4} }"), item("c::odd", "union", "union odd", "x", doc="d"),
        item("c::w", "function", "fn w<T>(a: T, b: (u8, u8))", "", generics=[("T", "type", [], None)], where=[("T", ["A", "B"]), ("U", ["C"])]),
    ]
    t = {r.name: r.t.split("\n") for r in spark.createDataFrame(rows, ITEM).select("name", itemtext.item_text().alias("t")).collect()}
    assert t["A"][0] == "pub const A: u8 = 3;" and t["B"][0] == "pub static B: unknown = unknown;" and t["N"][0] == "pub type N = Vec<u8>;"
    assert t["u"] == [" use a::b", "Module: c", "Crate: c"] and t["mac"][0] == "pub macro_rules! mac { one { x } | two | 3 }"
    assert t["odd"] == ["pub union odd", "Documentation: d", "Signature: union odd", "Module: c", "Crate: c", "Body:", "x"]
    assert t["w"][0] == "pub fn w<T>(a: T, b: (u8, u8)) -> ()" and t["w"][4] == "Traits used: T: A + B, U: C"


def test_payload(items):
    rows = items.withColumn("t", itemtext.item_text()).select(itemtext.payload(F.col("t")).alias("p")).select("p.*").collect()
    foo = next(r for r in rows if r.fqn == "c::m::Foo")
    assert (foo.crate_name, foo.module_path, foo.has_generics, foo.attributes, foo.trait_bounds) == ("c", "c::m", True, '["#[derive(Debug, Clone)]"]', None)
    assert foo.generic_params.startswith('[{"name":"T","kind":"type","bounds":["Clone","Send"],"default":"u8"}')
    assert next(r for r in rows if r.fqn == "c::Base").generic_params is None


def test_self_types(spark):
    cases = [
        ("Show_Foo", "impl<T: Vec<u8>> Show for Foo<T>", "Foo"), ("Foo", "impl Foo", "Foo"), ("A_B", "unsafe impl A for B {", "B"), ("A_B", None, "B"), ("my_b", "", "my_b"),
        ("A_Wrap", "impl<T> A for Wrap < T >", "Wrap"), ("x", "impl", "x"),
    ]
    df = spark.createDataFrame([(f"c::m::{n}", n, s, w) for n, s, w in cases], "fqn string, name string, signature string, want string")
    rows = df.select("want", extract.self_type().alias("got"), extract.method_prefix().alias("p")).collect()
    assert [(r.got, r.p) for r in rows] == [(r.want, f"c::m::{r.want}::") for r in rows]


def test_pattern_finds(spark):
    text = "impl<T> a::Show for Foo<T> {\n  let x = y.collect::<Vec<u8>>();\n  parse::<A, B>(z);\n}\nimpl Plain {"
    files = spark.createDataFrame([("c::m", "f.rs", text, "c::m::one")], "module_path string, file_path string, text string, caller string")
    r = extract.trait_impls(files).collect()
    assert [(x.trait_fqn, x.self_type, x.impl_fqn, x.line_number) for x in r] == [("a::Show", "Foo<T>", "c::m::a::Show_Foo<T>", 1)]
    got = sorted((x.callee_fqn, x.line_number, x.concrete_type_args, x.dispatch, x.caller_fqn) for x in extract.typed_calls(files).collect())
    assert got == [("collect", 2, ["Vec<u8"], "static", "c::m::one"), ("parse", 3, ["A", "B"], "static", "c::m::one"), ("unknown::collect", 2, ["Vec<u8"], "dynamic", "c::m::one")]


def test_derived_impls(spark):
    one = "#[derive(Debug, serde::Serialize)]\n#[x]\npub struct Foo {\n}\n\n\n#[derive(Clone)]\n\n\n\n\n\nenum Far {}"
    two = "impl Debug for Foo {\nimpl Serialize for Foo<T> {\nimpl Clone for Far {\nimpl Eq for Foo {"
    df = lambda t: spark.createDataFrame([("f", t)], "key string, text string")
    assert sorted((r.impl, r.generated_by) for r in extract.generated_impls(df(one), df(two)).collect()) == [("Debug for Foo", "derive(Debug)"), ("Serialize for Foo", "derive(Serialize)")]


def test_callers_of_files(items, spark):
    files = spark.createDataFrame([("a.rs", "c::m::Show", "c", "x"), ("b.rs", "zz", "zz", "")], "file_path string, module_path string, crate_name string, text string")
    got = {r.file_path: (r.caller, r.candidates, r.patterns_only) for r in extract.callers_of_files(items, files).collect()}
    functions = sorted(i[0] for i in ITEMS if i[2] == "function" and i[0].startswith("c::"))
    assert got == {"a.rs": (functions[0], len(functions), False), "b.rs": (None, 0, False)}
    assert spark.range(1).select(S.uuid5(F.lit("a:doc:0"))).first()[0]


def test_a_common_name_is_resolved_by_its_front(spark):
    """10,000 functions of one name and as many open targets: no pairs of them."""
    many = spark.range(10_000).select(F.format_string("c::m%d::Abc%d::new", F.col("id") % 50, "id").alias("fqn"), F.lit("new").alias("name"))
    targets = spark.range(0, 20_000, 2).select(F.format_string("Abc%d::inner::new", "id").alias("target"), F.lit("new").alias("name"), F.format_string("::Abc%d", "id").alias("front"))
    got = build.loose_targets(targets, many)
    names = [r.fqn for r in many.collect()]
    want = {}
    for r in targets.where("target LIKE 'Abc1%' OR target LIKE 'Abc2_::%'").collect():
        hit = [f for f in names if r.front in f]
        if hit:
            want[r.target] = min(hit)
    found = {r.target: r.loose for r in got.collect()}
    assert {t: f for t, f in found.items() if t.startswith("Abc1") or (t.startswith("Abc2") and t.index("::") == 5)} == want and len(found) == 5000
