import pytest
from pyspark.sql import functions as F

from quarry import config
from quarry.functions import cparse
from quarry.functions import text as T
from quarry.operators import cfront, positional, rules, select
from quarry.plans import stages
from quarry.sources import files, sinks


def test_config():
    c = config.parse("type=Int string Bool\nmaxIfStmt = 12abc\nfilterDir=filtered-files\nuseNonStdHeaders=false\n# type = x\nminIfStmt=3\nkeepCompilesOnly=true \nother=1\nType=char, int")
    assert c.types == ["Int", "Bool", "UChar", "Int"]
    assert (c["maxIfStmt"], c["minIfStmt"], c["useNonStdHeaders"], c["maxParam"]) == (12, 3, 0, 99999)
    assert c.filter_dir == "filteredFiles" and c.unknown_keys == ["other"]
    assert not c.keep_compiles_only  # a blank behind the word makes it no boolean
    assert config.load("/no/such/file").values == config.defaults()


def test_catalog(spark, tmp_path):
    (tmp_path / "c.csv").write_text("stars,repository,language,size,more\n5,a/a,C,100,x\n4,a/b,C,100,x\n5,a/c,C,99,x\n5,a/d,Go,100,x\n9,a/e,C,bad,x\n" + "".join(f"7,b/{i},C,200,x\n" for i in range(5)))
    rows = files.read_catalog(spark, str(tmp_path / "c.csv"))
    got = [r.repository for r in select.select_repos(rows, "C", 100, 5, 2).collect()]
    assert got == ["a/a", "b/0", "b/1"]  # one more than asked for
    assert [r.repository for r in select.select_repos(rows.withColumn("alive", F.col("repository") != "b/0"), "C", 100, 5, 1, alive="alive").collect()] == ["a/a", "b/1"]


def test_sources_and_sink(spark, tmp_path):
    (tmp_path / "x/y").mkdir(parents=True)
    for name in ("a.c", "b.C", "c.h", "x/y/d.c"):
        (tmp_path / name).write_text("int a;\n\n  \nint b;")
    got = files.read_sources(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == ["a.c", "d.c"]
    assert files.read_sources(spark, str(tmp_path / "none")).count() == 0
    assert [tuple(r) for r in files.lines(spark.createDataFrame([("p", "a\n\nb\n")], files.SOURCES)).orderBy("line_no").collect()] == [("p", "a", 1), ("p", "", 2), ("p", "b", 3)]
    sinks.write_tree(spark.createDataFrame([("out/p.c", "int x;")], files.SOURCES), str(tmp_path / "tree"))
    assert (tmp_path / "tree/out/p.c").read_text() == "int x;"


@pytest.mark.parametrize(
    ("text", "loc", "bad"),
    [("#include <stdio.h>\n", 1, 0), ('#include "local.h"\nx', 2, 1), ("# include <other.h>", 1, 0), ("#include <a-b.h>", 1, 0), ("// #include <other.h>\n\n \n\r", 3, 1), ("#import <string>", 1, 0), ("", 0, 0)],
)
def test_file_stats(spark, text, loc, bad):
    row = select.file_stats(spark.createDataFrame([("p", text)], files.SOURCES)).first()
    assert (row.loc, row.nonstd_includes) == (loc, bad)


def test_file_bounds(spark):
    rows = spark.createDataFrame([(str(n), "x\n" * n) for n in (1, 2, 4, 5)] + [("null", None)], files.SOURCES)
    assert sorted(r.path for r in select.passing_files(rows, 2, 4).collect()) == ["2", "4"]


def test_names(spark):
    rows = spark.createDataFrame([("unsigned int",), ("char *",), ("_Bool",), ("struct X",), ("long long",)], "t string")
    got = rows.select(T.strip_name(F.col("t")).alias("a"), T.underscore_name(F.col("t")).alias("b"), T.stub_declaration(F.col("t"), T.underscore_name(F.col("t"))).alias("d")).collect()
    assert [tuple(r)[:2] for r in got] == [("unsignedint", "unsigned_int"), ("pointer", "pointer"), ("bool", "bool"), ("structX", "struct_X"), ("longlong", "long_long")]
    assert got[1].d == "extern void *__VERIFIER_nondet_pointer(void);" and got[0].d == "extern unsigned int __VERIFIER_nondet_unsigned_int(void);"


def test_paths(spark):
    row = spark.createDataFrame([("../db/../x/filteredFiles/a.c",)], "p string")
    assert row.select(T.filtered_path(F.col("p"), "filteredFiles", "db")).first()[0] == "filteredFiles/db/x/filteredFiles/a.c"
    assert row.select(T.benchmark_path(F.col("p"), "bench", "filteredFiles")).first()[0] == "bench/db/x/a.c"


def test_rules(spark):
    c = config.parse("minCallFunc=1\nmaxCallFunc=3\nminIfStmt=1")
    base = dict.fromkeys(config.COUNTERS, 0)
    given = {"at_min": (1, 1), "below": (0, 1), "at_max": (3, 1), "above": (4, 0), "Program": (0, 0), "main": (9, 9)}
    rows = spark.createDataFrame([(k, *[{**base, "CallFunc": a, "IfStmt": b}[n] for n in config.COUNTERS]) for k, (a, b) in given.items()], "func string, " + ", ".join(f"{n} long" for n in config.COUNTERS))
    got = {r.func: r.failed_rule for r in rules.verdicts(rows, rules.config_rules(c)).collect()}
    assert got == {"at_min": None, "below": "minCallFunc", "at_max": None, "above": "maxCallFunc", "Program": None, "main": None}


def attrs(spark, text, types):
    parsed = cfront.parse_sources(spark.createDataFrame([("p", text)], files.SOURCES))
    return {r.func: r.asDict() for r in cfront.func_attrs(parsed, config.parse(f"type={types}")).collect()}


def test_counters(spark):
    text = "_Bool b; unsigned char u; enum {E};\nint f(int x) { x++; ++x; x = -x; x = !b; x += 2; x = x * 2; b = x < 3; x = b ? x : 1; &x; u; E; do { x--; } while (x); return x; }\nint g(void);\nint f2() { return g() + f(1); }"
    a = attrs(spark, text, "Int Int")
    assert a["Program"]["Functions"] == 3 and a["Program"]["Param"] == 0
    f = a["f"]
    assert (f["TypePostfix"], f["TypePrefix"], f["TypeArithmeticOperation"], f["TypeCompareOperation"]) == (4, 2, 4, 3)
    assert f["TypeUnaryOperation"] == 6 + 2 * 5 and f["TypeVariables"] == 1 and f["WhileLoops"] == 0
    assert a["f2"]["CallFunc"] == 2 and a["f2"]["TypeArithmeticOperation"] == 2
    assert attrs(spark, text, "char")["f"]["TypeVariableReference"] == 1
    assert attrs(spark, text, "double")["f"]["TypeUnaryOperation"] == 6


def test_parser_survives():
    for text in ("", None, "int f( {", "}}}", "foo bar baz;", "int x = ;", "int f() { if (x { } ", '"', "/* open", "#define A", "a" * 5000, "(" * 3000, "int f(void) { return 0; } trailing"):
        cparse.parse(text)
    assert cparse.parse("int f(void) { return y; }").n_errors == 1
    assert cparse.parse("typedef struct { int a; float *b; } S; float g(S *s) { return s->b[s->a]; }").unknown_type_nodes == 0


def test_edits():
    assert cfront.apply_to("abcdef", [(1, 3, "X", 0), (2, 3, "no", 1), (0, 0, "<", 0), (6, 6, ">", 0), (4, 5, "", 2)]) == "<aXdf>"
    assert cfront.apply_to("abc", []) == "abc"


def test_nested_removed_calls(spark):
    text = "int g(int a) { return a; }\nint f(int a) { return a; }\nint main(void) {\n  return f(g(1));\n}\n"
    c = config.parse("type=Int\nminIfStmt=1\n")
    out = stages.run_filter(spark.createDataFrame([("p.c", text)], files.SOURCES), c).first().text
    assert "return __VERIFIER_nondet_int();" in out and "int f(" not in out


def test_dead_call_and_existing_main(spark):
    text = "bool dead(int);\nint spare(int a) { return a; }\nint main(void) {\n  return dead(1);\n}\n"
    c = config.parse("")
    c.keep_compiles_only = False
    out = stages.run_transform(spark.createDataFrame([("p.c", text)], files.SOURCES), c).first()
    assert "return __VERIFIER__non_det_bool();" in out.text and "extern _Bool __VERIFIER_nondet_bool(void);" in out.text
    assert out.text.rstrip().endswith("spare(__VERIFIER_nondet_int());\n}") and not out.compiles
    kept = stages.run_transform(spark.createDataFrame([("p.c", text)], files.SOURCES), config.parse(""))
    assert kept.count() == 0


def test_report_and_regeneration(spark):
    parsed = cfront.parse_sources(spark.createDataFrame([("p", "extern int __VERIFIER_nondet_int(void);\nint f(void) { return 1; }\nint g(int);\n")], files.SOURCES))
    assert stages.regenerate(parsed).first().text == "int f(void) { return 1; }\nint g(int);"
    assert stages.attribute_report(parsed, config.parse("")).count() == 4 * 16


def test_take_while_ties(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, False)], "k int, o int, s boolean")
    assert positional.take_while(rows, ["k"], ["o"], F.col("s")).count() == 2
    assert positional.take_while(rows, ["k"], ["o", "s"], F.col("s")).count() == 2
    assert positional.take_while_all(rows, ["k", "o"], F.col("s")).count() == 1


def test_streaming_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.c").write_text("int a;\n")
    stream = select.file_stats(files.stream_sources(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("files").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("files").first().loc == 1


def test_filter_arriving(spark, tmp_path):
    from quarry.streaming.incremental import filter_arriving

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.c").write_text("int f(void) {\n  return 1;\n}\n")
    (tmp_path / "in/b.c").write_text("#include <other.h>\n")
    for _ in range(2):
        filter_arriving(spark, str(tmp_path / "in"), str(tmp_path / "out"), config.parse(""), str(tmp_path / "ck")).awaitTermination(120)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["int f(void) {\n  return 1;\n}\n"]


def test_tree_goes_below_its_root(spark, tmp_path):
    (tmp_path / "db/r s").mkdir(parents=True)
    (tmp_path / "db/r s/a+b.c").write_text("int f(void) {\n  return 1;\n}\n")
    rows = files.read_sources(spark, str(tmp_path / "db"))
    assert [r.path for r in rows.collect()] == ["db/r s/a+b.c"]
    c = config.parse("wipeOldBenchmarks = true\n")
    out = stages.run_full(rows, c)
    (tmp_path / "out/benchmarks").mkdir(parents=True)
    (tmp_path / "out/benchmarks/old.c").write_text("old")
    for _ in range(2):
        stages.write_outputs(out, str(tmp_path / "out"), c)
    made = [str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert made == ["benchmarks/db/r s/a+b.c"] and "int main(void) {\n    f();" in (tmp_path / "out" / made[0]).read_text()
    again = files.read_sources(spark, f"file://{tmp_path}/out/benchmarks")  # what was written can be read
    assert [r.path for r in again.collect()] == ["benchmarks/db/r s/a+b.c"]
    for bad in ("../x.c", "a/../../x.c", ""):
        with pytest.raises(Exception, match="below the folder"):
            sinks.write_tree(spark.createDataFrame([(bad, "x")], files.SOURCES), str(tmp_path / "out"))
    assert not (tmp_path / "x.c").exists()
    sinks.write_tree(spark.createDataFrame([(None, "x"), ("file:/abs/n.c", None)], files.SOURCES), f"file://{tmp_path}/out")
    assert (tmp_path / "out/abs/n.c").read_text() == ""


def test_entry_points(spark, tmp_path, capsys):
    from quarry.__main__ import main

    (tmp_path / "db").mkdir()
    (tmp_path / "db/a.c").write_text("int f(int x) {\n  return x;\n}\n")
    (tmp_path / "c.config").write_text("minFileLoC = 2\ndebugLevel = 1\n")
    for stage, made in (("filter", "filteredFiles/db/a.c"), ("full", "benchmarks/db/a.c"), ("transform", "benchmarks/db/a.c")):
        assert main([stage, str(tmp_path / "c.config"), str(tmp_path / "db"), str(tmp_path / stage), "--debug"]) == 0
        assert (tmp_path / stage / made).exists()
    said = capsys.readouterr().out
    assert "attempted 1, compile 1" in said and "minFileLoC = 2" in said and "== filteredFiles/db/a.c\nint f" in said
    (tmp_path / "r.csv").write_text("repository,language,size,stars\na/b,C,100,1\na/c,Go,100,1\n")
    assert main(["select", str(tmp_path / "none"), str(tmp_path / "r.csv"), str(tmp_path / "picked")]) == 0
    assert [r.repository for r in spark.read.csv(str(tmp_path / "picked"), header=True).collect()] == ["a/b"]


def test_config_in_order():
    lines = config.describe(config.parse("type=Int\nminIfStmt=2"))
    assert lines == sorted(lines) and "minIfStmt = 2" in lines and "type = Int" in lines


CONDITIONAL = """#define DEPTH 3
#define EACH(i, n) for (int i = 0; i < (n); i++)
#define JOIN(a, b) a##b
#define SAY(fmt, ...) printf(fmt, __VA_ARGS__)
#define QUOTE(x) #x
#if 0
int never(void) { return 1; }
#elif defined(DEPTH) && DEPTH > 2
int deep(void) { return DEPTH; }
#else
int shallow(void) { return 2; }
#endif
#ifndef GUARD
#define GUARD
#ifdef MISSING
int missing(void);
#endif
#endif
#undef DEPTH
#ifdef DEPTH
int again(void);
#endif
int JOIN(glu, ed)(int v) { EACH(k, v) { v += k; } SAY("%d %s", v, QUOTE(a "b")); return v; }
int main(void) { return unheard(3) + deep(); }
"""


def test_conditionals_and_macros(spark):
    u = cparse.parse(CONDITIONAL)
    assert [(f["func"], f["in_macro"]) for f in u.functions] == [("deep", False), ("glued", True), ("main", False)]
    assert u.n_errors == 0 and u.undeclared == ["unheard"] and u.unknown_type_nodes == 0
    assert [(n["kind"], n["callee"]) for n in u.nodes if n["kind"] in ("ForStmt", "CallExpr")] == [("ForStmt", ""), ("CallExpr", ""), ("CallExpr", "unheard"), ("CallExpr", "deep")]
    assert cparse.parse("#if 1 /* c */\nint a;\n#if 0\n#else\nint b;\n#endif\n#endif\n").names == ["a", "b"]
    assert cparse.parse("#if (1 << 2) == 4 && !0x0 || BAD(\nint a;\n#endif").names == [] and cparse.parse("#if 1\nint a;").n_errors == 1
    assert cparse.parse("#define A B\n#define B A\nint A;").names == ["A"]  # not expanded inside itself
    bomb = "\n".join(f"#define M{i} M{i - 1} M{i - 1}" for i in range(1, 40))
    assert cparse.parse(f"#define M0 1\n{bomb}\nint x = M39;").n_errors >= 1
    # a function whose name a macro makes isn't removed, one that isn't declared is a dead call with an int
    out = stages.run_filter(spark.createDataFrame([("p.c", CONDITIONAL)], files.SOURCES), config.parse("type=Int\nminIfStmt=1")).first().text
    assert "JOIN(glu, ed)(int v)" in out and "int deep" not in out and "return unheard(3) + __VERIFIER_nondet_int()" in out
    c = config.parse("")
    c.keep_compiles_only = False
    out = stages.run_transform(spark.createDataFrame([("p.c", CONDITIONAL)], files.SOURCES), c).first().text
    assert "return __VERIFIER__non_det_int() + deep();" in out and "extern int __VERIFIER_nondet_int(void);" in out


def test_long_sums_and_many_comments():
    import time

    began = time.process_time()
    assert len(cparse.parse("int f(int x) { return " + " + ".join(["x"] * 8000) + "; }").nodes) > 15_000
    assert cparse.parse("".join(f"/* c{i} */\nint f{i}(int x);\n" for i in range(8000))).functions[-1]["comment_begin"] > 0
    assert time.process_time() - began < 5


def test_repeated_and_null_paths(spark):
    text = "int f(int a) {\n  return a;\n}\n"
    rows = spark.createDataFrame([("p.c", text), ("p.c", text), ("q.c", None), (None, text), ("e.c", "")], files.SOURCES)
    out = stages.run_full(rows, config.parse("minFileLoC = 1"))
    assert [(r.path, r.text.count("f(__VERIFIER_nondet_int())")) for r in out.collect()] == [("p.c", 1)]
    assert stages.run_full(rows.limit(0), config.parse("")).count() == 0


def test_concrete_stubs():
    u = cparse.parse(T.stub_definitions())
    assert u.n_errors == 0 and len([f for f in u.functions if f["func"].startswith(T.NONDET)]) == len(T.STUB_VALUES)
