"""C files as tables: functions, nodes, counters per function, edits, and their application.

Parsing is the one step that needs Python: rows of (path, text) go through Arrow once and come back with nested rows; everything between
parsing and writing edits is DataFrame operations. A file is one row throughout; what is shuffled is small rows keyed by path.

Defined results: a null text is an empty file; a path is the key of its file and stands in one row (``stages.parse_passing`` keeps one row of those that repeat
a path and leaves out null paths); empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..shipping import ship
from . import counters, select

_PARAMS = "array<struct<name:string,type_str:string,type_kind:string>>"
FUNCTION = f"func string, ord int, line int, is_def boolean, storage string, ret_type_str string, ret_type_kind string, params {_PARAMS}, name_line_off int, begin int, end int, comment_begin int, comment_end int, in_macro boolean, is_main boolean, body_begin int, body_end int"
NODE = "node_id int, parent_id int, kind string, op string, type_kind string, type_str string, callee string, func string, begin int, end int, line int"
_UNIT = ", ".join(["functions array<struct<" + ",".join(f.replace(" ", ":", 1) for f in FUNCTION.split(", ")) + ">>", "nodes array<struct<" + ",".join(f.replace(" ", ":", 1) for f in NODE.split(", ")) + ">>"])
PARSED = f"path string, text string, {_UNIT}, names array<string>, undeclared array<string>, first int, n_errors int, unknown_type_nodes int"

_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def _struct(fields: str) -> pa.DataType:
    params = pa.list_(pa.struct([("name", pa.string()), ("type_str", pa.string()), ("type_kind", pa.string())]))
    flat = fields.replace(_PARAMS, "params")
    return pa.list_(pa.struct([(f.split()[0], params if f.split()[1] == "params" else _ARROW[f.split()[1]]) for f in flat.split(", ")]))


def _schema() -> pa.Schema:
    return pa.schema([("path", pa.string()), ("text", pa.string()), ("functions", _struct(FUNCTION)), ("nodes", _struct(NODE)), ("names", pa.list_(pa.string())), ("undeclared", pa.list_(pa.string())), ("first", pa.int32()), ("n_errors", pa.int32()), ("unknown_type_nodes", pa.int32())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from ..functions.cparse import parse

    schema = _schema()
    for batch in batches:
        paths, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows: list[dict] = []
        for path, text in zip(paths, texts):
            u = parse(text)
            rows.append({"path": path, "text": text, "functions": u.functions, "nodes": u.nodes, "names": u.names, "undeclared": u.undeclared, "first": u.first, "n_errors": u.n_errors, "unknown_type_nodes": u.unknown_type_nodes})
            if len(rows) == 64:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def parse_sources(sources: DataFrame) -> DataFrame:
    """(path, text) with functions, nodes, names declared, calls of undeclared functions, counts of errors."""
    ship(sources.sparkSession)
    return sources.select("path", "text").mapInArrow(_parse, PARSED)


def functions(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("functions").alias("f")).select("path", "f.*")


def nodes(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("nodes").alias("n")).select("path", "n.*")


def _typed(config: Config) -> Column:
    """How many of the requested types a node has."""
    if not config.types and config.any_type_counts:
        return F.when(F.col("type_kind") != "", 1).otherwise(0)
    if not config.types:
        return F.lit(0)
    return counters.times_asked(F.col("type_kind"), config.types)


def func_attrs(parsed: DataFrame, config: Config) -> DataFrame:
    """The 16 counters of each (path, func) and of ``Program``, which every file has.

    One aggregation; functions without nodes, and Program, come from seed rows that add zero."""
    typed = _typed(config)
    kind, op = F.col("kind"), F.col("op")
    unary, binary = kind == "UnaryOperator", kind == "BinaryOperator"

    def times(cond: Column) -> Column:
        return F.when(cond, typed).otherwise(0)

    def once(cond: Column) -> Column:
        return F.when(cond & (typed > 0), 1).otherwise(0)

    def one(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    counted = {
        "CallFunc": one(kind == "CallExpr"),
        "ForLoops": one(kind == "ForStmt"),
        "IfStmt": one(kind == "IfStmt"),
        "TypeArithmeticOperation": times(unary & op.isin("+", "-", "~", "!") | binary & op.isin("+", "-")),
        "TypeCompareOperation": once(binary & op.isin("<", ">", "<=", ">=", "==", "!=")) + times(kind == "ConditionalOperator"),
        "TypeIfStmt": times(kind == "IfStmt"),
        "TypePostfix": times(unary & op.isin("post++", "post--")),
        "TypePrefix": times(unary & op.isin("pre++", "pre--")),
        "TypeUnaryOperation": one(unary) + times(unary),
        "TypeVariableReference": times(kind == "DeclRefExpr"),
        "TypeVariables": once(kind.isin("VarDecl", "ParmVarDecl")),
        "WhileLoops": one(kind == "WhileStmt"),
    }
    rows = nodes(parsed).select("path", "func", *[c.alias(n) for n, c in counted.items()])
    zero = [F.lit(0).cast("long").alias(n) for n in counted]
    # what is counted on no node: the number of functions belongs to Program, the rest stays zero
    names = F.array_distinct(F.transform("functions", lambda f: f["func"]))
    seeds = parsed.select("path", F.explode(F.array_union(names, F.array(F.lit("Program")))).alias("func"), F.size(names).alias("n"))
    seeds = seeds.select("path", "func", *zero, F.when(F.col("func") == "Program", F.col("n")).otherwise(0).cast("long").alias("Functions"))
    rows = rows.withColumn("Functions", F.lit(0).cast("long")).unionByName(seeds)
    out = counters.count(rows, ["path", "func"], {n: F.col(n) for n in [*counted, "Functions"]})
    never = F.lit(0).cast("long")
    return out.withColumn("Param", never).withColumn("TypeParameters", never).withColumn("TypeComparisons", never)


EDIT = "path string, begin int, end int, kind string, text string, seq int"


def _edit(rows: DataFrame, begin: Column, end: Column, kind: str, text: Column, seq: Column) -> DataFrame:
    return rows.select("path", begin.cast("int").alias("begin"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), text.alias("text"), seq.cast("int").alias("seq"))


def removal_edits(funcs: DataFrame, removed: DataFrame, config: Config) -> DataFrame:
    """Takes out removed functions with their comments. ``removed``: (path, func)."""
    gone = select.matching(funcs.where(~F.col("is_main") & ~F.col("in_macro")), removed, ["path", "func"])
    start = F.col("name_line_off") if config.remove_from_name_line else F.least("name_line_off", "begin")
    end = F.when(F.col("is_def"), F.col("end")).otherwise(F.col("end") + 1)
    bodies = _edit(gone, start, end, "remove", F.lit(""), F.col("ord"))
    comments = gone.where("comment_begin >= 0")
    return bodies.unionByName(_edit(comments, F.col("comment_begin"), F.col("comment_end"), "remove", F.lit(""), F.col("ord")))


def _return_name(funcs: DataFrame, name: Column) -> DataFrame:
    """One (path, callee, ret_type_str, ret_type_kind, stub) per function name: of its first declaration."""
    one = funcs.groupBy("path", F.col("func").alias("callee")).agg(F.min_by(F.struct("ret_type_str", "ret_type_kind"), "ord").alias("r"))
    return one.select("path", "callee", "r.*").withColumn("stub", name)


def _stripped() -> Column:
    return T.strip_name(F.col("ret_type_str"), F.col("ret_type_kind") == "Bool", F.col("ret_type_kind") == "Pointer")


def removed_call_edits(calls: DataFrame, funcs: DataFrame, removed: DataFrame) -> DataFrame:
    """Calls of removed functions, with what replaces them; of nested ones the outermost wins when edits are applied."""
    gone = removed.withColumnRenamed("func", "callee")
    names = select.matching(_return_name(funcs, _stripped()), gone, ["path", "callee"])
    hit = calls.join(names, ["path", "callee"])
    return hit.where("stub <> ''").withColumn("replacement", T.nondet_call(F.col("stub")))


def dead_call_edits(calls: DataFrame, funcs: DataFrame, config: Config, parsed: DataFrame | None = None) -> DataFrame:
    """Calls of functions that the file declares, but neither defines nor calls extern; with ``parsed`` also of those it doesn't declare at
    all (the call declares them, with an int result), the common library's and the stubs' apart."""
    state = funcs.groupBy("path", F.col("func").alias("callee")).agg(F.bool_or("is_def").alias("defined"), F.bool_or(F.col("storage") == "extern").alias("ext"))
    dead = state.where("not defined and not ext").select("path", "callee")
    names = select.matching(_return_name(funcs, _stripped()), dead, ["path", "callee"])
    if parsed is not None:
        called = parsed.select("path", F.explode(F.array_distinct("undeclared")).alias("callee")).where(~F.col("callee").startswith(T.NONDET) & ~F.col("callee").startswith(config.dead_call_prefix))
        int_ = F.lit("int"), F.lit("Int")
        names = names.unionByName(called.select("path", "callee", int_[0].alias("ret_type_str"), int_[1].alias("ret_type_kind"), int_[0].alias("stub")))
    return calls.join(names, ["path", "callee"]).withColumn("replacement", T.dead_call(F.col("stub"), config.dead_call_prefix))


def call_edits(hits: DataFrame) -> DataFrame:
    return _edit(hits, F.col("begin"), F.col("end"), "replace", F.col("replacement"), F.col("node_id"))


def stub_edits(needed: DataFrame, parsed: DataFrame) -> DataFrame:
    """Declarations before the file's first; ``needed``: (path, c_type, stub, ord). Later ones stand first, as each is put before the place.

    Names that the file declares are left out, repeats too."""
    at = parsed.select("path", "first", "names")
    one = needed.groupBy("path", "stub").agg(F.min_by("c_type", "ord").alias("c_type"), F.min("ord").alias("ord"))
    rows = one.join(at, "path").where(~F.array_contains("names", F.concat(F.lit(T.NONDET), F.col("stub"))) & (F.col("first") >= 0))
    return _edit(rows, F.col("first"), F.col("first"), "insert", F.concat(T.stub_declaration(F.col("c_type"), F.col("stub")), F.lit("\n")), -F.col("ord"))


def uncalled(parsed: DataFrame, config: Config) -> DataFrame:
    """Functions, main apart, to which nothing in the file refers, in source order, up to the first that can't be called."""
    refs = nodes(parsed).where("kind = 'DeclRefExpr' and callee <> ''").select("path", F.col("callee").alias("func")).distinct()
    funcs = functions(parsed).where("not is_main")
    if not config.call_redeclarations:
        funcs = funcs.groupBy("path", "func").agg(F.min_by(F.struct(*[c for c in funcs.columns if c not in ("path", "func")]), "ord").alias("x")).select("path", "func", "x.*")
    free = select.missing(funcs, refs, ["path", "func"])
    bad = F.exists("params", lambda p: p["type_kind"].isin("Pointer", "Array"))
    if not config.stop_at_pointer_params:
        return free.where(~bad)
    stop = free.where(bad).groupBy("path").agg(F.min("ord").alias("stop"))
    return free.join(stop, "path", "left").where(F.col("stop").isNull() | (F.col("ord") < F.col("stop"))).drop("stop")


def _param_name(p: Column) -> Column:
    return T.underscore_name(p["type_str"], p["type_kind"] == "Bool", F.lit(False))


def main_edits(parsed: DataFrame, free: DataFrame) -> DataFrame:
    """A main that calls the functions in ``free``: a new one at the end of the file, or the old body with the calls behind it."""
    args = F.array_join(F.transform("params", lambda p: T.nondet_call(_param_name(p))), ", ")
    said = free.select("path", "ord", F.concat("func", F.lit("("), args, F.lit(");")).alias("call"))
    calls = said.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "call"))), lambda x: x["call"]).alias("calls"))
    mains = F.filter("functions", lambda f: f["is_main"] & f["is_def"])
    files = parsed.select("path", F.length("text").alias("size"), F.get(mains, F.lit(0)).alias("m"), F.col("text").rlike(r"\n\z").alias("nl"))
    files = files.join(calls, "path", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
    lines = F.array_join(F.transform("calls", lambda c: F.concat(F.lit("    "), c, F.lit("\n"))), "")
    new = F.concat(F.when(F.col("nl") | (F.col("size") == 0), "").otherwise("\n"), F.lit("int main(void) {\n"), lines, F.lit("    return 0;\n}\n"))
    without = files.where("m is null")
    with_main = files.where("m is not null and size(calls) > 0")
    out = _edit(without, F.col("size"), F.col("size"), "insert", new, F.lit(1 << 30))
    out = out.unionByName(_edit(with_main, F.col("m.body_begin"), F.col("m.body_begin"), "insert", F.lit("{\n"), F.lit(-(1 << 30))))
    return out.unionByName(_edit(with_main, F.col("m.body_end"), F.col("m.body_end"), "insert", F.concat(F.lit("\n"), lines, F.lit("}")), F.lit(1 << 30)))


def apply_to(text: str, edits: list[tuple[int, int, str, int]]) -> str:
    """``text`` with edits (begin, end, new text, seq) of its own offsets; of overlapping ones the outermost, then the first, wins."""
    out, at = [], 0
    size = len(text)
    for begin, end, new, _ in sorted(edits, key=lambda e: (e[0], -e[1] if e[1] > e[0] else -(size + 1), e[3])):
        if begin < at:
            continue
        out += [text[at:begin], new]
        at = max(end, begin)
    return "".join([*out, text[at:]])


def apply_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """``sources`` with their edits applied; files without edits stay. A file's edits are one row, bounded by the file."""
    ship(sources.sparkSession)

    @F.pandas_udf("string")
    def put(text: pd.Series, edits: pd.Series) -> pd.Series:
        return pd.Series([t if e is None or not len(e) else apply_to(t, [(x["begin"], x["end"], x["text"], x["seq"]) for x in e]) for t, e in zip(text, edits)], dtype=object)

    per = edits.groupBy("path").agg(F.collect_list(F.struct("begin", "end", "text", "seq")).alias("__edits"))
    return sources.join(per, "path", "left").withColumn("text", put(F.col("text"), F.col("__edits"))).drop("__edits")
