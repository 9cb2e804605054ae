"""The two stages, filter and transform, and both in one plan; summaries of what compiles.

Defined results: of rows that repeat a path the one with the smallest text counts, rows with a null path and files with a null text are left out; empty tables
give no rows; other columns aren't read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..functions.cparse import LIBC
from ..operators import cfront, rules, select
from ..operators.positional import directory_rollup
from ..sources import sinks
from ..storage import save

_STUBS = [f"{T.NONDET}{name}" for name, _, _ in T.STUB_VALUES]


def parse_passing(sources: DataFrame, config: Config) -> DataFrame:
    """Files that pass the file predicate, parsed once into a table; the cheap predicate stands before the costly parser."""
    files = select.passing_files(sources, config["minFileLoC"], config["maxFileLoC"], bool(config["useNonStdHeaders"]))
    return save(cfront.parse_sources(one_per_path(files)), "parsed")


def one_per_path(sources: DataFrame) -> DataFrame:
    """(path, text), each path once. Only paths are shuffled unless one repeats."""
    rows = sources.select("path", "text").where("path is not null")
    if rows.groupBy("path").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("path").agg(F.min("text").alias("text"))


def function_verdicts(parsed: DataFrame, config: Config) -> DataFrame:
    return rules.verdicts(cfront.func_attrs(parsed, config), rules.config_rules(config))


def filter_edits(parsed: DataFrame, config: Config) -> DataFrame:
    """What the filter changes: removed functions, calls of them, stubs of their types."""
    removed = function_verdicts(parsed, config).where("removed").select("path", "func")
    funcs, calls = cfront.functions(parsed), cfront.nodes(parsed).where("kind = 'CallExpr' and callee <> ''")
    hits = cfront.removed_call_edits(calls, funcs, removed)
    needed = hits.select("path", F.when(F.col("ret_type_kind") == "Pointer", "void *").when(F.col("ret_type_kind") == "Bool", "_Bool").otherwise(F.col("ret_type_str")).alias("c_type"), "stub", F.col("node_id").alias("ord"))
    return cfront.removal_edits(funcs, removed, config).unionByName(cfront.call_edits(hits)).unionByName(cfront.stub_edits(needed, parsed))


def run_filter(sources: DataFrame, config: Config, parsed: DataFrame | None = None) -> DataFrame:
    """(path, text, out_path) of the passing files after filtering. ``parsed`` may be given where the caller keeps it."""
    parsed = parse_passing(sources, config) if parsed is None else parsed
    out = cfront.apply_edits(parsed.select("path", "text"), filter_edits(parsed, config))
    return out.withColumn("out_path", T.filtered_path(F.col("path"), config.filter_dir, config.database_dir))


def transform_edits(parsed: DataFrame, config: Config) -> DataFrame:
    """What the transform changes: dead calls, stubs, main."""
    funcs, calls = cfront.functions(parsed), cfront.nodes(parsed).where("kind = 'CallExpr' and callee <> ''")
    dead = cfront.dead_call_edits(calls, funcs, config, parsed)
    stubbed = dead.where(~F.col("ret_type_kind").isin("Void", "Record", "Unknown", "Array", "Function"))
    under = T.underscore_name(F.col("ret_type_str"), F.col("ret_type_kind") == "Bool", F.col("ret_type_kind") == "Pointer")
    c_type = F.when(F.col("ret_type_kind") == "Pointer", "void *").when(F.col("ret_type_kind") == "Bool", "_Bool").otherwise(F.col("ret_type_str"))
    needed = stubbed.select("path", c_type.alias("c_type"), under.alias("stub"), F.col("node_id").alias("ord"))
    free = cfront.uncalled(parsed, config)
    params = free.select("path", F.col("ord"), F.posexplode("params").alias("i", "p"))
    name = T.underscore_name(F.col("p.type_str"), F.col("p.type_kind") == "Bool", F.lit(False))
    for_args = params.select("path", F.when(F.col("p.type_kind") == "Bool", "_Bool").otherwise(F.col("p.type_str")).alias("c_type"), name.alias("stub"), (F.lit(1 << 20) + F.col("ord") * 64 + F.col("i")).cast("int").alias("ord"))
    stubs = cfront.stub_edits(needed.unionByName(for_args), parsed)
    return cfront.call_edits(dead).unionByName(stubs).unionByName(cfront.main_edits(parsed, free))


def compiles(outputs: DataFrame) -> DataFrame:
    """``outputs`` with ``compiles``: they parse without errors and call only what is declared, standard or a stub."""
    known = F.array(*[F.lit(x) for x in [*LIBC, *_STUBS]])
    again = cfront.parse_sources(outputs.select("path", "text"))
    flags = again.select("path", ((F.col("n_errors") == 0) & (F.size(F.array_except("undeclared", known)) == 0)).alias("compiles"))
    return outputs.join(flags, "path")


def run_transform(filtered: DataFrame, config: Config) -> DataFrame:
    """(path, text, out_path, compiles) of the transformed files; those that don't compile only if they are kept."""
    sources = one_per_path(filtered.where("text is not null"))
    parsed = save(cfront.parse_sources(sources), "parsed")
    out = compiles(save(cfront.apply_edits(parsed.select("path", "text"), transform_edits(parsed, config)), "transformed"))
    out = out.withColumn("out_path", T.benchmark_path(F.col("path"), config.benchmark_dir, config.filter_dir))
    return out.where("compiles") if config.keep_compiles_only else out


def write_outputs(outputs: DataFrame, root: str, config: Config) -> None:
    """Writes files below ``root`` at their out_path; the benchmark folder is emptied first if the configuration asks for that."""
    if config.wipe_old_benchmarks:
        sinks.wipe(f"{root.rstrip('/')}/{config.benchmark_dir}")
    sinks.write_tree(outputs, root)


def run_full(sources: DataFrame, config: Config) -> DataFrame:
    """Filter, then transform; between them stand only intermediate tables."""
    return run_transform(run_filter(sources, config), config)


def summary(outputs: DataFrame, *keys: str) -> DataFrame:
    """attempted, succeeded; of all outputs or by key."""
    return outputs.groupBy(*keys).agg(F.count("*").alias("attempted"), F.count_if("compiles").alias("succeeded"))


def summary_by_directory(outputs: DataFrame) -> DataFrame:
    return directory_rollup(outputs, F.col("path"), attempted=F.lit(1), succeeded=F.col("compiles").cast("int"))


def attribute_report(parsed: DataFrame, config: Config) -> DataFrame:
    """One line per function and counter, in order: what a report of the attributes prints."""
    attrs = cfront.func_attrs(parsed, config)
    names = [c for c in attrs.columns if c not in ("path", "func")]
    return attrs.unpivot(["path", "func"], names, "counter", "value")


def regenerate(parsed: DataFrame) -> DataFrame:
    """(path, text): file-scope functions in source order, stub prototypes left out."""
    funcs = cfront.functions(parsed).where(~(F.col("func").startswith(T.NONDET) & (F.col("storage") == "extern")))
    rows = funcs.join(parsed.select("path", F.col("text").alias("source")), "path")
    part = F.concat(F.substring("source", F.col("begin") + 1, F.col("end") - F.col("begin")), F.when(F.col("is_def"), "").otherwise(";"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
