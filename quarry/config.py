"""Settings of the engine: parsing of ``key = value`` texts, as a Python object and as DataFrame expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One setting a line; the class ``[\w/-_.]`` has the range from ``/`` to ``_``, so ``-`` isn't in it. Fixed value.
LINE = r"^\s*(\w+)\s*=\s*([0-9]+|[\w\s,]+|[\w/-_.]+)$"

#: The 16 counters, in the order in which rules name them. Fixed values.
COUNTERS = "CallFunc ForLoops Functions IfStmt Param TypeArithmeticOperation TypeCompareOperation TypeComparisons TypeIfStmt TypeParameters TypePostfix TypePrefix TypeUnaryOperation TypeVariableReference TypeVariables WhileLoops".split()

#: Type words of a configuration and the kinds they ask for. Fixed values.
TYPE_WORDS = {"int": "Int", "Int": "Int", "float": "Float", "Float": "Float", "long": "Long", "Long": "Long", "bool": "Bool", "Bool": "Bool", "char": "UChar", "Char": "UChar"}


def defaults() -> dict[str, int]:
    out = {"debug": 1, "useNonStdHeaders": 0, "minFileLoC": 0, "maxFileLoC": 99999}
    for name in COUNTERS:
        out |= {f"min{name}": 0, f"max{name}": 99999}
    return out


@dataclass
class Config:
    """Settings of the filter and the transform; ``compat`` flags choose between known oddities and what was meant."""

    values: dict[str, int] = field(default_factory=defaults)
    types: list[str] = field(default_factory=list)
    database_dir: str = "database"
    filter_dir: str = "filteredFiles"
    benchmark_dir: str = "benchmarks"
    debug_level: int = 0
    keep_compiles_only: bool = True
    wipe_old_benchmarks: bool = False
    any_type_counts: bool = False  # no type asked for: count nodes of all types
    dead_call_prefix: str = "__VERIFIER__non_det_"  # as written into calls; declarations have __VERIFIER_nondet_
    remove_from_name_line: bool = False  # removal starts at the line of the name, not of the declaration
    call_redeclarations: bool = False  # an unreferenced prototype and its definition are called twice
    stop_at_pointer_params: bool = True  # one function with a pointer parameter ends the list of calls
    unknown_keys: list[str] = field(default_factory=list)

    def __getitem__(self, key: str) -> int:
        return self.values[key]


def _int(value: str) -> int | None:
    m = re.match(r"\s*([+-]?\d+)", value)
    return int(m[1]) if m else None


def parse(text: str | None) -> Config:
    """A configuration from its text; None (no such file) gives the defaults."""
    out = Config()
    for line in (text or "").split("\n"):
        m = re.search(LINE, line, re.ASCII)
        if not m:
            continue
        key, value = m[1], m[2]
        flag = {"false": 0, "False": 0, "true": 1, "True": 1}.get(value)
        if key in out.values:
            got = _int(value) if flag is None else flag
            if got is not None:
                out.values[key] = got
        elif key in ("type", "Type"):
            out.types += [TYPE_WORDS[w] for w in re.findall(r"\w+", value, re.ASCII) if w in TYPE_WORDS]
        elif key == "databaseDir":
            out.database_dir = value
        elif key == "filterDir":
            out.filter_dir = value
        elif key == "benchmarkDir":
            out.benchmark_dir = value
        elif key == "debugLevel":
            out.debug_level = _int(value) or 0
        elif key == "keepCompilesOnly":
            out.keep_compiles_only = flag == 1
        elif key == "wipeOldBenchmarks":
            out.wipe_old_benchmarks = flag == 1
        else:
            out.unknown_keys.append(key)
    return out


def describe(config: Config) -> list[str]:
    """The settings as text, one a line, in the order of their keys; what ``debug`` prints."""
    shown = {**config.values, "type": " ".join(config.types), "databaseDir": config.database_dir, "filterDir": config.filter_dir, "benchmarkDir": config.benchmark_dir, "debugLevel": config.debug_level}
    return [f"{k} = {v}" for k, v in sorted(shown.items())]


def ordered(settings: DataFrame, key: str = "key") -> DataFrame:
    """Settings in the order of their keys."""
    return settings.where(F.col(key).isNotNull()).orderBy(key)


def load(path: str) -> Config:
    try:
        with open(path) as f:
            return parse(f.read())
    except FileNotFoundError:
        return parse(None)


def prefix_int(value: Column) -> Column:
    """The integer a text begins with; null without one."""
    return F.regexp_extract(value, r"^\s*([+-]?\d+)", 1).try_cast("int")


def as_bool(value: Column) -> Column:
    return F.when(value.isin("true", "True"), 1).when(value.isin("false", "False"), 0)


def parse_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Lines with key, value, int_value (booleans as 1 and 0) and types (kinds asked for, repeats kept), null where a line is no setting."""
    line = F.col(line_col)
    hit = line.rlike(LINE)
    out = lines.withColumn("key", F.when(hit, F.regexp_extract(line, LINE, 1))).withColumn("value", F.when(hit, F.regexp_extract(line, LINE, 2)))
    out = out.withColumn("int_value", F.coalesce(as_bool(F.col("value")), prefix_int(F.col("value"))))
    words = F.regexp_extract_all(F.col("value"), F.lit(r"(\w+)"), F.lit(1))
    kinds = F.create_map(*[F.lit(x) for pair in TYPE_WORDS.items() for x in pair])
    return out.withColumn("types", F.when(F.col("key").isin("type", "Type"), F.filter(F.transform(words, lambda w: kinds[w]), lambda k: k.isNotNull())))
