"""Column expressions for source texts: lines of code, include directives, type names, stub texts, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headers that a file may include. Fixed values.
STANDARD_HEADERS = [
    "assert.h", "complex.h", "ctype.h", "errno.h", "fenv.h", "float.h", "inttypes.h", "iso646.h", "limits.h", "locale.h", "math.h",
    "setjmp.h", "signal.h", "stdalign.h", "stdarg.h", "stdatomic.h", "stdbit.h", "stdbool.h", "stdckdint.h", "stddef.h", "stdint.h",
    "stdio.h", "stdlib.h", "stdmchar.h", "stdnoreturn.h", "string.h", "tgmath.h", "threads.h", "time.h", "uchar.h", "wchar.h", "wctype.h",
]
#: The file check knows one name more. Fixed value.
ALLOWED_HEADERS = [*STANDARD_HEADERS, "string"]
#: An include directive as the file check sees it. Fixed value.
INCLUDE = r"""#(include|import)\ *[<"]([\w\/0-9\.]*)[">]"""

#: Name, C type and value of the concrete stubs. Fixed values.
STUB_VALUES = [
    ("char", "char", "'a'"), ("double", "double", "5.5"), ("float", "float", "5.5"), ("int", "int", "5"), ("long", "long", "5"), ("longlong", "long long", "5"),
    ("short", "short", "5"), ("uint", "unsigned int", "5"), ("bool", "bool", "false"), ("pointer", "void*", "(void*)(5)"),
]
NONDET, DEAD = "__VERIFIER_nondet_", "__VERIFIER__non_det_"


def stub_definitions() -> str:
    """C source that defines each concrete stub with its value, and a ``reach_error`` that does nothing."""
    lines = [f"{c_type} {NONDET}{name}(void) {{ return {value}; }}" for name, c_type, value in STUB_VALUES]
    return "\n".join(["#include <stdbool.h>", *lines, "void reach_error(void) {}", ""])


def stub_values(stub: Column) -> Column:
    """The value of a concrete stub by its name; null for others."""
    return F.create_map(*[F.lit(x) for name, _, value in STUB_VALUES for x in (name, value)])[stub]


def loc(text: Column) -> Column:
    """Lines that aren't empty; lines of blanks count."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != ""))


def header_of(line: Column, pattern: str = INCLUDE, group: int = 2) -> Column:
    """The header that a line includes (or what ``group`` of another pattern finds in it); null if it includes none."""
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group))


def headers(text: Column, pattern: str = INCLUDE, group: int = 2) -> Column:
    """The headers that a text's lines include, in order."""
    found = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: header_of(x, pattern, group))
    return F.filter(found, lambda h: h.isNotNull())


def foreign_headers(text: Column, allowed: list[str] = ALLOWED_HEADERS, pattern: str = INCLUDE, group: int = 2) -> Column:
    """How many lines include a header that isn't allowed."""
    return F.size(F.filter(headers(text, pattern, group), lambda h: ~h.isin(allowed)))


def strip_name(type_name: Column, is_bool: Column | None = None, is_pointer: Column | None = None) -> Column:
    """A type's name in calls of removed functions: blanks, ``_`` and ``*`` go."""
    plain = F.regexp_replace(type_name, "[ _*]", "")
    return F.when(is_bool if is_bool is not None else type_name.isin("bool", "_Bool"), "bool").when(is_pointer if is_pointer is not None else type_name.endswith("*"), "pointer").otherwise(plain)


def underscore_name(type_name: Column, is_bool: Column | None = None, is_pointer: Column | None = None) -> Column:
    """A type's name in declarations: blanks become ``_``, ``*`` goes, and one ``_`` at the end."""
    plain = F.regexp_replace(F.translate(type_name, " *", "_"), "_$", "")
    return F.when(is_bool if is_bool is not None else type_name.isin("bool", "_Bool"), "bool").when(is_pointer if is_pointer is not None else type_name.endswith("*"), "pointer").otherwise(plain)


def nondet_call(name: Column) -> Column:
    return F.concat(F.lit(NONDET), name, F.lit("()"))


def dead_call(name: Column, prefix: str = DEAD) -> Column:
    return F.concat(F.lit(prefix), name, F.lit("()"))


def stub_declaration(c_type: Column, name: Column) -> Column:
    """``extern <type> __VERIFIER_nondet_<name>(void);``; pointers are all ``void *``."""
    shown = F.when(name == "pointer", "void *").otherwise(F.concat(c_type, F.lit(" ")))
    return F.concat(F.lit("extern "), shown, F.lit(NONDET), name, F.lit("(void);"))


def _relative(path: Column) -> Column:
    """A path without its scheme."""
    return F.regexp_replace(path, "^[a-z][a-z0-9+.-]*:(//[^/]*)?", "")


def filtered_path(path: Column, filter_dir: str, database_dir: str) -> Column:
    """Where the filter writes a file: below ``filter_dir``, without ``..`` (unless that is the database folder)."""
    parts = F.filter(F.split(_relative(path), "/"), lambda x: (x != "") & ((x != "..") | (x == F.lit(database_dir))))
    return F.concat_ws("/", F.lit(filter_dir), F.array_join(parts, "/"))


def benchmark_path(path: Column, benchmark_dir: str, filter_dir: str) -> Column:
    """Where the transform writes a file: below ``benchmark_dir``, without ``..`` and the filter's folder."""
    parts = F.filter(F.split(_relative(path), "/"), lambda x: (x != "") & ~x.isin("..", filter_dir))
    return F.concat_ws("/", F.lit(benchmark_dir), F.array_join(parts, "/"))
