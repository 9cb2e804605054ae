"""Registered queries of the engine's own operators over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import counters, positional, rules, select

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- files, lines, headers


@query("""SELECT doc_id, loc FROM (SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''))::BIGINT AS loc FROM documents WHERE text IS NOT NULL)
          WHERE loc BETWEEN 2 AND 20""")
def file_loc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return select.passing_files(docs, 2, 20, use_nonstd=True).select("doc_id", "loc")


_LICENSE = r"(?i)\b((?:MIT|Apache|BSD|GNU|Creative Commons|Mozilla)[A-Za-z ]*?(?:License|Public License))"


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
           h AS (SELECT doc_id, CASE WHEN regexp_matches(line, '(?i)\b((?:MIT|Apache|BSD|GNU|Creative Commons|Mozilla)[A-Za-z ]*?(?:License|Public License))')
                  THEN regexp_extract(line, '(?i)\b((?:MIT|Apache|BSD|GNU|Creative Commons|Mozilla)[A-Za-z ]*?(?:License|Public License))', 1) END AS name FROM l)
           SELECT doc_id, count(name) AS mentions, sum(CASE WHEN name IS NOT NULL AND name NOT IN ('MIT License', 'Apache License') THEN 1 ELSE 0 END)::BIGINT AS bad,
                  sum(CASE WHEN name IS NOT NULL AND name NOT IN ('MIT License', 'Apache License') THEN 1 ELSE 0 END) = 0 AS passes
           FROM h GROUP BY doc_id HAVING count(name) > 0""")
def line_allowlist_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = _table(spark, sf_dir, "documents"), F.col("text")
    found = docs.select("doc_id", F.size(T.headers(text, _LICENSE, 1)).cast("long").alias("mentions"), T.foreign_headers(text, ["MIT License", "Apache License"], _LICENSE, 1).cast("long").alias("bad"))
    return found.where("mentions > 0").withColumn("passes", F.col("bad") == 0)


@query(r"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages)
           SELECT page_id, target, target IN ('the', 'of', 'and', 'de', 'la', 'die', 'der') AS allowed FROM l""")
def header_regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select.distinct_values(_table(spark, sf_dir, "pages"), "page_id", F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), "target")
    return found.withColumn("allowed", F.col("target").isin("the", "of", "and", "de", "la", "die", "der"))


@query("""SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_brand = 'Brand#2' AND p_size >= 10 AND floor(p_retailprice) >= 920 ORDER BY p_partkey LIMIT 16""")
def catalog_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _table(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "language", "p_size": "size"}).withColumn("stars", F.floor("p_retailprice"))
    return select.select_repos(catalog, "Brand#2", 10, 920, 15, order_col="p_partkey").select("p_partkey", "p_name", F.col("size").alias("p_size"), "p_retailprice")


# --- counters and thresholds

_KINDS = ["view", "click", "purchase", "signup", "error"]
_COUNTS_SQL = "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in _KINDS) + " FROM events GROUP BY user_id"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.count(_table(spark, sf_dir, "events"), ["user_id"], {f"n_{k}": F.col("event_type") == k for k in _KINDS})


@query(_COUNTS_SQL)
def attr_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query("""SELECT user_id, sum(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END)::BIGINT AS typed, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END)::BIGINT AS typed_once FROM events GROUP BY user_id""")
def attr_counts_typed_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a bag of types: a type that is asked for twice counts twice."""
    n = counters.times_asked(F.col("event_type"), ["view", "view", "click"])
    return counters.count(_table(spark, sf_dir, "events"), ["user_id"], {"typed": n, "typed_once": n > 0})


@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_orderkey")
def distinct_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.distinct_members(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", "n_parts")


_RULES = [rules.Rule(f"max_{k}", f"n_{k}", 20, True) for k in ("click", "view", "error")] + [rules.Rule(f"min_{k}", f"n_{k}", 8, False) for k in ("click", "view", "error")]
_CASE = "CASE " + " ".join(f"WHEN n_{r.column[2:]} {'>' if r.upper else '<'} {r.bound} THEN '{r.name}'" for r in _RULES) + " END"
_VERDICT_SQL = f"WITH c AS ({_COUNTS_SQL}), v AS (SELECT *, {_CASE} AS failed_rule FROM c) SELECT user_id, failed_rule, failed_rule IS NOT NULL AS removed FROM v"


@query(_VERDICT_SQL)
def threshold_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(_counts(spark, sf_dir), _RULES, "user_id", ()).select("user_id", "failed_rule", "removed")


@query(f"SELECT user_id FROM ({_VERDICT_SQL}) WHERE user_id IN (1, 2) OR NOT removed")
def threshold_keep_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(_counts(spark, sf_dir), _RULES, "user_id", (1, 2)).where("not removed").select("user_id")


# --- semi and anti joins, calls, stubs


def _in_debt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def remove_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return select.matching(orders, _in_debt(spark, sf_dir), ["o_custkey"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def keep_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return select.missing(orders, _in_debt(spark, sf_dir), ["o_custkey"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, '__VERIFIER_nondet_' || regexp_replace(p_name, '[ _*]', '', 'g') || '()' AS call_text
          FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5""")
def call_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    calls = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    no = F.lit(False)
    return calls.join(part, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", T.nondet_call(T.strip_name(F.col("p_name"), no, no)).alias("call_text"))


@query("""SELECT p_partkey, regexp_replace(p_name, '[ _*]', '', 'g') AS stripped FROM part
          UNION ALL SELECT -1 - n_nationkey, regexp_replace(n_name, '[ _*]', '', 'g') FROM nation""")
def type_name_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("t"))
    nation = _table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("p_partkey"), F.col("n_name").alias("t"))
    return part.unionByName(nation).select("p_partkey", T.strip_name(F.col("t"), F.lit(False), F.lit(False)).alias("stripped"))


@query("""SELECT p_partkey, regexp_replace(replace(replace(p_name, ' ', '_'), '*', ''), '_$', '') AS underscored FROM part
          UNION ALL SELECT -1 - n_nationkey, regexp_replace(replace(replace(n_name, ' ', '_'), '*', ''), '_$', '') FROM nation""")
def type_name_underscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("t"))
    nation = _table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("p_partkey"), F.col("n_name").alias("t"))
    return part.unionByName(nation).select("p_partkey", T.underscore_name(F.col("t"), F.lit(False), F.lit(False)).alias("underscored"))


@query("""SELECT DISTINCT 'extern ' || p_name || ' __VERIFIER_nondet_' || replace(p_name, ' ', '_') || '(void);' AS declaration FROM part""")
def needed_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(T.stub_declaration(F.col("p_name"), T.underscore_name(F.col("p_name"), F.lit(False), F.lit(False))).alias("declaration"))



@query("""SELECT DISTINCT p_brand AS name FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')""")
def missing_stubs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#3",)], "name string")
    return select.missing(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct(), declared, ["name"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def dead_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return select.missing(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), items, ["o_orderkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def uncalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = _table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return select.missing(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), large, ["c_custkey"])


# --- positional operators over conversations and events


@query("SELECT conv_id, bool_or(role = 'system') AS has_main FROM conversations GROUP BY conv_id")
def has_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.any_of(_table(spark, sf_dir, "conversations"), ["conv_id"], F.col("role") == "system", "has_main")


@query("SELECT conv_id, min_by(text, turn) AS text FROM conversations GROUP BY conv_id")
def first_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.first_by(_table(spark, sf_dir, "conversations"), ["conv_id"], "text", "turn")


@query("""SELECT conv_id, turn, role FROM conversations c WHERE turn < coalesce((SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = 'assistant'), 1000000000)""")
def take_while_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return positional.take_while(rows, ["conv_id"], ["turn"], F.col("role") == "assistant")


@query("""WITH s AS (SELECT conv_id AS sc, turn AS st FROM conversations WHERE role = 'system' ORDER BY conv_id, turn LIMIT 1)
          SELECT conv_id, turn, role FROM conversations, s WHERE conv_id < sc OR (conv_id = sc AND turn < st)""")
def take_while_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return positional.take_while_all(rows, ["conv_id", "turn"], F.col("role") == "system")


@query("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def main_body_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.ordered_text(_table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS signup_id FROM events""")
def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return positional.nearest_preceding(rows, ["user_id"], "ts", F.col("event_type") == "signup", "event_id", "signup_id").select("event_id", "user_id", "signup_id")


_TREE = "(VALUES (1, NULL, 'file', 'a.c'), (2, 1, 'function', 'main'), (3, 2, 'if', ''), (4, 3, 'call', 'f'), (5, 1, 'var', 'g'), (6, 1, 'function', 'f'), (7, 6, 'return', ''), (8, 7, 'ref', 'g')) AS t(id, parent, kind, name)"
_PARENTS = f"""WITH RECURSIVE tree AS (SELECT * FROM {_TREE}),
    up(id, above, func) AS (SELECT id, parent, CASE WHEN kind = 'function' THEN name END FROM tree
        UNION ALL SELECT up.id, tree.parent, CASE WHEN tree.kind = 'function' THEN tree.name END FROM up JOIN tree ON up.above = tree.id WHERE up.func IS NULL)
    SELECT CAST(id AS BIGINT) AS id, coalesce(max(func), 'Program') AS func FROM up GROUP BY id"""


@query(_PARENTS)
def parent_func(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, None, "file", "a.c"), (2, 1, "function", "main"), (3, 2, "if", ""), (4, 3, "call", "f"), (5, 1, "var", "g"), (6, 1, "function", "f"), (7, 6, "return", ""), (8, 7, "ref", "g")]
    tree = spark.createDataFrame(rows, "id long, parent long, kind string, name string")
    return positional.enclosing(tree, "id", "parent", F.col("kind") == "function", "name", "func", "Program")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, p_size = 1 OR p_partkey = 1 AS hit, p_brand FROM part),
           up(id, above, brand) AS (SELECT id, parent, CASE WHEN hit THEN p_brand END FROM p
             UNION ALL SELECT up.id, p.parent, CASE WHEN p.hit THEN p.p_brand END FROM up JOIN p ON up.above = p.id WHERE up.brand IS NULL)
           SELECT id AS p_partkey, coalesce(max(brand), 'none') AS brand FROM up GROUP BY id""")
def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a whole table, a heap of parts."""
    part = _table(spark, sf_dir, "part").withColumn("parent", F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)))
    return positional.enclosing(part, "p_partkey", "parent", (F.col("p_size") == 1) | (F.col("p_partkey") == 1), "p_brand", "brand", "none")


_URL = r"^[a-z]+://[^/]*([^?#]*).*$"


@query(r"""WITH p AS (SELECT list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*([^?#]*).*$', '\1'), '/'), lambda x: x <> '') AS parts FROM pages),
           d AS (SELECT unnest(list_transform(range(1, greatest(len(parts), 1) + 1), lambda n: array_to_string(list_slice(parts, 1, n), '/'))) AS dir FROM p)
           SELECT dir, count(*) AS n FROM d GROUP BY dir""")
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.directory_rollup(_table(spark, sf_dir, "pages"), F.regexp_replace("url", _URL, "$1"), n=F.lit(1))


@query("""SELECT toxic, count(*) AS attempted, count(*) FILTER (WHERE quality = 1) AS succeeded FROM labels GROUP BY toxic""")
def compile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .stages import summary

    return summary(_table(spark, sf_dir, "labels").withColumn("compiles", F.col("quality") == 1), "toxic")


_CONFIG = ["maxIfStmt = 12abc", "useNonStdHeaders=false", "filterDir=filtered-files", "# type = Int", "type=Int string Bool", "minCallFunc = 3", "[Section]", "databaseDir=data/in", "debug = true", "x=-1"]


@query(
    "WITH c AS (SELECT unnest(["
    + ", ".join(f"'{x}'" for x in _CONFIG)
    + r"""]) AS line), m AS (SELECT line, regexp_matches(line, '^\s*(\w+)\s*=\s*([0-9]+|[\w\s,]+|[\w/-_.]+)$') AS hit FROM c),
      k AS (SELECT line, CASE WHEN hit THEN regexp_extract(line, '^\s*(\w+)\s*=\s*([0-9]+|[\w\s,]+|[\w/-_.]+)$', 1) END AS key,
                   CASE WHEN hit THEN regexp_extract(line, '^\s*(\w+)\s*=\s*([0-9]+|[\w\s,]+|[\w/-_.]+)$', 2) END AS value FROM m)
      SELECT line, key, value, CASE WHEN value IN ('true', 'True') THEN 1 WHEN value IN ('false', 'False') THEN 0 ELSE try_cast(regexp_extract(value, '^\s*([+-]?\d+)', 1) AS INTEGER) END AS int_value FROM k"""
)
def config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..config import parse_lines

    return parse_lines(spark.createDataFrame([(x,) for x in _CONFIG], "line string")).select("line", "key", "value", "int_value")


# --- C sources: on embedded files; the expected rows are worked out by hand


def _snippets(spark: SparkSession) -> DataFrame:
    from .snippets import FILES

    return spark.createDataFrame(sorted(FILES.items()), "path string, text string")


def _more(spark: SparkSession) -> DataFrame:
    from .snippets import MORE

    return spark.createDataFrame(sorted(MORE.items()), "path string, text string")


def _text(sql_values: dict[str, str]) -> str:
    """SQL rows (path, text)."""
    return "SELECT * FROM (VALUES " + ", ".join(f"('{path}', '{text.replace(chr(39), chr(39) * 2)}')" for path, text in sorted(sql_values.items())) + ") AS t(path, text)"


def _stage(spark: SparkSession) -> tuple:
    from ..config import parse
    from . import snippets, stages

    config = parse(snippets.CONFIG)
    return stages, config, stages.parse_passing(_snippets(spark), config)


@query("SELECT * FROM (VALUES ('a/keep.c', 25, 0, true), ('a/nomain.c', 17, 0, true), ('b/foreign.c', 4, 1, false), ('b/short.c', 1, 0, false)) AS t(path, loc, nonstd_includes, passes)")
def c_file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.file_stats(_snippets(spark))
    return rows.select("path", F.col("loc").cast("int").alias("loc"), F.col("nonstd_includes").cast("int").alias("nonstd_includes"), (F.col("loc").between(3, 99999) & (F.col("nonstd_includes") == 0)).alias("passes"))


@query("""SELECT * FROM (VALUES ('a/keep.c', 'outside', false, 'Int'), ('a/keep.c', 'flag', true, 'Bool'), ('a/keep.c', 'label', true, 'Pointer'), ('a/keep.c', 'count', true, 'Int'), ('a/keep.c', 'main', true, 'Int'),
          ('a/nomain.c', 'twice', true, 'Int'), ('a/nomain.c', 'half', true, 'Float'), ('a/nomain.c', 'sum', true, 'Int')) AS t(path, func, is_def, ret_type_kind)""")
def c_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import cfront

    _, _, parsed = _stage(spark)
    return cfront.functions(parsed).select("path", "func", "is_def", "ret_type_kind")


_C = "CallFunc ForLoops IfStmt WhileLoops TypeIfStmt TypeArithmeticOperation TypeCompareOperation TypeUnaryOperation TypePrefix TypePostfix TypeVariableReference TypeVariables Functions".split()


@query(f"""SELECT * FROM (VALUES
    ('a/keep.c', 'Program', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 5), ('a/keep.c', 'outside', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0), ('a/keep.c', 'flag', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    ('a/keep.c', 'label', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), ('a/keep.c', 'count', 0, 1, 1, 0, 1, 2, 2, 6, 0, 2, 10, 3, 0), ('a/keep.c', 'main', 5, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0),
    ('a/nomain.c', 'Program', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3), ('a/nomain.c', 'twice', 0, 0, 1, 0, 1, 2, 0, 0, 0, 0, 3, 1, 0), ('a/nomain.c', 'half', 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0),
    ('a/nomain.c', 'sum', 0, 0, 0, 1, 0, 1, 1, 2, 1, 0, 5, 2, 0)) AS t(path, func, {', '.join(_C)})""")
def c_attr_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import cfront

    _, config, parsed = _stage(spark)
    return cfront.func_attrs(parsed, config).select("path", "func", *[F.col(c).cast("int").alias(c) for c in _C])


@query("""SELECT * FROM (VALUES ('a/keep.c', 'Program', NULL), ('a/keep.c', 'outside', 'minTypeArithmeticOperation'), ('a/keep.c', 'flag', 'minTypeArithmeticOperation'), ('a/keep.c', 'label', 'minTypeArithmeticOperation'),
          ('a/keep.c', 'count', NULL), ('a/keep.c', 'main', NULL), ('a/nomain.c', 'Program', NULL), ('a/nomain.c', 'twice', NULL), ('a/nomain.c', 'half', 'minTypeArithmeticOperation'), ('a/nomain.c', 'sum', 'minTypeIfStmt')) AS t(path, func, failed_rule)""")
def c_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages, config, parsed = _stage(spark)
    return stages.function_verdicts(parsed, config).select("path", "func", "failed_rule")


_FILTERED = """#include <stdio.h>
#include <stdbool.h>

extern int __VERIFIER_nondet_int(void);
extern void *__VERIFIER_nondet_pointer(void);
extern _Bool __VERIFIER_nondet_bool(void);
int limit = 3;








int count(int a, unsigned char b) {
  int n = 0;
  if (a + n > limit) {
    n++;
  }
  for (int i = 0; i < a; i++) {
    n += -i;
  }
  return n;
}

int main(void) {
  if (__VERIFIER_nondet_bool()) {
    printf("%s", __VERIFIER_nondet_pointer());
  }
  return count(__VERIFIER_nondet_int(), 1) - 1;
}
"""


_FILTERED2 = """#include <stdlib.h>

int twice(int x) {
  if (x - 1) {
    return x + x;
  }
  return 0;
}




"""


@query(f"SELECT *, 'filteredFiles/' || path AS out_path FROM ({_text({'a/keep.c': _FILTERED, 'a/nomain.c': _FILTERED2})})")
def c_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter's output: functions removed, their calls replaced, stubs declared; files that don't pass are left out."""
    from ..config import parse
    from . import snippets, stages

    return stages.run_filter(_snippets(spark), parse(snippets.CONFIG))


_SYNTH = """#include <stdlib.h>

extern float __VERIFIER_nondet_float(void);
extern int __VERIFIER_nondet_int(void);
int twice(int x) {
  if (x - 1) {
    return x + x;
  }
  return 0;
}

float half(float y, bool z) {
  return z ? y / 2 : -y;
}

int sum(int *v, int n) {
  int s = 0;
  while (n > 0) {
    s = s + v[--n];
  }
  return s;
}
int main(void) {
    twice(__VERIFIER_nondet_int());
    half(__VERIFIER_nondet_float(), __VERIFIER_nondet_bool());
    return 0;
}
"""
_SYNTH = _SYNTH.replace("extern float", "extern _Bool __VERIFIER_nondet_bool(void);\nextern float")


_SYNTH2 = """#include <stdio.h>
#include <stdbool.h>

int limit = 3;

extern int outside(int which);

/* too simple to keep */
bool flag(void) {
  return true;
}

char *label(void) { return "x"; }

int count(int a, unsigned char b) {
  int n = 0;
  if (a + n > limit) {
    n++;
  }
  for (int i = 0; i < a; i++) {
    n += -i;
  }
  return n;
}

int main(void) {
  if (flag()) {
    printf("%s", label());
  }
  return count(outside(2), 1) - 1;
}
"""
_SYNTH4 = """int one;

int main(void) {
    return 0;
}
"""
_ALL_SYNTH = {"a/keep.c": _SYNTH2, "a/nomain.c": _SYNTH, "b/foreign.c": "#include <unistd.h>\nint main(void) {\n  return 0;\n}\n", "b/short.c": _SYNTH4}


@query(f"SELECT *, 'benchmarks/' || path AS out_path, true AS compiles FROM ({_text(_ALL_SYNTH)})")
def c_main_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform's output: main calls what nothing else does, up to the first function with a pointer parameter."""
    stages, config, _ = _stage(spark)
    return stages.run_transform(_snippets(spark), config)


@query("SELECT * FROM (VALUES ('a', 2, 2), ('a/keep.c', 1, 1), ('a/nomain.c', 1, 1)) AS t(dir, attempted, succeeded)")
def c_full_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stages over all files: what compiles, by folder."""
    from ..config import parse
    from . import snippets, stages

    config = parse(snippets.CONFIG)
    config.keep_compiles_only = False
    out = stages.summary_by_directory(stages.run_full(_snippets(spark), config))
    return out.select("dir", F.col("attempted").cast("int").alias("attempted"), F.col("succeeded").cast("int").alias("succeeded"))


@query("SELECT * FROM (VALUES ('c/dead.c', 'stdbool.h', true), ('c/macros.c', 'stdio.h', true), ('c/macros.c', 'types.h', false), ('c/macros.c', 'util.h', false)) AS t(path, header, standard)")
def c_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header names a file includes, each once, and whether the include listener counts them among the standard ones."""
    found, standard = select.header_basenames(_more(spark)), select.standard_headers(_more(spark)).withColumn("standard", F.lit(True))
    return found.join(standard, ["path", "header"], "left").select("path", "header", F.coalesce("standard", F.lit(False)).alias("standard"))


@query("SELECT * FROM (VALUES ('c/macros.c', 'made_one', true, 1), ('c/macros.c', 'plain', false, 0)) AS t(path, func, in_macro, for_loops)")
def c_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditionals decide which functions there are; macros make names and loops."""
    from ..config import parse
    from ..operators import cfront

    parsed = cfront.parse_sources(_more(spark).where("path = 'c/macros.c'"))
    loops = cfront.func_attrs(parsed, parse("type=Int")).select("path", "func", F.col("ForLoops").cast("int").alias("for_loops"))
    return cfront.functions(parsed).select("path", "func", "in_macro").join(loops, ["path", "func"])


_NO_PLAIN = """#include <stdio.h>
#include <sys/types.h>
#include "own/util.h"
#include <stdio.h>
#define SIZE 4
#define EACH(i, n) for (int i = 0; i < (n); i++)
#define NAMED(x) made_##x
#if SIZE > 2
int NAMED(one)(int v) {
  EACH(k, SIZE) {
    v = v + k;
  }
  return v;
}
#else
int never(void) { return 0; }
#endif

"""


@query(_text({"c/macros.c": _NO_PLAIN}))
def c_macro_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both functions fail, the one whose name a macro makes stays."""
    from ..config import parse
    from . import stages

    return stages.run_filter(_more(spark).where("path = 'c/macros.c'"), parse("type=Int\nminIfStmt=1\nuseNonStdHeaders=true")).select("path", "text")


_DEAD = """#include <stdbool.h>
extern unsigned int __VERIFIER_nondet_unsigned_int(void);
extern int __VERIFIER_nondet_int(void);
extern _Bool __VERIFIER_nondet_bool(void);
bool known(int);
extern int outside(int);
unsigned int wide(void);
struct pair { int a; };
struct pair both(void);
int main(void) {
  if (__VERIFIER__non_det_bool()) {
    return __VERIFIER__non_det_int() + outside(3);
  }
  __VERIFIER__non_det_structpair();
  return __VERIFIER__non_det_unsignedint() + 1;
}
"""
_HASMAIN = """extern int __VERIFIER_nondet_int(void);
int spare(int a, int b) {
  return a + b;
}
int used(void) {
  return __VERIFIER_nondet_int();
}
int main(void) {
{
  return used();
}
    spare(__VERIFIER_nondet_int(), __VERIFIER_nondet_int());
}
"""


@query(_text({"c/dead.c": _DEAD, "c/hasmain.c": _HASMAIN}))
def c_dead_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of functions that are declared without a definition, or not at all, get dead-call texts, and stubs for types that can have one;
    a main that is there gets the calls behind its body; a stub that the file declares isn't declared again."""
    from ..config import parse
    from . import stages

    config = parse("")
    config.keep_compiles_only = False
    return stages.run_transform(_more(spark).where("path <> 'c/macros.c'"), config).select("path", "text")


@query("""SELECT * FROM (VALUES ('char', chr(39) || 'a' || chr(39)), ('double', '5.5'), ('float', '5.5'), ('int', '5'), ('long', '5'), ('longlong', '5'), ('short', '5'), ('uint', '5'), ('bool', 'false'), ('pointer', '(void*)(5)'), ('other', NULL)) AS t(stub, value)""")
def c_stub_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concrete stubs' values, looked up by name."""
    names = spark.createDataFrame([(n,) for n, _, _ in T.STUB_VALUES] + [("other",)], "stub string")
    return names.select("stub", T.stub_values(F.col("stub")).alias("value"))


@query("SELECT * FROM (VALUES (1, 'databaseDir'), (2, 'debug'), (3, 'maxIfStmt'), (4, 'minCallFunc'), (5, 'type'), (6, 'useNonStdHeaders')) AS t(place, key)")
def config_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings in the order of their keys."""
    from ..config import ordered, parse_lines

    keys = ordered(parse_lines(spark.createDataFrame([(x,) for x in _CONFIG], "line string"))).toPandas()["key"]
    return spark.createDataFrame([(i + 1, k) for i, k in enumerate(keys)], "place int, key string")


@query("""SELECT p_partkey, p_brand, p_size, p_name FROM part WHERE p_brand = 'Brand#3' AND p_size >= 2 AND floor(p_retailprice) >= 901 ORDER BY p_partkey LIMIT 8""")
def catalog_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue written and read as CSV, and the first repositories of it that qualify."""
    from ..sources.files import read_catalog
    from ..storage import scratch_dir

    path = f"{scratch_dir(spark)}/quarry-catalogue-{uuid.uuid4().hex}"
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("repository"), F.col("p_brand").alias("language"), F.col("p_size").alias("size"), F.floor("p_retailprice").alias("stars"), "p_name")
    part.orderBy(F.col("repository").cast("long")).coalesce(1).write.option("header", True).csv(path)
    found = select.select_repos(read_catalog(spark, path), "Brand#3", 2, 901, 7)
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return found.select(F.col("repository").cast("long").alias("p_partkey"), F.col("language").alias("p_brand"), F.col("size").alias("p_size")).join(part, "p_partkey")


@query("SELECT * FROM (VALUES ('tree/a/keep.c', 25, 0), ('tree/a/nomain.c', 17, 0), ('tree/b/foreign.c', 4, 1), ('tree/b/short.c', 1, 0)) AS t(path, loc, foreign_headers)")
def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written as a tree, found again by a recursive scan."""
    from ..sources import files, sinks
    from ..storage import scratch_dir

    root = f"{scratch_dir(spark)}/quarry-files-{uuid.uuid4().hex}/tree"
    sinks.write_tree(_snippets(spark), root)
    rows = select.file_stats(files.read_sources(spark, root))
    return rows.select("path", F.col("loc").cast("int").alias("loc"), F.col("nonstd_includes").cast("int").alias("foreign_headers"))
