"""Queries on declarations and calls of files in six languages, made from order lines.

Declarations stand over several lines and nest, and comments and strings hold look-alikes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import code
from ..sources import views as v

#: By the order's number: a file's end, its first lines, a declaration for each line of the order, its last lines.
SAMPLES = (
    (".go", "package p\n\n", '''// func hidden() { ghost() }
func (r *R) F@P(
	a map[string]int,
	b ...string,
) (int, error) {
	s := "func no() { (" + `x(`
	g@S(a,
		b)
	return r.h(s), nil
}

type T@P struct {
	f func(int)
}

''', ""),
    (".py", "from . import lib\n\n", '''# def hidden(): ghost()
async def f@P(
    a: Dict[str, int],
    b=")",
) -> int:
    """def no(): x()"""
    def inner@P(c):
        return g@S(c)
    return h(inner@P(a), b)

''', ""),
    (".js", "import x from 'lib';\n", '''/* function hidden() { ghost(); } */
const f@P = async (
  a,
  b = "(",
) => {
  const t = `x ${g@S(a, 1)} y(`;
  return new K(a).h(b);
};

''', ""),
    (".ts", "import { x } from './lib';\n", '''export function f@P<T extends K>(
  a: Map<string, T>,
  b?: number,
): Promise<T> {
  // ghost();
  return this.g@S<T>(a, [b, 2]);
}
interface I@P { m(x: number): void; }

''', ""),
    (".rs", "use lib::x;\n", '''/// fn hidden() {}
pub async fn f@P<'a>(
    a: &'a str,
    b: Vec<(u8, u8)>,
) -> Result<u8, String> {
    println!("{}", ghost(1));
    match a.g@S(b) { Some(x) => h(x), _ => r#"fn no("#.len() }
}

''', ""),
    (".java", "import a.lib.*;\n\nclass C {\n", '''    // void hidden() { ghost(); }
    public static <T> List<T> f@P(
        final Map<String, T> a,
        T... b) throws E {
        this.g@S(a, b);
        return new ArrayList<T>(h(b)) {
            int size() { return k(1); }
        };
    }

''', "}\n"),
)


def sources(spark, d):
    """path, language, text: a file for each order."""
    item = v.table(spark, d, "lineitem")
    kind = (F.col("l_orderkey") % len(SAMPLES)).cast("int") + 1

    def of(k: int) -> Column:
        return F.element_at(F.array(*[F.lit(x[k]) for x in SAMPLES]), kind)

    def bodies(sample: str) -> Column:
        """A sample with the numbers of each of the order's lines in it."""

        def body(line: Column) -> Column:
            at = {"@P": line["l_partkey"].cast("string"), "@S": line["l_suppkey"].cast("string")}
            return F.concat(*[at[x] if x in at else F.lit(x) for x in re.split("(@P|@S)", sample)])

        return F.array_join(F.transform("all", body), "")

    # Only numbers are grouped; texts are made of whole orders.
    whole = item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("all"))
    middle = F.lit("")
    for k, sample in enumerate(SAMPLES):
        middle = F.when(kind == k + 1, bodies(sample[2])).otherwise(middle)
    path = F.concat(F.lit("src/o"), F.col("l_orderkey").cast("string"), of(0))
    return whole.select(path.alias("path"), t.language(path).alias("language"), F.concat(of(1), middle, of(3)).alias("text"))


def scan_functions(spark, d):
    found = code.facts(sources(spark, d), ("function",))["functions"]
    return found.select("path", "name", "receiver", "param_count", "exported", "result", (F.col("end_line") - F.col("line")).alias("lines"), F.substring_index("full_signature", "(", 1).alias("lead"))


def scan_calls(spark, d):
    return code.call_counts(sources(spark, d), "caller", "callee", "receiver", "args")


def scan_types(spark, d):
    found = code.facts(sources(spark, d), ("type", "import"))
    return found["types"].select("path", "name", "kind").unionByName(found["imports"].select("path", F.col("imp").alias("name"), F.lit("import").alias("kind")))


LINES = "(select 'src/o' || l_orderkey || ['.go', '.py', '.js', '.ts', '.rs', '.java'][l_orderkey % 6 + 1] as path, l_orderkey % 6 as k, l_partkey as p, l_suppkey as s from lineitem)"


def _call(caller: str, callee: str, receiver: str, args: int) -> str:
    return f"{{'caller': {caller}, 'callee': {callee}, 'receiver': '{receiver}', 'args': {args}}}"


CALLS = [
    [("'F' || p", "'g' || s", "", 2), ("'F' || p", "'h'", "r", 1)],
    [("'inner' || p", "'g' || s", "", 1), ("'f' || p", "'h'", "", 2), ("'f' || p", "'inner' || p", "", 1)],
    [("'f' || p", "'g' || s", "", 2), ("'f' || p", "'h'", "new K(a)", 1)],
    [("'f' || p", "'g' || s", "this", 3)],
    [("'f' || p", "'g' || s", "a", 1), ("'f' || p", "'h'", "", 1), ("'f' || p", "'len'", 'r#"fn no("#', 0)],
    [("'f' || p", "'g' || s", "this", 2), ("'f' || p", "'g' || s", "this", 2), ("'f' || p", "'h'", "", 1), ("'size'", "'k'", "", 1)],
]
ALL = {
    "scan_functions": (scan_functions, f"""select distinct * from (
      select path, case k when 0 then 'F' else 'f' end || p as name, case k when 0 then '(r *R)' else '' end as receiver, [-1, 2, 2, 3, 3, -1][k + 1] as param_count, true as exported,
        ['(int, error)', 'int', '', 'Promise<T>', 'Result<u8, String>', '<T> List<T>'][k + 1] as result, [8, 7, 6, 6, 6, 7][k + 1] as lines,
        case k when 0 then 'func ' when 1 then 'def f' || p when 4 then 'fn f' || p when 5 then '<T> List<T> f' || p else 'function f' || p end as lead from {LINES}
      union all select path, 'inner' || p, '', 1, true, '', 1, 'def inner' || p from {LINES} where k = 1
      union all select path, 'size', '', 0, true, 'int', 0, 'int size' from {LINES} where k = 5)"""),
    "scan_calls": (scan_calls, f"select path, caller, callee, receiver, args, count(*) as n from (select path, unnest(case k {' '.join(f'when {k} then [{", ".join(_call(*c) for c in calls)}]' for k, calls in enumerate(CALLS))} end, recursive := true) from {LINES}) group by all"),
    "scan_types": (scan_types, f"""select distinct path, case k when 0 then 'T' || p when 3 then 'I' || p else 'C' end as name, case k when 0 then 'struct' when 3 then 'interface' else 'class' end as kind from {LINES} where k in (0, 3, 5)
      union all select distinct path, [null, '.', 'lib', './lib', 'lib::x', 'a.lib'][k + 1], 'import' from {LINES} where k > 0"""),
}
QUERIES = {name: q for name, (q, _) in ALL.items()}
ORACLES = {name: s for name, (_, s) in ALL.items()}
