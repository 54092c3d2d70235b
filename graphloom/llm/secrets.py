"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is a row (path, text). A blob is a distinct text, addressed by its
SHA-256. The ledger is a folder with one Parquet row for each pair of blob and rule version that
has been scanned, findings included; a scan works only on pairs that are not there yet, appends
them, and findings are then joined back to all paths that hold the blob. A new rule version is
therefore scanned over all blobs, and a new blob with all rules, but no pair twice.

Patterns take time in proportion to a text: what they repeat is possessive, and a run of characters is entered
at its start only. No repeated group may give back what it has taken, as such groups are matched by recursion.

Spans are half-open ranges of code points. All of it is DataFrame functions: a rule's matches come
from regexp_extract_all and the gaps between them from split; the ledger holds the lengths of both, and
sums of these over the matches of a text, taken where findings are asked for, give the places.

Defined cases: a null text is the empty text; empty texts hold no secrets; repeated rows and paths
get the findings of their text; no rows give no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, documents, free, shared_folder

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Of each match, the part that its least length is asked of: what is left after this is cut off.
ASSIGN_HEAD = r"""(?i)^(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` of at least `least` code points after `head` is taken off the front."""

    kind: str
    pattern: str
    version: int = 1
    least: int = 1
    head: str = ""
    hint: str = ""  # a cheap pattern that every text with a match has
    lead: str = ""  # where the secret begins in a match; what is before it is left out

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


BASE = (
    Rule("assign", ASSIGN, least=6, head=ASSIGN_HEAD),
    Rule("access", ACCESS, least=20, hint="AKIA"),
    # runs of 24 or more are the same ranges as all runs without the shorter ones
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
#: What the ledger scans for besides the base kinds.
ADDED = (
    # the whole key: its base64 and header lines, and the end line where there is one
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s++(?:[A-Za-z0-9+/=]{16,}+|[A-Za-z0-9-]++: [^\n]*+|[A-Za-z0-9+/]*+={1,2}+))*+(?:\s*+[A-Za-z0-9+/=]*+\s*+-----END [A-Z ]*PRIVATE KEY-----)?+",
        version=3,
        hint="-----BEGIN ",
    ),
    # from the first eyJ of a run: where that one is no secret, no later one of the run is
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+", version=2, hint="eyJ", lead="eyJ"),
)
#: The same spans by patterns without possessive parts, for SQL and tests.
PLAIN = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s+(?:[A-Za-z0-9+/=]{16,}|[A-Za-z0-9-]+: [^\n]*|[A-Za-z0-9+/]*={1,2}))*(?:\s*[A-Za-z0-9+/=]*\s*-----END [A-Z ]*PRIVATE KEY-----)?",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
}
STEPS = "array<struct<gap:int,size:int,good:boolean>>"
FOUND = "array<struct<start:int,rank:int,kind:string,end:int,covered:int>>"


def steps_of(text: Column, rule: Rule) -> Column:
    """Of each match of a rule, in order, the code points since the one before, its own, and whether it counts. One more, null, closes the text."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)

    def step(gap: Column, match: Column) -> Column:
        part = F.regexp_replace(match, F.lit(rule.head), F.lit("")) if rule.head else match
        before = F.instr(match, rule.lead) - 1 if rule.lead else F.lit(0)
        return F.struct((F.length(gap) + before).alias("gap"), (F.length(match) - before).alias("size"), (F.length(part) >= rule.least).alias("good"))

    likely = text.contains(rule.hint) if rule.hint else F.rlike(text, F.lit(rule.pattern))
    return F.when(likely, F.zip_with(gaps, found, step)).otherwise(F.expr(f"cast(array() as {STEPS})"))


class Ledger:
    """Scanned pairs of blob and rule version in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
        self.batches = 0

    SCHEMA = f"blob string, rule string, kind string, steps {STEPS}"

    def scanned(self) -> DataFrame | None:
        """All rows of the ledger; None before the first scan."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def scan(self, texts: DataFrame, rules: tuple[Rule, ...]) -> int:
        """Scans the pairs of texts(blob, text) and rules that aren't in the ledger, and returns how many batches it has now.

        Each blob moves once however many rows hold it; what is left to scan is found from names.
        """
        known, keys = self.scanned(), F.array(*[F.lit(r.key) for r in rules])
        todo = texts.dropDuplicates(["blob"])
        if known is None:
            todo = todo.withColumn("missing", keys)
        else:
            have = known.filter(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("have"))
            missing = F.array_except(keys, F.coalesce("have", F.array().cast("array<string>")))
            todo = todo.join(have, "blob", "left").withColumn("missing", missing).filter(F.size("missing") > 0)
        each = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), F.when(F.array_contains("missing", r.key), steps_of(F.col("text"), r)).alias("steps")) for r in rules])
        pairs = todo.select("blob", F.explode(each).alias("x")).select("blob", "x.rule", "x.kind", "x.steps").filter(F.col("steps").isNotNull())
        pairs.write.mode("append").option("compression", "zstd").parquet(self.folder)
        self.batches += 1
        return self.batches

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """blob, found: an array of (start, rank, kind, end, covered) by start, then kind as listed. Only blobs with findings.

        covered is where the spans before one end. Windows here see the matches of one text.
        """
        rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
        hits = self.scanned().filter(F.col("rule").isin([r.key for r in rules]) & (F.size("steps") > 0))
        each = hits.select("blob", "kind", F.posexplode("steps").alias("at", "step")).select("blob", "kind", "at", "step.*").filter("size is not null")
        end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("blob", "kind").orderBy("at")).cast("int")
        spans = each.withColumn("end", end).filter("good").select("blob", (F.col("end") - F.col("size")).alias("start"), rank[F.col("kind")].alias("rank"), "kind", "end")
        before = Window.partitionBy("blob").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
        return spans.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "covered"))).alias("found"))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, ledger: Ledger | None = None, text_col: str = "text") -> DataFrame:
    """docs with a last column _found (more underscores if docs has one): the findings in each row's text, an empty array where there are none."""
    ledger = ledger or Ledger(docs.sparkSession)
    name, blob = free(docs, "_found"), free(docs, "_blob")
    text = F.coalesce(column(docs, text_col), F.lit(""))
    ledger.scan(docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")), rules)
    found = ledger.findings(rules).select(F.col("blob").alias(blob), F.col("found").alias(name))
    # Most blobs have no findings, and their rows need not meet any: the others are spread by the name alone.
    return docs.withColumn(blob, F.sha2(text, 256)).join(found, blob, "left").withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {FOUND})"))).drop(blob)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every found span, or run of spans that touch, replaced by a mark."""
    parts = F.transform(found, lambda s: F.when(s["start"] < s["covered"], "").otherwise(F.concat(F.substring(text, s["covered"] + 1, s["start"] - s["covered"]), F.lit(mark))))
    last = F.element_at(found, -1)
    rest = F.substring(text, F.greatest(last["covered"], last["end"]) + 1, F.length(text))
    return F.when(F.size(found) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ledger, rules, text = Ledger(spark), BASE + ADDED, F.coalesce(docs["text"], F.lit(""))
    versions = docs.select("doc_id", F.sha2(text, 256).alias("blob"), text.alias("text"))
    # Two states: rows of even ids came first and were scanned by the base rules; of all rows, the second scan takes new blobs by all rules, old ones by the added ones.
    ledger.scan(versions.filter("doc_id % 2 = 0").drop("doc_id"), BASE)
    ledger.scan(versions.drop("doc_id"), rules)
    # Findings meet the rows by blob name; texts stay behind.
    rows = docs.select("doc_id", F.sha2(text, 256).alias("blob")).join(ledger.findings(rules), "blob", "left")
    found = F.coalesce("found", F.expr(f"cast(array() as {FOUND})"))
    base = F.filter(found, lambda s: s["kind"].isin([r.kind for r in BASE]))

    def n(kind: str) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")

    return rows.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(found).alias("spans"))


QUERIES = {"op8_secret_ledger": op8_secret_ledger}


def _sql() -> str:
    """The same for DuckDB: matches, the gaps between them, and running lengths."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    parts = [f"select doc_id, '{r.kind}' as kind, {i} as rank, {r.least} as least, {quoted(r.head or '^')} as head, regexp_extract_all(text, {quoted(PLAIN.get(r.kind, r.pattern))}, 0) as found, string_split_regex(text, {quoted(PLAIN.get(r.kind, r.pattern))}) as gaps from t" for i, r in enumerate(BASE + ADDED)]
    return f"""with t as (select doc_id, coalesce(text, '') as text from documents), m as ({" union all ".join(parts)}),
  i as (select *, unnest(generate_series(1, len(found))) as k from m),
  p as (select doc_id, kind, rank, found[k] as f, (list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda g: length(g))), 0))::bigint as start from i where length(regexp_replace(found[k], head, '')) >= least),
  g as (select doc_id, count_if(kind = 'assign') as n_assign, count_if(kind = 'access') as n_access, count_if(kind = 'hex') as n_hex, string_agg(kind || ':' || start || ':' || (start + length(f)), ',' order by start, rank) filter (rank < 3) as base, string_agg(kind || ':' || start || ':' || (start + length(f)), ',' order by start, rank) as spans from p group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join g using (doc_id)"""


ORACLES = {"op8_secret_ledger": _sql()}
