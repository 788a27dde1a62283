"""Secret scans with an incremental ledger of blobs, in DataFrame operations alone.

Every historical version of a file is a row (any columns, ``text``). Its blob is
the SHA-256 of the text. Only pairs of blob and rule version that the ledger, a
table in the shared folder, does not hold yet are scanned, each once; the ledger
grows by them, findings or none. Findings are then joined back to all versions of
all paths with that content.

A finding is a struct (kind, start, end) in code points, end exclusive, ordered by
start, then by the kinds' order. Matches of a kind are the leftmost ones that do
not overlap; those that fail the kind's test are dropped after matching.

Nulls: a null text is empty and has no findings. Repeated rows each keep a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import columns, fresh, looked_up, shared_path, small_enough, table

#: Copies of the findings when they are joined back, so that a blob with very many paths is spread.
SALTS = 32


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    #: A cheap pattern that is found wherever ``pattern`` is.
    hint: str


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12, r"(?i)password|passwd|secret|token|api_?key"),
    # A run of the class that is too short has no longer match inside, so the least length can stand in the pattern.
    Rule("access", r"(AKIA[A-Z0-9]{14,})", 1, 18, "AKIA"),
    Rule("hex", r"([0-9a-f]{16,})", 1, 16, "[0-9a-f]{16}"),
)
RULE_VERSION = "1"
SPANS = "array<struct<kind:string,start:int,end:int>>"


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Findings of one rule: matches and the gaps between them give the places."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(1))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    zipped = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), tested.alias("tested"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.coalesce(F.char_length(x["match"]), F.lit(0))
        one = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = x["match"].isNotNull() & (F.char_length(x["tested"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")
    return F.when(text.rlike(rule.hint), F.aggregate(zipped, start, step, lambda acc: acc["found"])).otherwise(none)


def spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All findings in a text, ordered."""
    text = F.coalesce(text, F.lit(""))
    found = F.array_sort(F.concat(*(rule_spans(text, r, i) for i, r in enumerate(rules))))
    return F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


class BlobLedger:
    """Which blobs were scanned by which rule version, and what was found."""

    SCHEMA = f"blob string, rule_version string, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or shared_path(spark, "secret-ledger")

    def rows(self) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
        """``versions`` with ``blob`` and ``spans``; unseen blobs are scanned and entered first."""
        self.update(versions, rules, rule_version)
        return self.findings(versions, rule_version)

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> None:
        blobs = versions.select(blob_of("text").alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        seen = self.rows().where(F.col("rule_version") == rule_version).select("blob")
        # The partial aggregate leaves one text of a blob in each input partition.
        unseen = blobs.groupBy("blob").agg(F.any_value("text").alias("text")).join(seen, "blob", "left_anti")
        unseen.select("blob", F.lit(rule_version).alias("rule_version"), spans(F.col("text"), rules).alias("spans")).write.mode("append").parquet(self.path)

    def findings(self, versions: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
        """Columns of ``versions`` but its text, ``blob`` and ``spans`` for each row."""
        rows = versions.drop("spans", "blob").withColumn("blob", blob_of("text")).drop("text")
        return self.joined(rows, rule_version)

    def joined(self, rows: DataFrame, rule_version: str = RULE_VERSION, blob: str = "blob", spans: str = "spans") -> DataFrame:
        """``rows`` with the findings ``spans`` of their ``blob``."""
        found = self.rows().where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
        # Runs that overlap may have entered a pair twice, with equal findings.
        found = found.dropDuplicates([blob])
        if small_enough(found, 100 + 24 * F.size(spans)):
            joined = rows.join(F.broadcast(found), blob, "left")
        else:
            joined = looked_up(rows, found, blob, SALTS, by=[c for c, kind in rows.dtypes if kind in ("bigint", "int")])
        return joined.withColumn(spans, F.coalesce(spans, F.expr(f"cast(array() as {SPANS})")))


def blob_of(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def span_string(found: str | Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def redacted(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each run of findings replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(found, start, step)
    return F.when(F.size(found) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame, ledger: BlobLedger, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with each run of findings in ``text`` replaced by ``mark``; a null text stays null."""
    ledger.update(docs.select("text"))
    blob, spans = fresh("__blob", docs), fresh("__spans", docs)
    found = ledger.joined(docs.withColumn(blob, blob_of("text")), blob=blob, spans=spans)
    return found.withColumn("text", F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col(spans), mark))).select(*columns(docs))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in every document, scanned by blob through a fresh ledger."""
    found = BlobLedger(spark).scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in RULES), F.sha2(span_string("spans"), 256).alias("base_sha256"), span_string("spans").alias("spans"))


_MATCH = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _sql_kind(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    return f"""select doc_id, '{kind}' kind, {order} ord, list_sum([length(x) for x in gaps[1:i]])::bigint + coalesce(list_sum([length(x) for x in matches[1:i-1]]), 0)::bigint s, length(matches[i]) n
      from (select *, unnest(range(1, len(matches) + 1)) i from (select doc_id, regexp_extract_all(t, '{pattern}') matches, regexp_extract_all(t, '{pattern}', {group}) tested, string_split_regex(t, '{pattern}') gaps from docs))
      where length(tested[i]) >= {least}"""


OP5_SQL = f"""with docs as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
found as ({_sql_kind("assign", 0, _MATCH, 1, 12)} union all {_sql_kind("access", 1, "AKIA[A-Z0-9]+", 0, 18)} union all {_sql_kind("hex", 2, "[0-9a-f]{16,}", 0, 16)}),
listed as (select doc_id, string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, ord) spans, count(*) filter (ord = 0) a, count(*) filter (ord = 1) b, count(*) filter (ord = 2) c from found group by doc_id)
select d.doc_id, coalesce(a, 0)::bigint n_assign, coalesce(b, 0)::bigint n_access, coalesce(c, 0)::bigint n_hex, sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans
from docs d left join listed using (doc_id)"""
