"""Secret scans by an incremental blob ledger.

Every historical version of every path is content-addressed (SHA-256 of its UTF-8 bytes). The ledger is a
folder of batches with one row a blob: the rule versions that have been run on it and what they found. A
scan runs only the pairs of blob and rule version that no committed batch holds. A batch counts once its
writer has set its marker, the last thing it does: a scan that dies before leaves nothing that is read,
and what it had is due again. Findings join back to all paths.

Built-in functions only: no Python runs on the executors.

Defined results: a null text is the empty blob; a null path is a path like any other; a path that
occurs in several versions or repeated rows gets a row for each; empty input gives an empty result;
a long text takes memory in proportion to itself and its matches; further columns of the input are kept, ones named ``blob``
or ``spans`` replaced; a span written before the ledger held rule versions counts for any version of its rule. A replayed scan finds nothing due and adds no batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkflow.llm import scratch
from chunkflow.llm.scratch import Table
from chunkflow.llm.spans import Rule, label, may_match, with_matches

_WORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: For the leading letters only, either ASCII case.
ASSIGN = f"({'|'.join(map(_either_case, _WORDS))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A run below the least length holds no longer run, so the length can stand in the pattern; not so for ASSIGN.
RULES = [
    Rule("assign", ASSIGN, group=2),
    Rule("access", "AKIA[A-Z0-9]{12,}", needs="AKIA"),
    Rule("hex", "[0-9a-f]{32,}+"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}+", needs="_"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}+", needs="xox"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}+\\.[A-Za-z0-9_-]{10,}+\\.[A-Za-z0-9_-]{10,}+", needs="eyJ"),
]
BASE = ("assign", "access", "hex")
#: Up to so many blobs due (64 bytes each) are sent to all executors; beyond, texts are shuffled to them.
BROADCAST_BLOBS = 200_000
LEDGER = "blob string, ran array<string>, spans array<struct<kind:string,start:int,end:int,tag:string>>"


def _kept(rules: list[Rule], x: Column) -> Column:
    """Whether a match counts: assigned values have at least eight characters."""
    assign = [n for n, r in enumerate(rules) if r.kind == "assign"]
    return ~x["ord"].isin(assign) | (F.length(x["group"]) >= 8) if assign else F.lit(True)


def address(versions: DataFrame, content: str = "text") -> DataFrame:
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256))


def read(spark: SparkSession, ledger: str) -> DataFrame:
    """Rows of all committed batches, and of a ledger that is one batch itself."""
    paths = [f"{ledger}/{n}" for n in scratch.committed(spark, ledger)] + ([ledger] if scratch.exists(spark, f"{ledger}/_SUCCESS") else [])
    return spark.read.schema(LEDGER).parquet(*paths) if paths else spark.createDataFrame([], LEDGER)


def scan(spark: SparkSession, versions: DataFrame, ledger: str, content: str = "text", rules: list[Rule] | None = None) -> bool:
    """Runs the rules that are due on the blobs of ``versions`` and commits one batch to ``ledger``.

    Returns whether anything was due. Texts in which no rule matches never leave their task, but for a
    second scan of more than ``BROADCAST_BLOBS`` blobs, which are shuffled to those due.
    """
    rules = rules or RULES
    tags = F.array(*(F.lit(r.tag) for r in rules))
    texts = address(versions, content).select("blob", F.coalesce(F.col(content), F.lit("")).alias("_text"))
    # A hash a row is shuffled, and copies of a blob are one row before that.
    due = texts.select("blob").distinct()
    if scratch.committed(spark, ledger) or scratch.exists(spark, f"{ledger}/_SUCCESS"):
        ran = read(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("ran"))).alias("_ran"))
        due = due.join(ran, "blob", "left").withColumn("due", F.array_except(tags, F.coalesce("_ran", F.array().cast("array<string>")))).filter(F.size("due") > 0).drop("_ran")
        held = Table(due, "due")
        n = held.df.count()
        if not n:
            held.drop()
            return False
        due = held.df
        texts = texts.join(F.broadcast(due) if n <= BROADCAST_BLOBS else due, "blob")
    else:
        held, due, texts = None, due.withColumn("due", tags), texts.withColumn("due", tags)
    blobs = texts.filter(may_match("_text", rules)).dropDuplicates(["blob"])
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    found = with_matches(blobs, "_text", rules, "_found", due="due")
    span = lambda x: F.struct(F.element_at(kinds, x["ord"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.element_at(tags, x["ord"] + 1).alias("tag"))
    found = found.select("blob", F.transform(F.filter("_found", lambda x: _kept(rules, x)), span).alias("_spans"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,tag:string>>")
    batch = due.join(found, "blob", "left").select("blob", F.col("due").alias("ran"), F.coalesce("_spans", none).alias("spans"))
    batch.write.parquet(f"{ledger}/batch-{uuid.uuid4().hex}")
    if held:
        held.drop()
    return True


def findings(spark: SparkSession, versions: DataFrame, ledger: str, content: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """All columns of ``versions``, ``blob``, and ``spans`` of the rule versions asked for, by start and rule."""
    rules = rules or RULES
    order = {r.kind: n for n, r in enumerate(rules)}
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    # Spans of ledgers from before they held a tag go by kind.
    asked = lambda s: F.when(s["tag"].isNull(), s["kind"].isin(list(order))).otherwise(s["tag"].isin([r.tag for r in rules]))
    wanted = F.transform(F.filter("spans", asked), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))
    rows = read(spark, ledger).select("blob", wanted.alias("s")).filter(F.size("s") > 0)
    by_blob = rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("_spans"))
    # Written first: both sides of the join are then plain exchanges, and the rows of a blob that very many
    # paths have are split among tasks when the plan adapts.
    by_blob = Table(by_blob, "findings").df
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    return address(versions, content).join(by_blob, "blob", "left").withColumn("spans", F.coalesce("_spans", none)).drop("_spans")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scanned as two batches of history; the second is sent again, which must change nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = scratch.new_path(spark, "secret-ledger")
    later = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0, F.lit(False))
    scan(spark, docs.filter(~later), ledger)
    scan(spark, docs, ledger)  # blobs of the first batch are known
    scan(spark, docs.filter(later), ledger)  # nothing is due
    found = findings(spark, docs, ledger)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: label(s["kind"], s)))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), "blob")


def _spans_sql(kind: str, ord_: int, pattern: str, keep: str) -> str:
    return f"""
  SELECT doc_id, '{kind}' AS kind, {ord_} AS ord, s AS start, s + length(m) AS "end" FROM (
    SELECT doc_id, ms[i] AS m, gs[i] AS g,
           CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, $p${pattern}$p$) AS ms, regexp_extract_all(t, $p${pattern}$p$, {2 if kind == 'assign' else 0}) AS gs,
             string_split_regex(t, $p${pattern}$p$) AS ps
      FROM d WHERE regexp_matches(t, $p${pattern}$p$)))) WHERE {keep}"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join([
    _spans_sql("assign", 0, ASSIGN, "length(g) >= 8"), _spans_sql("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 16"), _spans_sql("hex", 2, "[0-9a-f]+", "length(m) >= 32"),
    *(_spans_sql(r.kind, n + 3, r.pattern.replace("}+", "}"), "true") for n, r in enumerate(RULES[3:]))])}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, ord) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN g USING (doc_id)
"""
