"""Personal data: patterns propose spans, checksums and ranges confirm them, context words adjust a score.

Kinds: email, ip, card (Luhn), phone, and iban (mod-97), which the method adds. Matches are leftmost
and non-overlapping per kind; one that fails its validator is dropped without a retry. Each kept span
has a score: a start value per kind, raised when a telling word stands within ``CONTEXT`` characters
(as far as the neighbouring match of the same kind) and lowered when a misleading one does.

Built-in functions only: no Python runs on the executors. Each text is worked on in its own row, so
nothing is shuffled and no group of copies meets in a task.

Defined results: a null text is an empty text; empty texts have no spans; ``doc_id`` may be null or
repeated, each input row gives one output row; empty input gives an empty result; a long text takes
memory in proportion to itself and its matches; further columns pass through ``detect`` and ``mask``
unread, whatever their names, but for ``spans``, which ``detect`` replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkflow.llm.spans import Rule, label, unused, with_matches

CONTEXT = 40
#: Runs that cannot match are skipped from their first character (lookbehind, possessive runs): the
#: matches are those of the plain patterns, in time linear in the text. A match may begin where the
#: one before it ended, hence \G. Sixteen digits at least are part of the card pattern because a
#: shorter chain of digits holds no longer one.
RULES = [
    Rule("email", "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", needs="@"),
    Rule("ip", "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", needs="."),
    Rule("card", "[0-9](?:[\\x20-]?[0-9]){15,}+"),
    Rule("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", needs="+"),
    Rule("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
]
BASE = ("email", "ip", "card", "phone")
START = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9}
FOR = {"email": "mail|contact|write", "ip": "\\bip\\b|host|server|addr", "card": "card|visa|credit|pay", "phone": "phone|call|tel|fax|mobile", "iban": "iban|bank|account|payee"}
AGAINST = {"email": "example", "ip": "version|release", "card": "order|serial|isbn|track", "phone": "fiction|part no", "iban": "model|serial"}
SPAN = "array<struct<ord:int,start:int,end:int,score:double,kind:string>>"


def luhn(hit: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(hit, "[^0-9]", "")), "")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int"))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(hit: Column) -> Column:
    packed = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(packed, F.lit(5)), F.left(packed, F.lit(4)))
    step = lambda a, c: F.when(c.rlike("[A-Z]"), a * 100 + F.ascii(c) - 55).otherwise(a * 10 + F.ascii(c) - 48) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(x: Column) -> Column:
    hit, n_digits = x["hit"], F.length(F.regexp_replace(x["hit"], "[^0-9]", ""))
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    by_kind = {"ip": hit.rlike(f"^{part}(?:\\.{part}){{3}}$"), "card": F.when(n_digits.between(16, 19), luhn(hit)).otherwise(False), "phone": n_digits.between(8, 15), "iban": F.when(F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34), mod97(hit)).otherwise(False)}
    out = F.lit(True)
    for n, r in enumerate(RULES):
        if r.kind in by_kind:
            out = F.when(x["ord"] == n, by_kind[r.kind]).otherwise(out)
    return out


def _score(x: Column) -> Column:
    around = F.lower(F.concat(x["before"], F.lit("|"), x["hit"], F.lit("|"), x["after"]))
    out = F.lit(0.5)
    for n, r in enumerate(RULES):
        up, down = F.when(around.rlike(FOR[r.kind]), 0.1).otherwise(0.0), F.when(around.rlike(AGAINST[r.kind]), 0.3).otherwise(0.0)
        out = F.when(x["ord"] == n, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(START[r.kind]) + up - down)), 2)).otherwise(out)
    return out


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``spans``, by kind as listed and then start."""
    to = unused(docs, "_matches")
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    found = with_matches(docs, text, RULES, to, context=CONTEXT)
    spans = F.transform(F.filter(to, _valid), lambda x: F.struct(x["ord"].alias("ord"), x["start"].alias("start"), x["end"].alias("end"), _score(x).alias("score"), F.element_at(kinds, x["ord"] + 1).alias("kind")))
    return found.select(*(c for c in docs.columns if c != "spans"), spans.cast(SPAN).alias("spans"))


def mask(docs: DataFrame, text: str = "text", spans: str = "spans", least: float = 0.0) -> DataFrame:
    """``text`` with each run of overlapping spans of at least ``least`` replaced by ``[KIND]`` of its first span.

    A null text stays null.
    """
    s = F.array_sort(F.transform(F.filter(spans, lambda x: x["score"] >= least), lambda x: F.struct(x["start"].alias("start"), F.negative(x["end"]).alias("back"), x["end"].alias("end"), x["kind"].alias("kind"))))
    merged = "array<struct<start:int,end:int,kind:string>>"
    last = lambda a: F.element_at(a, -1)
    one = lambda x: F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    widened = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"), last(a)["kind"].alias("kind"))))
    runs = F.aggregate(s, F.array().cast(merged), lambda a, x: F.when(F.size(a) == 0, one(x)).when(x["start"] < last(a)["end"], widened(a, x)).otherwise(F.concat(a, one(x))))
    name = unused(docs, "_runs")
    with_runs = docs.withColumn(name, runs)
    prior = F.concat(F.array(F.lit(0)), F.transform(name, lambda x: x["end"]))
    t = F.col(text)
    pieces = F.transform(F.arrays_zip(F.col(name).alias("r"), F.slice(prior, F.lit(1), F.size(name)).alias("p")), lambda x: F.concat(F.substr(t, x["p"] + 1, x["r"]["start"] - x["p"]), F.lit("["), F.upper(x["r"]["kind"]), F.lit("]")))
    tail = F.substr(t, last(F.col(name))["end"] + 1)
    return with_runs.withColumn(text, F.when(F.size(name) == 0, t).otherwise(F.concat(F.concat_ws("", pieces), tail))).drop(name)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = detect(docs)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: label(s["kind"], s)))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


_PLAIN = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "ip": "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)",
    "card": "[0-9](?:[\\x20-]?[0-9])+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "iban": "\\b[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}\\b",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_KEEP = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(m, '.'), lambda x: CAST(CASE WHEN length(ltrim(x, '0')) > 3 THEN '999' ELSE x END AS INT))) <= 255",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) > 4 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) * 2 - 9 ELSE CAST(substr(reverse({_DIGITS}), i, 1) AS INT) * 2 END ELSE CAST(substr(reverse({_DIGITS}), i, 1) AS INT) END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
    "iban": """length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: ascii(c))), lambda a, x: CASE WHEN x >= 65 THEN (a * 100 + x - 55) % 97 ELSE (a * 10 + x - 48) % 97 END) = 1""",
}


def _spans_sql(ord_: int, kind: str) -> str:
    return f"""
  SELECT doc_id, '{kind}' AS kind, {ord_} AS ord, s AS start, s + length(m) AS "end" FROM (
    SELECT doc_id, ms[i] AS m,
           CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, $p${_PLAIN[kind]}$p$) AS ms, string_split_regex(t, $p${_PLAIN[kind]}$p$) AS ps
      FROM d WHERE regexp_matches(t, $p${_PLAIN[kind]}$p$)))) WHERE {_KEEP[kind]}"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_spans_sql(n, r.kind) for n, r in enumerate(RULES))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS c_{k}" for k in BASE)},
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY ord, start) FILTER (ord < 4) AS base,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY ord, start) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(c_{k}, 0) AS n_{k}" for k in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
