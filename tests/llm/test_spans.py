"""Secret scans and personal data: brute force over plain patterns, the ledger, and the edges of input."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from chunkflow.llm import pii, scratch, secrets

TEXTS = ["", None, "token=secret=abcdefgh", "password: token: abcdefghij", 'API_KEY="abc.def_123" AKIAABCDEFGHIJKL 0123456789abcdef0123456789abcdef', "é token = 'xxxxxxxx' " * 3, "AKIAAKIA", "a" * 70, "Secret:short passwd=longenough1"]
PERSONAL = ["", None, "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 300.1.1.1 00001.2.3.4", "4111 1111 1111 1111 41111111111111112 4-1", "+1 (017) 555-7713 +12 +1(", "é GB82 WEST 1234 5698 7654 32 GB00WEST12345698765432", "9" * 5000, "a." * 3000 + "@x.y"]


def base_secrets(t):
    out = []
    for kind, pat, ok in (("assign", r"((?a:(?i:password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)):
        out += [(m.start(), len(out), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pat, t) if ok(m)]
    return [s for _, _, s in sorted(out)]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_personal(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t) if ok(m)]


def test_secrets_equal_brute_force(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, TEXTS[4])], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    ledger = scratch.new_path(spark, "test-ledger")
    secrets.scan(spark, docs, ledger)
    got = [(r.doc_id, [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in secrets.BASE]) for r in secrets.findings(spark, docs, ledger).collect()]
    assert sorted(got, key=repr) == sorted([*((i, base_secrets(t or "")) for i, t in enumerate(TEXTS)), (None, base_secrets(TEXTS[4]))], key=repr)


def test_ledger_scans_only_what_is_due(spark):
    ledger = scratch.new_path(spark, "test-ledger")
    rows = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string")
    n = lambda: secrets.read(spark, ledger).count()
    secrets.scan(spark, rows("a", "b", "a"), ledger)
    assert n() == 2
    secrets.scan(spark, rows("a", "c"), ledger)
    assert n() == 3
    secrets.scan(spark, rows("a", "c"), ledger)
    assert n() == 3
    newer = [secrets.Rule("assign", "b+", version=2), *secrets.RULES[1:]]
    secrets.scan(spark, rows("b"), ledger, rules=newer)
    assert secrets.read(spark, ledger).filter("size(ran) = 1 AND ran[0] = 'assign@2'").count() == 1
    empty = rows("a").limit(0)
    other = scratch.new_path(spark, "test-ledger")
    secrets.scan(spark, empty, other)
    assert secrets.findings(spark, empty, other).count() == 0


def test_personal_data_equals_brute_force(spark):
    docs = spark.createDataFrame([*enumerate(PERSONAL), (2, PERSONAL[2])], "doc_id long, text string").withColumn("_blob", F.lit("clash"))
    got = [(r.doc_id, [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind != "iban"]) for r in pii.detect(docs).collect()]
    assert sorted(got) == sorted([*((i, base_personal(t or "")) for i, t in enumerate(PERSONAL)), (2, base_personal(PERSONAL[2]))])
    assert [(s.start, s.end) for r in pii.detect(docs).filter("doc_id = 6").collect() for s in r.spans] == [(2, 29)]
    assert pii.detect(docs.limit(0)).count() == 0


def test_context_moves_scores_and_masks_cover_spans(spark):
    docs = spark.createDataFrame([(1, "call +1 (017) 555-7713 or +1 (018) 555-7713"), (2, None), (3, "card 4111 1111 1111 1111")], "doc_id long, text string")
    found = pii.detect(docs)
    assert [s.score for r in found.filter("doc_id = 1").collect() for s in r.spans] == [0.7, 0.6]
    assert [r.text for r in pii.mask(found).orderBy("doc_id").collect()] == ["call [PHONE] or [PHONE]", None, "card [CARD]"]
    assert pii.mask(found, least=0.65).filter("doc_id = 1").first().text.endswith("or +1 (018) 555-7713")


@pytest.mark.parametrize("op", ["op1_secrets", "op7_pii"])
def test_plans_run_no_python(spark, op):
    from chunkflow.llm.queries import QUERIES

    df = QUERIES[op](spark, "/root/testdata/sf0.001")
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    assert df.filter(F.col("base_sha256") == hashlib.sha256(b"").hexdigest()).count() > 0


def test_findings_are_of_the_versions_asked_for(spark):
    ledger = scratch.new_path(spark, "versions")
    rows = spark.createDataFrame([(1, "aa bbb")], "doc_id long, text string")
    old, new = [secrets.Rule("letters", "a+")], [secrets.Rule("letters", "b+", version=2)]
    spans = lambda rules: [(s.kind, s.start, s.end) for r in secrets.findings(spark, rows, ledger, rules=rules).collect() for s in r.spans]
    secrets.scan(spark, rows, ledger, rules=old)
    secrets.scan(spark, rows, ledger, rules=new)
    assert spans(new) == [("letters", 3, 6)] and spans(old) == [("letters", 0, 2)]
    untagged = secrets.read(spark, ledger).withColumn("spans", F.col("spans").cast("array<struct<kind:string,start:int,end:int,tag:string>>")).withColumn("spans", F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    ledger = scratch.new_path(spark, "untagged")
    untagged.write.parquet(ledger)
    assert spans(new) == [("letters", 0, 2), ("letters", 3, 6)]


def test_a_scan_that_dies_before_its_marker_is_repeated(spark):
    """Rows without the marker are what a driver lost while files move would leave: part of a batch."""
    ledger = scratch.new_path(spark, "killed")
    rows = spark.createDataFrame([(1, "password=abcdefgh1"), (2, "nothing here")], "doc_id long, text string")
    address = secrets.address(rows).select("blob", F.array(*(F.lit(r.tag) for r in secrets.RULES)).alias("ran"), F.array().cast("array<struct<kind:string,start:int,end:int,tag:string>>").alias("spans"))
    address.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{ledger}/batch-dead")
    assert not scratch.exists(spark, f"{ledger}/batch-dead/_SUCCESS") and secrets.read(spark, ledger).count() == 0
    assert secrets.scan(spark, rows, ledger) and not secrets.scan(spark, rows, ledger)
    assert {r.doc_id: len(r.spans) for r in secrets.findings(spark, rows, ledger).collect()} == {1: 1, 2: 0}


def test_many_matches_in_a_long_text_and_columns_of_any_name(spark):
    secret = "".join(f"é{'x' * (i % 7)} token={i:08d}, " for i in range(1500))
    person = "".join(f"{'é' * (i % 5)} a{i}@b.cd or 10.0.{i % 300}.7; " for i in range(1500))
    docs = spark.createDataFrame([(1, secret), (2, person), (3, None)], "doc_id long, text string")
    for name in ("_blob", "_text", "_found", "_fm0", "_matches", "due", "blob", "_runs", "ran", "_s"):
        docs = docs.withColumn(name, F.lit(name))
    ledger = scratch.new_path(spark, "long")
    secrets.scan(spark, docs, ledger)
    got = {r.doc_id: r for r in secrets.findings(spark, docs, ledger).collect()}
    assert [f"{s.kind}:{s.start}:{s.end}" for s in got[1].spans] == base_secrets(secret) and len(got[1].spans) == 1500
    assert got[1]._text == "_text" and got[3].due == "due"
    found = pii.detect(docs)
    got = {r.doc_id: r for r in found.collect()}
    assert [f"{s.kind}:{s.start}:{s.end}" for s in got[2].spans] == base_personal(person) and len(got[2].spans) > 2500
    assert got[2]._blob == "_blob" and got[2]._fm0 == "_fm0" and got[3].blob == "blob"
    masked = {r.doc_id: r for r in pii.mask(found).collect()}
    assert masked[2].text.count("[EMAIL]") == 1500 and masked[3].text is None and masked[2]._runs == "_runs"


def test_the_query_commits_two_batches_and_none_for_a_replay(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(scratch, "new_path", lambda s, n, new=scratch.new_path: kept.append(new(s, n)) or kept[-1])
    out = secrets.op1_secrets(spark, "/root/testdata/sf0.001").collect()
    ledger = next(k for k in kept if "secret-ledger" in k)
    assert len(scratch.committed(spark, ledger)) == 2
    assert secrets.read(spark, ledger).count() == len({r.blob for r in out}) == secrets.read(spark, ledger).select("blob").distinct().count()
