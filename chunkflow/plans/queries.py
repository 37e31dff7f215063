"""The registered queries and their DuckDB SQL.

Links between nations and the telemetry of links are made from the test tables: a link for every pair of
supplier and customer nations, its metrics from counts of line items and key arithmetic, with a bandwidth
for one in five and none for the others; telemetry from events. Both are inventions for these tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkflow.config import SMALL
from chunkflow.functions import codec, header, scalar
from chunkflow.operators import chunk, dedup, graph, packet, restore
from chunkflow.plans import job
from chunkflow.scratch import Table, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _next(pos: str) -> str:
    a, b, c, n = SMALL.least, SMALL.average, SMALL.greatest, "n"
    end = f"least({n} - {pos}, {c})"
    return f"""CASE WHEN {n} - {pos} <= {a} THEN {n} ELSE coalesce(
      list_min(list_filter(s, lambda i: i >= {pos} + {a} AND i < {pos} + least({b}, {end}))) + 1,
      list_min(list_filter(r, lambda i: i >= {pos} + least({b}, {end}) AND i < {pos} + {end})) + 1, {pos} + {end}) END"""


def chunks_sql(source: str = "SELECT doc_id AS id, text AS t FROM documents") -> str:
    """Common tables up to chunk(id, no, a, b, data, sha) by DuckDB: windowed hash, then a recursive choice."""
    k = SMALL.bits
    terms = " + ".join(["v"] + [f"{1 << j} * lag(v, {j}, 0) OVER w" for j in range(1, k)])
    return f"""WITH RECURSIVE
g AS (SELECT upper(printf('%02x', b)) AS p, CAST(concat('0x', substr(md5(CAST(b AS VARCHAR)), 1, 8)) AS BIGINT) & {(1 << k) - 1} AS v FROM range(256) q(b)),
d AS (SELECT id, hex(encode(t)) AS hx, length(hex(encode(t))) // 2 AS n FROM ({source})),
x AS (SELECT id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS i FROM (SELECT id, regexp_extract_all(hx, '..') AS l FROM d)),
y AS (SELECT id, i, ({terms}) & {(1 << k) - 1} AS h FROM x JOIN g USING (p) WINDOW w AS (PARTITION BY id ORDER BY i)),
z AS (SELECT d.id, any_value(n) AS n, coalesce(list(i ORDER BY i) FILTER (h = 0), []) AS s, coalesce(list(i ORDER BY i) FILTER (h & {(1 << (k - 2)) - 1} = 0), []) AS r
      FROM d JOIN y ON y.id = d.id GROUP BY d.id),
e AS (SELECT id, 0 AS no, CAST(0 AS BIGINT) AS a, CAST({_next('0')} AS BIGINT) AS b, n, s, r FROM z
      UNION ALL SELECT id, no + 1, b, CAST({_next('b')} AS BIGINT), n, s, r FROM e WHERE b < n),
chunk AS (SELECT e.id, no, a, b, substr(hx, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)) AS data, sha256(unhex(substr(hx, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)))) AS sha FROM e JOIN d ON d.id = e.id),
mark AS (SELECT *, row_number() OVER (PARTITION BY id, sha ORDER BY a) > 1 AS dup, row_number() OVER (PARTITION BY sha ORDER BY id, a) > 1 AS dup_all FROM chunk),
sent AS (SELECT *, CASE WHEN dup THEN 2 ELSE 1 END AS kind, CASE WHEN dup THEN 8 ELSE b - a END AS len, row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS seq FROM mark)
"""


PAGES = "SELECT page_id AS id, html AS t FROM pages"
REPORT = """SELECT {by}count(*) AS chunks, count(*) FILTER (NOT {dup}) AS unique_chunks, count(*) FILTER ({dup}) AS duplicate_chunks,
 CAST(sum(b - a) AS BIGINT) AS bytes, CAST(coalesce(sum(b - a) FILTER ({dup}), 0) AS BIGINT) AS duplicate_bytes,
 round(100.0 * count(*) FILTER ({dup}) / count(*), 6) AS duplicate_percent, round(100.0 * coalesce(sum(b - a) FILTER ({dup}), 0) / sum(b - a), 6) AS saved_percent FROM mark """


@query("document_dedup", "SELECT doc_id, sha256(text) AS hash, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents WHERE text IS NOT NULL")
def document_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts that came before."""
    rows = docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.lit(0).alias("offset"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return dedup.mark_duplicates(rows, "doc_id", "global").select("doc_id", "hash", "is_duplicate")


@query("byte_blocks", """SELECT doc_id, CAST(k AS INTEGER) AS block_no, CAST(k * 1024 AS BIGINT) AS "offset", CAST(least(1024, n - k * 1024) AS BIGINT) AS length, sha256(unhex(substr(h, CAST(2048 * k + 1 AS BIGINT), 2048))) AS hash
FROM (SELECT doc_id, hex(encode(text)) AS h, length(hex(encode(text))) // 2 AS n, unnest(range((length(hex(encode(text))) // 2 + 1023) // 1024)) AS k FROM documents)""")
def byte_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk.split_blocks(docs(spark, sf_dir), "doc_id", "text", 1024)
    return out.select("doc_id", "block_no", "offset", "length", dedup.content_hash().alias("hash"))


@query("chunk_candidates", chunks_sql() + "SELECT d.id AS doc_id, coalesce(c.s, 0) AS strict, coalesce(c.r, 0) AS relaxed FROM d LEFT JOIN (SELECT id, count(*) FILTER (h = 0 AND i >= 7) AS s, count(*) FILTER (h & 63 = 0 AND i >= 7) AS r FROM y GROUP BY id) c ON c.id = d.id")
def chunk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.candidates(docs(spark, sf_dir), "doc_id", "text")


@query("chunk_boundaries", chunks_sql() + 'SELECT id AS doc_id, CAST(no AS INTEGER) AS chunk_no, a AS "offset", b - a AS length FROM chunk')
def chunk_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_bytes(docs(spark, sf_dir), "doc_id", "text", data=False)


@query("chunk_size_stats", chunks_sql() + "SELECT count(*) AS chunks, CAST(sum(b - a) AS BIGINT) AS bytes, min(b - a) AS least, max(b - a) AS greatest, round(avg(b - a), 6) AS mean, count(*) FILTER (b - a = 1024) AS at_limit FROM chunk")
def chunk_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk.chunk_bytes(docs(spark, sf_dir), "doc_id", "text", data=False)
    return rows.agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"), F.min("length").alias("least"), F.max("length").alias("greatest"), F.round(F.avg("length"), 6).alias("mean"), F.count_if(F.col("length") == 1024).alias("at_limit"))


def marked(spark: SparkSession, sf_dir: str, data: bool = True) -> DataFrame:
    """Chunks of all documents, repeated ones of each marked in the pass that cuts them."""
    return chunk.chunk_bytes(docs(spark, sf_dir), "doc_id", "text", data=data, hashed=True)


@query("chunk_dup_flags_file", chunks_sql() + 'SELECT id AS doc_id, a AS "offset", sha AS hash, dup AS is_duplicate FROM mark')
def chunk_dup_flags_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir, data=False).select("doc_id", "offset", "hash", "is_duplicate")


@query("chunk_dup_flags_global", chunks_sql() + 'SELECT id AS doc_id, a AS "offset", sha AS hash, dup_all AS is_duplicate FROM mark')
def chunk_dup_flags_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(spark, sf_dir, data=False).select("doc_id", "offset", "hash")
    return dedup.mark_duplicates(rows, "doc_id", "global")


@query("dedup_report", chunks_sql() + REPORT.format(by="", dup="dup_all"))
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.report_by_hash(marked(spark, sf_dir, data=False), "doc_id")


@query("dedup_by_source", chunks_sql() + REPORT.format(by="source, ", dup="dup_all") + "JOIN documents ON doc_id = id GROUP BY source")
def dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup.report_by_hash(chunk.chunk_bytes(rows, "doc_id", "text", data=False, hashed=True, keep=("source",)), "doc_id", "source")


@query("page_dedup_report", chunks_sql(PAGES) + REPORT.format(by="", dup="dup"))
def page_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.report(chunk.chunk_bytes(table(spark, sf_dir, "pages"), "page_id", "html", data=False, hashed=True))


@query("packet_headers", chunks_sql() + """SELECT id AS stream_id, seq, '4854' || printf('%02x', kind) || le(a, 8) || le(len, 4) || le(b - a, 4) AS header FROM sent""".replace("le(a, 8)", "{0}").replace("le(len, 4)", "{1}").replace("le(b - a, 4)", "{2}").format(*("array_to_string(list_reverse(regexp_extract_all(printf('%0{0}x', {1}), '..')), '')".format(2 * w, x) for x, w in (("a", 8), ("len", 4), ("b - a", 4)))))
def packet_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet.encode_packets(marked(spark, sf_dir), "doc_id", "none").select("stream_id", "seq", F.lower(F.hex("header")).alias("header"))


def decoded(spark: SparkSession, sf_dir: str, **options: bool) -> DataFrame:
    return packet.decode_packets(packet.to_streams(packet.encode_packets(marked(spark, sf_dir), "doc_id", "none", **options)))


@query("packet_decode", chunks_sql() + """SELECT id AS stream_id, seq, CAST(kind AS SMALLINT) AS type, a AS "offset", len AS length, b - a AS original_length, 'ok' AS status FROM sent""")
def packet_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir).drop("payload")


#: By stream number modulo 6: how the second packet is spoilt, if there are two. 5: a data packet that calls itself a
#: reference, with a byte more if it holds eight, which would pass for a hash. 0: the first packet announces a byte more
#: than it holds, which is a warning.
FAULTS = {1: "bad_magic", 2: "unknown_type", 3: "truncated_payload", 4: "truncated_header", 5: "bad_dedup_length"}
FAULTS_SQL = """, m AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, first_value(seq) OVER (PARTITION BY id, sha ORDER BY a) AS source, max(CASE WHEN seq = 1 THEN kind END) OVER (PARTITION BY id) AS second FROM sent),
f AS (SELECT *, CASE WHEN n < 2 THEN 'ok' ELSE CASE id % 6 WHEN 1 THEN 'bad_magic' WHEN 2 THEN 'unknown_type' WHEN 3 THEN 'truncated_payload' WHEN 4 THEN 'truncated_header' WHEN 5 THEN CASE WHEN second = 1 THEN 'bad_dedup_length' ELSE 'ok' END ELSE 'ok' END END AS fault FROM m),
got AS (SELECT id, seq, source, CASE WHEN seq = 1 THEN fault ELSE 'ok' END AS status, fault FROM f WHERE seq < 2 OR fault IN ('ok', 'bad_dedup_length'))
"""


def spoilt_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = packet.encode_packets(marked(spark, sf_dir), "doc_id", "none")
    first, second = (F.max(F.when(F.col("seq") == k, F.struct("type", "length", "original_length"))) for k in (0, 1))
    rows = packets.select("stream_id", "seq", "type", "length", "original_length", F.concat("header", "payload").alias("b"))
    streams = rows.groupBy("stream_id").agg(F.expr("listagg(b) WITHIN GROUP (ORDER BY seq)").alias("stream"), first.alias("one"), second.alias("two"))
    h, cut, k = F.hex("stream"), (F.lit(header.SIZE) + F.col("one.length")) * 2, F.when(F.col("two").isNotNull(), F.col("stream_id") % 6)
    part = lambda a, n: F.substr(h, (a + 1).cast("int"), F.lit(n))
    rest = lambda a: F.substr(h, (a + 1).cast("int"))
    before = F.left(h, cut.cast("int"))
    spoilt = F.when(k == 1, F.concat(before, F.lit("0000"), rest(cut + 4)))
    spoilt = spoilt.when(k == 2, F.concat(before, part(cut, 4), F.lit("09"), rest(cut + 6)))
    spoilt = spoilt.when(k == 3, F.left(h, (cut + 2 * header.SIZE).cast("int"))).when(k == 4, F.left(h, (cut + 20).cast("int")))
    longer = F.concat(part(cut + 6, 16), F.lower(header.little(F.lit(9), 4)), part(cut + 30, 24), F.lit("00"), rest(cut + 54))
    after = F.when(F.col("two.length") == 8, longer).otherwise(rest(cut + 6))
    spoilt = spoilt.when((k == 5) & (F.col("two.type") == header.DATA), F.concat(before, part(cut, 4), F.lit("02"), after))
    more = F.concat(F.left(h, F.lit(30)), F.lower(header.little(F.col("one.original_length") + 1, 4)), rest(F.lit(38)))
    return streams.select("stream_id", F.unhex(spoilt.when(k == 0, more).otherwise(h)).alias("stream"))


@query("packet_errors", chunks_sql() + FAULTS_SQL + "SELECT status, count(*) AS packets FROM got GROUP BY status")
def packet_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet.decode_packets(spoilt_streams(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("packets"))


@query("restore_faults", chunks_sql() + FAULTS_SQL + """, r AS (SELECT CASE WHEN fault = 'bad_dedup_length' AND seq > 1 AND source = 1 THEN 'hash_not_found' ELSE status END AS status, CASE WHEN id % 6 = 0 AND seq = 0 AND id IN (SELECT id FROM sent WHERE seq = 1) THEN 'size_mismatch' END AS warning FROM got)
SELECT status, warning, count(*) AS packets FROM r GROUP BY status, warning""")
def restore_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of spoilt streams once references are resolved: what a lost packet held is lost to later references."""
    got = restore.resolve_refs(packet.decode_packets(spoilt_streams(spark, sf_dir)), "none")
    return got.groupBy("status", "warning").agg(F.count("*").alias("packets"))


@query("send_report", chunks_sql() + """, t AS (SELECT CAST(sum(b - a) AS BIGINT) AS bytes, CAST(coalesce(sum(b - a) FILTER (kind = 1), 0) AS BIGINT) AS plain, CAST(sum(len + 19) AS BIGINT) AS wire, count(*) AS n, count(*) FILTER (kind = 2) AS dup FROM sent)
SELECT bytes AS bytes_read, bytes AS bytes_chunked, plain AS bytes_compressed, wire AS bytes_sent, n AS chunks_total, dup AS chunks_duplicate, n - dup AS chunks_unique,
 round(100.0 * plain / bytes, 6) AS compressed_percent, round(100.0 * dup / n, 6) AS duplicate_percent, round(bytes / 1048576.0 / 2.0, 6) AS read_mib_s, round(wire / 1048576.0 / 2.0, 6) AS sent_mib_s FROM t""")
def send_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a sender, for packets that took two seconds."""
    return packet.send_report(packet.encode_packets(marked(spark, sf_dir), "doc_id", "none"), 2.0)


def resolved(spark: SparkSession, sf_dir: str, **options: bool) -> DataFrame:
    return restore.resolve_refs(decoded(spark, sf_dir, **options), "none")


@query("resolve_refs", chunks_sql() + "SELECT id AS stream_id, seq, 'ok' AS status, sha AS hash FROM sent")
def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("stream_id", "seq", "status", dedup.content_hash().alias("hash"))


WHOLE = "SELECT doc_id AS stream_id, sha256(text) AS hash FROM documents WHERE length(text) > 0"


@query("reassemble", WHOLE)
def reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.reassemble(resolved(spark, sf_dir)).select("stream_id", F.sha2("content", 256).alias("hash"))


@query("shuffle_reassemble", WHOLE)
def shuffle_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.reassemble(resolved(spark, sf_dir, uniques_first=True)).select("stream_id", F.sha2("content", 256).alias("hash"))


@query("coverage_gaps", chunks_sql() + """, kept AS (SELECT * FROM sent WHERE no % 3 <> 1), r AS (SELECT id, a, b, coalesce(max(b) OVER (PARTITION BY id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM kept)
SELECT id AS stream_id, 'gap' AS kind, reach AS start, a AS "end" FROM r WHERE a > reach""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk.chunk_bytes(docs(spark, sf_dir), "doc_id", "text").filter("chunk_no % 3 <> 1")
    return restore.coverage(rows.select(F.col("doc_id").alias("stream_id"), F.col("chunk_no").cast("long").alias("seq"), "offset", "data")).withColumn("end", F.col("end").cast("long")).withColumn("start", F.col("start").cast("long"))


@query("running_progress", chunks_sql() + """SELECT id AS stream_id, seq + 1 AS packets, b AS written, b AS furthest FROM sent WHERE (seq + 1) % 10 = 0""")
def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.progress(resolved(spark, sf_dir))


@query("restore_stats", chunks_sql() + """SELECT count(*) AS total_packets, CAST(sum(len) AS BIGINT) AS payload_bytes, CAST(sum(b - a) AS BIGINT) AS written_bytes, max(b) AS file_size, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS warnings FROM sent""")
def restore_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.restore_stats(resolved(spark, sf_dir))


@query("lz4_round_trip", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, true AS same, true AS in_bound FROM documents WHERE length(text) > 0")
def lz4_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).filter("length(text) > 0").select("doc_id", F.col("text").cast("binary").alias("raw"), F.octet_length("text").cast("long").alias("size"))
    back = codec.decompress(codec.compress(rows, "raw"), "compressed", "size", "back")
    return back.select("doc_id", "size", (F.col("raw") == F.col("back")).alias("same"), (F.octet_length("compressed") <= codec.lz4_bound_column(F.col("size"))).alias("in_bound"))


@query("compression_ratio")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes depend on the LZ4 encoder, so there is no SQL."""
    rows = codec.compress(marked(spark, sf_dir).filter(~F.col("is_duplicate")), "data")
    size = F.octet_length("compressed").cast("long")
    return rows.agg(F.sum("length").alias("bytes"), F.sum(size).alias("compressed_bytes"), F.count_if(size < F.col("length")).alias("smaller_chunks"), F.round(scalar.ratio(F.sum(size), F.sum("length")), 6).alias("ratio"))


@query("compression_counts", chunks_sql() + "SELECT count(*) AS chunks, CAST(sum(b - a) AS BIGINT) AS bytes, count(*) AS in_bound, count(*) AS restored FROM sent WHERE kind = 1")
def compression_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks sent: how many blocks are within the codec's bound, and how many decode to what they were."""
    rows = codec.compress(marked(spark, sf_dir).filter(~F.col("is_duplicate")).select("data", "length"), "data")
    back = codec.decompress(rows, "compressed", "length", "back")
    return back.agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"), F.count_if(F.octet_length("compressed") <= codec.lz4_bound_column(F.col("length"))).alias("in_bound"), F.count_if(F.col("data") == F.col("back")).alias("restored"))


@query("xxh3_hash")
def xxh3_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.xxh3(docs(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("raw")), "raw").drop("raw")


@query("send_round_trip", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS source_size, CAST(octet_length(encode(text)) AS BIGINT) AS restored_size, true AS same_size, true AS same_content FROM documents")
def send_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job.round_trip(docs(spark, sf_dir).filter("text IS NOT NULL"), "doc_id", "text").verified


@query("verify_restored", """SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN n END AS source_size, CASE WHEN doc_id % 7 <> 0 THEN n + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) END AS restored_size,
 doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS same_size, doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 AS same_content
FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents WHERE length(text) > 0) WHERE NOT (doc_id % 11 = 0 AND doc_id % 7 = 0)""")
def verify_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restored side with missing, longer and altered files, and files that no source has."""
    rows = docs(spark, sf_dir).filter("length(text) > 0").select("doc_id", F.col("text").alias("content"))
    t = F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("+"))).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\x01"), F.expr("substr(hex(content), 3)"))).otherwise(F.col("content"))
    raw = F.when((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 5 != 0), F.unhex(F.concat(F.lit("01"), F.expr("substr(hex(content), 3)")))).otherwise(t.cast("binary"))
    return restore.verify(rows.filter("doc_id % 11 <> 0"), rows.filter("doc_id % 7 <> 0").select("doc_id", raw.alias("content")), "doc_id")


DEMO = [("GZ", "BJ", 100.0, 50.0, 0.01), ("GZ", "WH", 1000.0, 5.0, 0.0), ("WH", "BJ", 1000.0, 5.0, 0.0)]
LINK = "src string, dst string, bandwidth_mbps double, latency_ms double, packet_loss_rate double"
VALUES = "(VALUES " + ", ".join(f"('{s}', '{d}', CAST({b} AS DOUBLE), CAST({lat} AS DOUBLE), CAST({loss} AS DOUBLE))" for s, d, b, lat, loss in DEMO) + ") demo(src, dst, bandwidth_mbps, latency_ms, packet_loss_rate)"
COST = "CASE WHEN bandwidth_mbps <= 0 OR packet_loss_rate >= 1 THEN CAST('Infinity' AS DOUBLE) WHEN packet_loss_rate > 0 THEN (10000.0 / bandwidth_mbps + latency_ms) * (1.0 / (1.0 - packet_loss_rate)) ELSE 10000.0 / bandwidth_mbps + latency_ms END"
NATION = """nation_links AS (SELECT a.n_name AS src, b.n_name AS dst, CAST(CASE WHEN (x + y) % 9 = 0 OR (x * 7 + y * 11) % 5 <> 0 THEN 0 ELSE 100 + c % 900 END AS DOUBLE) AS bandwidth_mbps, CAST(1 + (x * y) % 50 AS DOUBLE) AS latency_ms, CAST((x + y) % 10 AS DOUBLE) / 100.0 AS packet_loss_rate
FROM (SELECT s_nationkey AS x, c_nationkey AS y, count(*) AS c FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) t
JOIN nation a ON a.n_nationkey = x JOIN nation b ON b.n_nationkey = y)"""


def demo(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEMO, LINK)


def nation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, *c: table(spark, sf_dir, n).select(*c)
    rows = t("lineitem", "l_suppkey", "l_orderkey").join(t("supplier", "s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.join(t("orders", "o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer", "c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    x, y, c = F.col("s_nationkey"), F.col("c_nationkey"), F.col("c")
    pairs = rows.groupBy(x, y).agg(F.count("*").alias("c"))
    a, b = (t("nation", F.col("n_nationkey").alias(k), F.col("n_name").alias(n)) for k, n in (("s_nationkey", "src"), ("c_nationkey", "dst")))
    out = pairs.join(F.broadcast(a), "s_nationkey").join(F.broadcast(b), "c_nationkey")  # 25 nations at any scale
    return out.select("src", "dst", F.when(((x + y) % 9 == 0) | ((x * 7 + y * 11) % 5 != 0), 0).otherwise(100 + c % 900).cast("double").alias("bandwidth_mbps"), (1 + (x * y) % 50).cast("double").alias("latency_ms"), (((x + y) % 10).cast("double") / 100.0).alias("packet_loss_rate"))


def _round(c: str) -> Column:
    return F.round(c, 9).alias(c)


@query("link_cost", f"WITH {NATION} SELECT src, dst, round({COST}, 9) AS cost FROM nation_links")
def link_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_cost(nation_links(spark, sf_dir)).select("src", "dst", _round("cost"))


@query("link_upsert", """SELECT 'n' || user_id % 20 AS src, 'n' || user_id % 7 AS dst, max(event_id) AS version, arg_max(round(value, 6), event_id) AS bandwidth_mbps, arg_max(CAST(event_id % 50 AS DOUBLE), event_id) AS latency_ms, arg_max(CAST(event_id % 100 AS DOUBLE) / 100.0, event_id) AS packet_loss_rate FROM events GROUP BY 1, 2""")
def link_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry in two halves, the second over the first."""
    e = table(spark, sf_dir, "events")
    name = lambda n: F.concat(F.lit("n"), (F.col("user_id") % n).cast("string"))
    rows = e.select(name(20).alias("src"), name(7).alias("dst"), F.col("event_id").alias("version"), F.round("value", 6).alias("bandwidth_mbps"), (F.col("event_id") % 50).cast("double").alias("latency_ms"), ((F.col("event_id") % 100).cast("double") / 100.0).alias("packet_loss_rate"))
    return graph.upsert_links(graph.upsert_links(rows.filter("version % 2 = 0"), rows.limit(0)), rows.filter("version % 2 = 1"))


@query("link_symmetrise", f"WITH {NATION}, u AS (SELECT *, 1 AS own FROM nation_links UNION ALL SELECT dst, src, bandwidth_mbps, latency_ms, packet_loss_rate, 0 FROM nation_links) SELECT src, dst, bandwidth_mbps, latency_ms, packet_loss_rate FROM u QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY own DESC, bandwidth_mbps DESC, latency_ms DESC, packet_loss_rate DESC) = 1")
def link_symmetrise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symmetrise(nation_links(spark, sf_dir))


@query("graph_nodes", f"WITH {NATION} SELECT src AS node FROM nation_links UNION SELECT dst FROM nation_links")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(nation_links(spark, sf_dir))


@query("neighbors", f"WITH {NATION}, n AS (SELECT src AS node FROM nation_links UNION SELECT dst FROM nation_links) SELECT node, dst AS neighbor, round({COST}, 9) AS cost FROM n LEFT JOIN nation_links ON src = node")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(nation_links(spark, sf_dir)).select("node", "neighbor", _round("cost"))


def _paths_sql(links: str, cte: str) -> str:
    """Least paths by (cost, hops, nodes), from the least ones of each number of hops."""
    return f"""WITH RECURSIVE {cte}e AS (SELECT src, dst, {COST} AS w FROM {links} WHERE {COST} < CAST('Infinity' AS DOUBLE)), n AS (SELECT src AS node FROM {links} UNION SELECT dst FROM {links}),
p AS (SELECT 0 AS k, node AS src, node AS dst, {{'c': CAST(0 AS DOUBLE), 'nodes': [node]}} AS m FROM n
 UNION ALL SELECT k + 1, p.src, e.dst, min({{'c': m.c + w, 'nodes': list_append(m.nodes, e.dst)}}) FROM p JOIN e ON e.src = p.dst WHERE k < 24 GROUP BY k, p.src, e.dst),
best AS (SELECT src, dst, b.c AS c, b.k AS k, b.nodes AS nodes FROM (SELECT src, dst, min({{'c': m.c, 'k': k, 'nodes': m.nodes}}) AS b FROM p GROUP BY src, dst))
"""


@query("shortest_path_pair", _paths_sql(VALUES, "") + "SELECT src, dst, array_to_string(nodes, ' ') AS route, c AS total_cost, CAST(k AS INTEGER) AS hops, k > 0 AS is_valid FROM best WHERE src = 'GZ' AND dst = 'BJ'")
def shortest_path_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_path(demo(spark), "GZ", "BJ").select("src", "dst", scalar.route_text(F.col("nodes")).alias("route"), "total_cost", "hops", "is_valid")


@query("shortest_paths_from", _paths_sql("nation_links", NATION + ", ") + "SELECT src, dst, array_to_string(nodes, ' ') AS route, CAST(k AS INTEGER) AS hops, round(c, 9) AS total_cost FROM best")
def shortest_paths_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = Table(nation_links(spark, sf_dir), "nation-links").df
    return graph.shortest_paths(links, graph.nodes(links)).select("src", "dst", scalar.route_text(F.col("nodes")).alias("route"), "hops", _round("total_cost"))


@query("unreachable_pairs", _paths_sql("nation_links", NATION + ", ") + "SELECT l.dst AS src, l.src AS dst, CAST(-1 AS DOUBLE) AS total_cost FROM nation_links l WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.src = l.dst AND best.dst = l.src)")
def unreachable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way back of every link is asked for; those without a path."""
    links = Table(nation_links(spark, sf_dir), "nation-links").df
    asked = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.route(links, asked).filter("total_cost < 0").select("src", "dst", "total_cost")


ASKED = "SELECT n_name AS src, (SELECT b.n_name FROM nation b WHERE b.n_nationkey = (a.n_nationkey * 7 + 3) % 25) AS dst FROM nation a"


@query("nation_routes", _paths_sql("nation_links", NATION + ", ") + f""", q AS ({ASKED})
SELECT q.src, q.dst, CASE WHEN k > 0 THEN array_to_string(nodes, ' ') ELSE q.src || ' ' || q.dst END AS route, CASE WHEN k > 0 THEN array_to_string(nodes[2:-2], ' ') ELSE '' END AS relays, CAST(coalesce(k, 0) AS INTEGER) AS hops, coalesce(k, 0) = 0 AS fallback
FROM q LEFT JOIN best ON best.src = q.src AND best.dst = q.dst""")
def nation_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route asked from every nation: by relays, or the direct one where the links have none."""
    links = Table(nation_links(spark, sf_dir), "nation-links").df
    n = table(spark, sf_dir, "nation")
    to = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("dst"))
    asked = n.select(F.col("n_name").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("k")).join(to, "k").select("src", "dst")
    out = graph.route_or_direct(links, asked)
    return out.select("src", "dst", scalar.route_text(F.col("nodes")).alias("route"), scalar.route_text(scalar.relay_nodes(F.col("nodes"))).alias("relays"), "hops", "fallback")


@query("graph_has_node", f"WITH {NATION}, n AS (SELECT src AS node FROM nation_links UNION SELECT dst FROM nation_links) SELECT DISTINCT r_name || n_name AS node, false AS known FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT n_name, n_name IN (SELECT node FROM n) FROM nation")
def graph_has_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation, and names that no link has."""
    n = table(spark, sf_dir, "nation")
    other = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat("r_name", "n_name").alias("node"))
    return graph.has_node(nation_links(spark, sf_dir), other.union(n.select("n_name")))


REQUESTS = [(1, "ann@GZ", "BJ", "/data/a", None, 2811), (2, "bob@BJ", "GZ", "/data/b", "", 2812), (3, "GZ", "x@y@WH", "/c", "/d", 2811), (4, "nowhere", "GZ", "/e", None, 2811)]
REQUEST = "request_id int, src_host string, dst_host string, file_path string, dst_path string, port int"
REQUESTS_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in REQUESTS) + ") q(request_id, src_host, dst_host, file_path, dst_path, port)"


def plan(spark: SparkSession) -> DataFrame:
    return job.plan_routes(spark.createDataFrame(REQUESTS, REQUEST), demo(spark))


@query("route_with_fallback", "SELECT * FROM (VALUES (1, 'GZ WH BJ', false), (2, 'BJ GZ', true), (3, 'GZ y@WH', true), (4, 'nowhere GZ', true)) t(request_id, route, fallback)")
def route_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark).select("request_id", scalar.route_text(F.col("nodes")).alias("route"), "fallback")


@query("relay_nodes", "SELECT * FROM (VALUES (1, 'WH'), (2, ''), (3, ''), (4, '')) t(request_id, relays)")
def relay_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark).select("request_id", scalar.route_text(F.col("relays")).alias("relays"))


@query("route_urls", f"""SELECT request_id, regexp_replace(src_host, '^[^@]*@', '') AS src, regexp_replace(dst_host, '^[^@]*@', '') AS dst, 'gsiftp://' || regexp_replace(src_host, '^[^@]*@', '') || ':' || port || file_path AS source_url,
 'gsiftp://' || regexp_replace(dst_host, '^[^@]*@', '') || ':' || port || coalesce(nullif(dst_path, ''), file_path) AS target_url FROM {REQUESTS_SQL}""")
def route_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark).select("request_id", "src", "dst", "source_url", "target_url")


@query("header_round_trip", """SELECT doc_id, CAST(1 + doc_id % 2 AS SMALLINT) AS type, doc_id * 1000003 AS "offset", n_chars AS length, n_chars * 3 AS original_length, true AS valid FROM documents""")
def header_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    h = header.encode(1 + F.col("doc_id") % 2, F.col("doc_id") * 1000003, F.col("n_chars"), F.col("n_chars") * 3)
    x = header.decode(h)
    return d.select("doc_id", x.alias("x"), header.valid(x).alias("valid")).select("doc_id", "x.type", "x.offset", "x.length", "x.original_length", "valid")


@query("header_pretty", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'reference' ELSE 'unknown' END || ' offset=' || doc_id * 1000003 || ' length=' || n_chars || ' original=' || n_chars * 3 AS pretty FROM documents""")
def header_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    h = header.encode(1 + F.col("doc_id") % 3, F.col("doc_id") * 1000003, F.col("n_chars"), F.col("n_chars") * 3)
    return d.select("doc_id", header.pretty(header.decode(h)).alias("pretty"))


@query("stream_dedup", "SELECT event_type, min(user_id % 50) AS least, count(DISTINCT user_id % 50) AS users FROM events GROUP BY event_type")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrences of (event_type, user_id % 50) in a stream of events, then their counts."""
    from chunkflow.streaming import flows

    folder = new_path(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    once = flows.first_occurrences(stream.select("event_type", (F.col("user_id") % 50).alias("user")), ["event_type", "user"])
    run = once.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{folder}/rows").groupBy("event_type").agg(F.min("user").alias("least"), F.count("*").alias("users"))


#: Bytes of documents whose packets a file of a packet stream holds.
PER_FILE = 32 << 20


def packet_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A stream of all documents' packets from files in no order, as many as there is content for, read in two batches."""
    size = docs(spark, sf_dir).agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(4, -(-size // PER_FILE))
    decoded(spark, sf_dir, uniques_first=True).repartition(n, F.xxhash64("stream_id", "seq")).write.parquet(f"{folder}/in")
    return spark.readStream.schema(packet.PACKET).option("maxFilesPerTrigger", -(-n // 2)).parquet(f"{folder}/in")


@query("stream_reassemble", WHOLE)
def stream_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded packets as a stream of files in no order, collected by micro-batches and restored."""
    from chunkflow.streaming import flows

    folder = new_path(spark, "stream")
    stream = packet_files(spark, sf_dir, folder)
    flows.collect_packets(stream, f"{folder}/store", f"{folder}/state").awaitTermination()
    return flows.restored(spark, f"{folder}/store", "none").select("stream_id", F.sha2("content", 256).alias("hash"))


@query("stream_resolve", WHOLE)
def stream_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``stream_reassemble``, but references are resolved by state as packets come."""
    from chunkflow.streaming import flows

    folder = new_path(spark, "stream")
    stream = packet_files(spark, sf_dir, folder)
    with flows.state_on_disk(spark):
        run = flows.resolve_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    rows = spark.read.schema(flows.RESOLVED).parquet(f"{folder}/out")
    return restore.reassemble(rows).select("stream_id", F.sha2("content", 256).alias("hash"))
