"""Queries of operators that run Python in Arrow batches, and of reading evaluation."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork import fixtures
from cloakwork.functions import text
from cloakwork.operators import audit, corpus, crypto, ocr, scoring, tokens
from cloakwork.operators.detect import detect_spans, mask_text
from cloakwork.operators.registry import REGISTRY, TYPES, VERTICALS, entities_for_vertical
from cloakwork.plans.deid import DeidPlan, pseudonymize
from cloakwork.queries import _IPS, query, table

_ALL = [t for t in TYPES if t != "AMOUNT"]


def _fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.TEXTS, "doc_id bigint, text string")


@query(fixtures.values(fixtures.EXPECTED, "doc_id, type, raw"))
def detect_fixture(spark, sf_dir):
    """All types over invented texts."""
    s = _fixture(spark).select("doc_id", F.explode(detect_spans(F.col("text"), _ALL)).alias("s"))
    return s.select(F.col("doc_id").cast("int").alias("doc_id"), "s.type", F.trim("s.raw").alias("raw"))


@query(fixtures.values([*fixtures.EXPECTED, *fixtures.SPREAD], "doc_id, type, raw"))
def component_plan(spark, sf_dir):
    """F, G1, G2, G4 on top of detection: the component preset."""
    plan = DeidPlan(tuple(_ALL), "component")
    return plan.spans(_fixture(spark)).select(F.col("doc_id").cast("int").alias("doc_id"), "type", F.trim("raw").alias("raw"))


@query(f"""
WITH e AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '{text.EMAIL}'), lambda x: regexp_matches(x, '\\.[A-Za-z]{{2,}}$'))) AS raw FROM documents)
SELECT doc_id, raw FROM e""")
def detect_emails(spark, sf_dir):
    """C9 by the Arrow function over all documents, against the SQL twin; a native test spares texts without the sign."""
    d = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@")))
    return d.select("doc_id", F.explode(detect_spans(F.col("text"), ["EMAIL"])).alias("s")).select("doc_id", "s.raw")


@query(f"SELECT doc_id, unnest({_IPS}) AS raw FROM documents")
def detect_ips(spark, sf_dir):
    """C13 by the Arrow function over all documents."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"[0-9]\.[0-9]"))
    return d.select("doc_id", F.explode(detect_spans(F.col("text"), ["IP"])).alias("s")).select("doc_id", "s.raw")


@query(f"""SELECT doc_id, sha256(regexp_replace(text, '{text.IPV4}', '[IP]', 'g')) AS digest FROM documents WHERE len({_IPS}) > 0 AND len({_IPS}) = len(regexp_extract_all(text, '{text.IPV4}'))""")
def mask_ips(spark, sf_dir):
    """E3, E4 by spans."""
    d = table(spark, sf_dir, "documents").filter((F.size(text.ipv4s(F.col("text"))) > 0) & (F.size(text.ipv4s(F.col("text"))) == F.size(F.regexp_extract_all("text", F.lit(text.IPV4), F.lit(0)))))
    return d.select("doc_id", F.sha2(mask_text(F.col("text"), ["IP"]).cast("binary"), 256).alias("digest"))


@query()
def pseudonymize_documents(spark, sf_dir):
    """Spans, tokens, redacted texts, receipts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = DeidPlan(("EMAIL", "IP", "PHONE", "DATE"), "gate")
    spans = plan.spans(d.filter(F.col("text").rlike("[@0-9]")), scope=F.col("source")).persist(StorageLevel.DISK_ONLY)
    redacted, _ = pseudonymize(d, spans)
    return tokens.receipts(redacted)


@query(fixtures.values([(v, t) for v in VERTICALS for t in entities_for_vertical(v)], "vertical, type"))
def vertical_types(spark, sf_dir):
    """Types of a vertical, as a filter over the registry."""
    r = spark.createDataFrame([(d.type, list(d.verticals), d.default_on, list(d.not_in)) for d in REGISTRY], "type string, verticals array<string>, default_on boolean, not_in array<string>")
    v = spark.createDataFrame([(x,) for x in VERTICALS], "vertical string")
    on = F.col("default_on") & ~F.expr("array_contains(not_in, vertical)") & (F.expr("array_contains(verticals, vertical)") | F.array_contains("verticals", "common"))
    return v.join(F.broadcast(r), on).select("vertical", "type")


@query("""SELECT c_custkey, c_name AS raw FROM customer""")
def sealed_vault_round_trip(spark, sf_dir):
    """Rows sealed under a key of their own and opened again."""
    v = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).cast("string").alias("scope"), F.concat(F.lit("[PER_"), F.col("c_custkey").cast("string"), F.lit("]")).alias("token"), F.lit("PER").alias("type"), F.col("c_name").alias("raw"), "c_custkey")
    kek = bytes(range(32))
    return crypto.open_rows(crypto.seal_rows(v, kek), kek, "raw string, c_custkey bigint").select("c_custkey", "raw")


@query("""SELECT user_id::VARCHAR AS chain, count(*) AS records FROM events GROUP BY user_id""")
def hash_chain_build(spark, sf_dir):
    """Records of each chain, built in order."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("chain"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.concat_ws(":", "event_id", "event_type").alias("entry"))
    return audit.build_chains(e).groupBy("chain").agg(F.count(F.lit(1)).alias("records"))


@query("""
WITH c AS (SELECT page_id, url FROM pages)
SELECT 'curl ' || url AS command, CASE WHEN NOT (regexp_extract(url, '^https?://([^/:?#]+)', 1) = 'example.com' OR ends_with(regexp_extract(url, '^https?://([^/:?#]+)', 1), '.example.com')) THEN regexp_extract(url, '^https?://([^/:?#]+)', 1) END AS blocked_host FROM c""")
def shell_egress(spark, sf_dir):
    """J22 over commands."""
    return audit.blocked_hosts(table(spark, sf_dir, "pages").select(F.concat(F.lit("curl "), "url").alias("command")), ["example.com"])


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'image' ELSE 'text' END AS kind, event_id % 5 = 0 OR event_id % 7 = 0 AS scan FROM events""")
def scan_barrier(spark, sf_dir):
    """J13."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "image").otherwise("text").alias("kind"), F.when(F.col("event_id") % 7 != 0, F.lit("x")).alias("text"), F.lit(b"x").alias("bytes"))
    return e.select("event_id", "kind", audit.is_scan(F.col("kind"), F.col("text"), F.col("bytes")).alias("scan"))


# --- scoring and cutting -----------------------------------------------------------------------------


@query()
def chunk_documents(spark, sf_dir):
    """Chunks at line ends."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(scoring.chunked(F.col("text"))).alias("c"))
    return d.select("doc_id", "c.offset", F.char_length("c.text").alias("chars"))


@query("""
WITH g AS (SELECT l_orderkey AS doc_id, 'N' AS type, (l_linenumber * 100)::INT AS s, (l_linenumber * 100 + 50)::INT AS e FROM lineitem), f AS (SELECT l_orderkey AS doc_id, (l_linenumber * 90)::INT AS s, (l_linenumber * 90 + 20)::INT AS e FROM lineitem WHERE l_quantity > 25)
SELECT g.doc_id, g.type, g.s AS start, g.e AS "end", bool_or(f.doc_id IS NOT NULL) AS found FROM g LEFT JOIN f ON g.doc_id = f.doc_id AND g.s < f.e AND f.s < g.e GROUP BY ALL""")
def observation_rows(spark, sf_dir):
    """Found or not, per gold span."""
    li = table(spark, sf_dir, "lineitem")
    g = li.select(F.col("l_orderkey").alias("doc_id"), F.lit("N").alias("type"), (F.col("l_linenumber") * 100).cast("int").alias("start"), (F.col("l_linenumber") * 100 + 50).cast("int").alias("end"))
    f = li.filter("l_quantity > 25").select(F.col("l_orderkey").alias("doc_id"), F.lit("N").alias("type"), (F.col("l_linenumber") * 90).cast("int").alias("start"), (F.col("l_linenumber") * 90 + 20).cast("int").alias("end"))
    return scoring.observations(g, f)


@query("""
WITH g AS (SELECT o_orderkey AS c, o_custkey % 50 AS s FROM orders), m AS (SELECT l_orderkey AS c, (l_suppkey % 50) AS s, l_discount * 10 AS score FROM lineitem),
b AS (SELECT g.c, max(CASE WHEN m.s <= g.s AND g.s + 10 <= m.s + 20 THEN score END) AS best FROM g LEFT JOIN m USING (c) GROUP BY g.c), t AS (SELECT unnest([0.2::DOUBLE, 0.5, 0.8]) AS threshold)
SELECT threshold, avg((coalesce(best, -1) >= threshold)::INT) AS covered FROM b, t GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    """L23c."""
    g = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"), F.lit("N").alias("type"), (F.col("o_custkey") % 50).alias("start"), (F.col("o_custkey") % 50 + 10).alias("end"))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.lit("N").alias("type"), (F.col("l_suppkey") % 50).alias("start"), (F.col("l_suppkey") % 50 + 20).alias("end"), (F.col("l_discount") * 10).alias("score"))
    return scoring.threshold_sweep(g, m.limit(0).drop("score"), m, [0.2, 0.5, 0.8])


@query("""
SELECT event_type AS type, user_id % 20 AS value, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM events k WHERE k.event_id < 50 AND k.event_type = e.event_type AND k.user_id % 20 = e.user_id % 20) GROUP BY 1, 2""")
def adjudication_items(spark, sf_dir):
    """What still needs a verdict."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), (F.col("user_id") % 20).alias("value"), F.col("props").alias("context"))
    return scoring.adjudication_items(e, e.filter("event_id < 50")).select("type", "value", "n")


@query("""SELECT event_id % 300 AS doc_id, (event_id % 7)::INT AS start, (event_id % 7 + 5)::INT AS "end", event_type AS label, max(value / 100) AS score, CASE WHEN max(value / 100) >= 0.7 THEN 'high' ELSE 'medium' END AS confidence FROM events GROUP BY 1, 2, 3, 4""")
def window_dedup(spark, sf_dir):
    """K3, K4: spans of overlapping windows, the best score of each, and its confidence."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 300).alias("doc_id"), (F.col("event_id") % 7).cast("int").alias("start"), (F.col("event_id") % 7 + 5).cast("int").alias("end"), F.col("event_type").alias("label"), (F.col("value") / 100).alias("score"))
    return scoring.model_spans(e)


# --- reading evaluation ------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'depth' WHEN 1 THEN 'percent' WHEN 2 THEN 'year' ELSE 'note' END AS field, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE (value::INT + CASE WHEN event_id % 4 = 2 THEN 1880 ELSE 0 END)::VARCHAR END AS value FROM events)
SELECT event_id, field, value, CASE field WHEN 'depth' THEN CASE WHEN NOT regexp_matches(value, '^[0-9]{1,4}([.,][0-9]{1,2})?$') THEN 'format' WHEN NOT value::DOUBLE BETWEEN 0 AND 5000 THEN 'range' ELSE 'ok' END
 WHEN 'percent' THEN CASE WHEN NOT regexp_matches(value, '^[0-9]{1,3}([.,][0-9]{1,2})?$') THEN 'format' WHEN NOT value::DOUBLE BETWEEN 0 AND 100 THEN 'range' ELSE 'ok' END
 WHEN 'year' THEN CASE WHEN NOT regexp_matches(value, '^[0-9]{4}$') THEN 'format' WHEN NOT value::DOUBLE BETWEEN 1900 AND 2100 THEN 'range' ELSE 'ok' END ELSE 'unknown' END AS verdict FROM v""".replace("(value::INT +", "(floor(value)::INT +"))
def field_verdicts(spark, sf_dir):
    """L37."""
    k = F.col("event_id")
    field = F.when(k % 4 == 0, "depth").when(k % 4 == 1, "percent").when(k % 4 == 2, "year").otherwise("note")
    value = F.when(k % 3 == 0, "x").otherwise((F.floor("value").cast("int") + F.when(k % 4 == 2, 1880).otherwise(0)).cast("string"))
    v = table(spark, sf_dir, "events").select("event_id", field.alias("field"), value.alias("value"))
    return v.withColumn("verdict", ocr.check_field(F.col("field"), F.col("value")))


@query("""SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, 'part.*1$') THEN 'one' WHEN regexp_matches(p_name, '[2-5]$') AND NOT regexp_matches(p_type, 'X') THEN 'few' END AS field FROM part""")
def field_names(spark, sf_dir):
    """First matching rule."""
    rules = spark.createDataFrame([(1, "one", "part.*1$", None), (2, "few", "[2-5]$", "X")], "prio int, field string, tail_like string, head_not string")
    return ocr.name_fields(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("tail"), F.col("p_type").alias("head")), rules)


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 99 THEN (p_size::VARCHAR)[1] || '.' || (p_size::VARCHAR)[2] ELSE p_size::VARCHAR END AS separated, replace(replace('O' || p_size, 'O', '0'), 'l', '1') AS letters, p_size::VARCHAR AS unitless FROM part""")
def value_repairs(spark, sf_dir):
    """L39."""
    s = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", ocr.fix_separator(s, F.lit("depth")).alias("separated"), ocr.fix_confused(F.concat(F.lit("O"), s)).alias("letters"), ocr.fix_unit(F.concat(s, F.lit(" м."))).alias("unitless"))


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 9 < 6 THEN 'ruling' WHEN event_id % 100 > 6 * (event_id % 9) AND NOT regexp_matches(event_type, '[0-9]') THEN 'signature' WHEN NOT regexp_matches(event_type, '[0-9]') THEN 'no digit' ELSE 'other' END AS reason FROM events""")
def silence_reasons(spark, sf_dir):
    """L40."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", ocr.why_silent(F.col("event_type"), k % 100, k % 9, k % 2 == 0).alias("reason"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, (l_partkey % 1000)::VARCHAR AS v, [(l_suppkey % 1000)::VARCHAR, (l_partkey % 100)::VARCHAR] AS refs FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN list_contains(refs, v) THEN 'correct' WHEN len(list_filter(refs, lambda x: contains(x, v))) > 0 THEN 'fragment' WHEN len(list_filter(refs, lambda x: levenshtein(x, v) <= greatest(1, floor(length(x) / 3)))) > 0 THEN 'distortion' ELSE 'invention' END AS verdict FROM r""")
def reading_verdicts(spark, sf_dir):
    """L32."""
    li = table(spark, sf_dir, "lineitem")
    v = (F.col("l_partkey") % 1000).cast("string")
    refs = F.array((F.col("l_suppkey") % 1000).cast("string"), (F.col("l_partkey") % 100).cast("string"))
    rows = li.select("l_orderkey", "l_linenumber", v.alias("v"), refs.alias("refs"))
    return rows.select("l_orderkey", "l_linenumber", corpus.classify(F.col("v"), F.col("refs")).alias("verdict"))


@query("""
WITH a AS (SELECT event_id // 10 AS page, event_id % 5 AS box, event_type AS text, count(DISTINCT user_id) AS votes FROM events GROUP BY ALL HAVING count(DISTINCT user_id) >= 2)
SELECT page, box, text, votes, page % 2 = 0 AND text = 'click' AS third FROM a""")
def crop_agreement(spark, sf_dir):
    """L35."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("page"), (F.col("event_id") % 5).alias("box"), F.col("event_type").alias("text"), F.col("user_id").alias("reader"))
    third = e.select("page").distinct().filter("page % 2 = 0").withColumn("text", F.lit("a click here"))
    return ocr.crop_agreement(e, third)


@query("""SELECT event_id, CASE WHEN t > 0 THEN CASE WHEN a = t THEN 'journal' WHEN b = t THEN 'table' ELSE 'title' END ELSE 'none' END AS kind FROM (SELECT event_id, a, b, c, greatest(a, b, c) AS t FROM (SELECT event_id, (event_type = 'click')::INT * 2 AS a, (event_type = 'view')::INT * 2 AS b, (event_type = 'purchase')::INT * 2 AS c FROM events))""")
def page_types(spark, sf_dir):
    """L41l: weighted key words."""
    kinds = {"journal": {"click": 2}, "table": {"view": 2}, "title": {"purchase": 2}}
    return table(spark, sf_dir, "events").select("event_id", ocr.page_type(F.col("event_type"), kinds).alias("kind"))


@query("""SELECT user_id AS doc, event_id AS page FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3""")
def top_ink_pages(spark, sf_dir):
    """L41m, L46e (a top-k report)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("page"), "value")
    return ocr.top_pages(e, "doc", "value", 3).select("doc", "page")


@query("""SELECT event_id, CASE WHEN CAST('0x' || md5(user_id || ':' || 'seed')[1:8] AS BIGINT) / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM events""")
def document_split(spark, sf_dir):
    """L42."""
    return ocr.split_by_document(table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("doc")), "doc", 0.2, "seed").select("event_id", "split")


@query("""SELECT count(*) AS n, avg(regexp_matches(p_size::VARCHAR, '[0-9][.,][0-9]')::INT) AS before, avg((p_size BETWEEN 10 AND 99)::INT) AS after FROM part""")
def label_quality(spark, sf_dir):
    """L43, L46d."""
    s = F.col("p_size").cast("string")
    return ocr.separator_share(table(spark, sf_dir, "part").select(s.alias("a"), ocr.fix_separator(s, F.lit("depth")).alias("b")), "a", "b")


@query("""SELECT event_type, count(*) FILTER (WHERE value < 30) AS low, count(*) FILTER (WHERE value >= 30) AS high FROM events GROUP BY event_type""")
def confusion_counts(spark, sf_dir):
    """L44."""
    return ocr.confusion(table(spark, sf_dir, "events").withColumn("v", F.when(F.col("value") < 30, "low").otherwise("high")), "event_type", "v", ["low", "high"])


@query("""SELECT c_custkey, [c_name, 'tail'] AS texts FROM customer""")
def transcript_texts(spark, sf_dir):
    """Values out of broken JSON."""
    raw = F.concat(F.lit('[{"text": "'), "c_name", F.lit('", "x": 1}, {"text": "tail"'))
    return table(spark, sf_dir, "customer").select("c_custkey", ocr.transcripts(raw).alias("texts"))


@query("""
WITH f AS (SELECT event_id // 2 AS page, 0 AS box, (user_id % 50)::VARCHAR AS text, 'percent' AS field, value AS ink, value / 100 AS conf_min FROM events WHERE event_id % 2 = 0), s AS (SELECT event_id // 2 AS page, (user_id % 50)::VARCHAR AS text FROM events WHERE event_id % 2 = 1)
SELECT page, text FROM f JOIN s USING (page, text) WHERE ink >= 20 AND conf_min >= 0.3""")
def harvest_labels(spark, sf_dir):
    """L46b."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2).alias("page"), F.lit(0).alias("box"), (F.col("user_id") % 50).cast("string").alias("text"), F.lit("percent").alias("field"), F.col("value").alias("ink"), (F.col("value") / 100).alias("conf_min"), (F.col("event_id") % 2).alias("k"))
    return ocr.harvest(e.filter("k = 0"), e.filter("k = 1"), 20, 0.3).select("page", "text")


@query()
def infix_distances(spark, sf_dir):
    """L33."""
    return ocr.infix_distance(table(spark, sf_dir, "part").select(F.col("p_name").alias("hyp"), F.col("p_type").alias("ref")))


@query("""SELECT p_partkey // 5 AS page, p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_partkey // 5)::BIGINT AS value_id FROM part""")
def grouped_boxes(spark, sf_dir):
    """Boxes of one row, 40 apart, are one value."""
    k = F.col("p_partkey") % 5 * 60
    b = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 5).alias("page"), F.col("p_partkey").alias("id"), k.cast("int").alias("x0"), F.lit(10).alias("y0"), (k + 20).cast("int").alias("x1"), F.lit(30).alias("y1"))
    return ocr.group_boxes(b)


@query("""
WITH v AS (SELECT l_orderkey AS page, l_linenumber AS id, l_linenumber * 100 AS x0, l_linenumber * 100 + 50 AS x1, 100 AS y1 FROM lineitem), r AS (SELECT o_orderkey AS page, 1 AS rid, 0 AS rx0, 350 AS rx1, 110 + o_orderkey % 80 AS ry FROM orders)
SELECT DISTINCT v.page, v.id, r.rid FROM v LEFT JOIN r ON v.page = r.page AND x0 < rx1 AND rx0 < x1 AND ry - y1 BETWEEN -5 AND 60""")
def attached_values(spark, sf_dir):
    """L41f."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id"), (F.col("l_linenumber") * 100).alias("x0"), (F.col("l_linenumber") * 100 + 50).alias("x1"), F.lit(100).alias("y1"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.lit(1).alias("rid"), F.lit(0).alias("rx0"), F.lit(350).alias("rx1"), (F.col("o_orderkey") % 80 + 110).alias("ry"))
    return ocr.attach_to_rulings(v, r)


