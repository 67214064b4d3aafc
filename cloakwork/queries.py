"""Queries of the reference's operators over the driver tables, and their SQL twins.

Each is registered under its name with `@query(oracle)`; the oracle is DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.functions import checksums, geo, text
from cloakwork.operators import corpus, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_EMAIL = text.EMAIL
_IP = text.IPV4
_IPS = f"list_filter(regexp_extract_all(text, '{_IP}'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: p::INT)) <= 255)"
_MASKED = f"regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g'), 'https?://[^\\s\"''<>]+', '[URL]', 'g'), '{_IP}', '[IP]', 'g')"


# --- detection in SQL, masking, receipts -------------------------------------------------------------


@query(f"""
WITH d AS (SELECT lang, source, regexp_extract_all(text, '{_EMAIL}') AS e, {_IPS} AS i, {_MASKED} AS m FROM documents)
SELECT lang, source, count(*) AS docs, count(*) FILTER (WHERE len(e) + len(i) > 0) AS docs_with_pii,
       sum(len(e))::BIGINT AS emails, sum(len(i))::BIGINT AS ips, sum(length(m))::BIGINT AS masked_chars
FROM d GROUP BY lang, source""")
def pii_inventory(spark, sf_dir):
    """Who holds e-mail addresses and IPv4s, by language and source."""
    d = table(spark, sf_dir, "documents").select("lang", "source", F.size(text.emails(F.col("text"))).alias("e"), F.size(text.ipv4s(F.col("text"))).alias("i"), F.length(text.mask(F.col("text"))).alias("m"))
    return d.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("e") + F.col("i") > 0).alias("docs_with_pii"), F.sum("e").cast("long").alias("emails"), F.sum("i").cast("long").alias("ips"), F.sum("m").cast("long").alias("masked_chars")
    )


@query(f"SELECT doc_id, sha256({_MASKED}) AS digest FROM documents")
def mask_documents(spark, sf_dir):
    """Masked text, as its digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.mask(F.col("text")).cast("binary"), 256).alias("digest"))


@query(f"SELECT conv_id, turn, {_MASKED} AS masked FROM conversations WHERE role = 'user'")
def mask_conversations(spark, sf_dir):
    """E4 over requests."""
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", text.mask(F.col("text")).alias("masked"))


@query(f"""
WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
SELECT host, count(*) AS pages, (host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.org' OR ends_with(host, '.example.org')) AS allowed
FROM h GROUP BY host""")
def url_hosts_allowlist(spark, sf_dir):
    """Hosts of pages against an allow-list of suffixes."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    per = table(spark, sf_dir, "pages").select(host.alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return per.withColumn("allowed", text.host_allowed(F.col("host"), ["example.com", "example.org"]))


@query("""
WITH u AS (SELECT page_id, unnest(list_transform(regexp_extract_all(url || ' ' || html, 'https?://([^/\\s"''<>:?#]+)', 1), lambda x: lower(x))) AS host FROM pages)
SELECT host, count(*) AS links, count(DISTINCT page_id) AS pages FROM u GROUP BY host""")
def url_detection(spark, sf_dir):
    """Hosts of all URLs of and within pages."""
    u = table(spark, sf_dir, "pages").select("page_id", F.explode(text.hosts(F.concat_ws(" ", "url", "html"))).alias("host"))
    return u.groupBy("host").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("page_id").alias("pages"))


_LUHN = "list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN (length(v) - i) % 2 = 0 THEN v[i]::INT WHEN v[i]::INT < 5 THEN v[i]::INT * 2 ELSE v[i]::INT * 2 - 9 END)) % 10 = 0"


@query(f"""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{13,19}}')) AS v FROM documents)
SELECT doc_id, v AS candidate, coalesce({_LUHN}, false) AND length(replace(v, v[1], '')) > 0 AS valid FROM c""")
def luhn_card_candidates(spark, sf_dir):
    """Runs of 13 to 19 digits and whether they check."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(text.LONG_NUMBER), F.lit(0))).alias("candidate"))
    return c.withColumn("valid", checksums.is_valid_card(F.col("candidate")))


# --- checksums, on numbers built from keys -----------------------------------------------------------


def _sum(weights, v="v"):
    return " + ".join(f"{v}[{i + 1}]::INT * {w}" for i, w in enumerate(weights))


@query(f"""
WITH k AS (SELECT o_orderkey, lpad((o_orderkey * 7919 % 10000000000)::VARCHAR, 10, '0') AS v, lpad((o_orderkey * 104729 % 1000000000000)::VARCHAR, 12, '0') AS w FROM orders)
SELECT o_orderkey, v AS inn10, w AS inn12,
  ({_sum(checksums.INN10)}) % 11 % 10 = v[10]::INT AND length(replace(v, v[1], '')) > 0 AS valid10,
  ({_sum(checksums.INN11, 'w')}) % 11 % 10 = w[11]::INT AND ({_sum(checksums.INN12, 'w')}) % 11 % 10 = w[12]::INT AND length(replace(w, w[1], '')) > 0 AS valid12
FROM k""")
def inn_checksum_valid(spark, sf_dir):
    """B1."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919 % 10000000000).cast("string"), 10, "0").alias("inn10"), F.lpad((F.col("o_orderkey") * 104729 % 1000000000000).cast("string"), 12, "0").alias("inn12"))
    return o.withColumn("valid10", checksums.is_valid_inn(F.col("inn10"))).withColumn("valid12", checksums.is_valid_inn(F.col("inn12")))


@query("""
WITH k AS (SELECT o_orderkey, '1' || lpad((o_orderkey * 7919 % 1000000000000)::VARCHAR, 12, '0') AS v, '3' || lpad((o_orderkey * 104729 % 100000000000000)::VARCHAR, 14, '0') AS w FROM orders)
SELECT o_orderkey, v[1:12]::BIGINT % 11 % 10 = v[13]::INT AS ogrn_valid, w[1:14]::BIGINT % 13 % 10 = w[15]::INT AS ogrnip_valid FROM k""")
def ogrn_valid(spark, sf_dir):
    """B2, B3."""
    o = table(spark, sf_dir, "orders")
    v = F.concat(F.lit("1"), F.lpad((F.col("o_orderkey") * 7919 % 1000000000000).cast("string"), 12, "0"))
    w = F.concat(F.lit("3"), F.lpad((F.col("o_orderkey") * 104729 % 100000000000000).cast("string"), 14, "0"))
    return o.select("o_orderkey", checksums.is_valid_ogrn(v).alias("ogrn_valid"), checksums.is_valid_ogrnip(w).alias("ogrnip_valid"))


@query(f"""
WITH k AS (SELECT o_orderkey, lpad((o_orderkey * 7919 % 100000000000)::VARCHAR, 11, '0') AS v FROM orders), s AS (SELECT *, {_sum(range(9, 0, -1))} AS t FROM k)
SELECT o_orderkey, v AS snils, (CASE WHEN t < 100 THEN t WHEN t IN (100, 101) THEN 0 WHEN t % 101 = 100 THEN 0 ELSE t % 101 END) = v[10:11]::INT AS valid FROM s""")
def snils_valid(spark, sf_dir):
    """B4."""
    v = F.lpad((F.col("o_orderkey") * 7919 % 100000000000).cast("string"), 11, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", v.alias("snils")).withColumn("valid", checksums.is_valid_snils(F.col("snils")))


_W = (7, 1, 3) * 7 + (7, 1)


@query(f"""
WITH k AS (SELECT c_custkey, '04' || lpad((c_custkey * 7919 % 10000000)::VARCHAR, 7, '0') AS b, '40702810' || lpad((c_custkey * 104729 % 1000000000000)::VARCHAR, 12, '0') AS a FROM customer),
s AS (SELECT *, b[7:9] || a AS x, '0' || b[5:6] || a AS y FROM k)
SELECT c_custkey, regexp_matches(b, '^0[014][0-9]{{7}}$') AS bik_valid, ({_sum(_W, 'x')}) % 10 = 0 OR ({_sum(_W, 'y')}) % 10 = 0 AS account_valid FROM s""")
def account_bik_valid(spark, sf_dir):
    """B5, B6."""
    b = F.concat(F.lit("04"), F.lpad((F.col("c_custkey") * 7919 % 10000000).cast("string"), 7, "0"))
    a = F.concat(F.lit("40702810"), F.lpad((F.col("c_custkey") * 104729 % 1000000000000).cast("string"), 12, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", checksums.is_valid_bik(b).alias("bik_valid"), checksums.is_valid_account(a, b).alias("account_valid"))


# --- patterns without look-around, on strings built from rows ----------------------------------------


@query(r"""
WITH l AS (SELECT l_orderkey, l_linenumber, 'lot ' || lpad((l_partkey % 90 + 10)::VARCHAR, 2, '0') || ':' || lpad((l_suppkey % 90 + 10)::VARCHAR, 2, '0') || ':' || lpad((l_orderkey % 10000000)::VARCHAR, 7, '0') || ':' || l_linenumber
  || ' of ' || strftime(l_shipdate, '%d.%m.%Y') || ' or ' || strftime(l_shipdate, '%Y-%m-%d') AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, regexp_extract(t, '[0-9]{2}:[0-9]{2}:[0-9]{6,7}:[0-9]+') AS cadastre, regexp_extract(t, '[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}') AS dmy, regexp_extract(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS iso FROM l""")
def cadastre_and_dates(spark, sf_dir):
    """C31, C50, C51."""
    two = lambda c: F.lpad((F.col(c) % 90 + 10).cast("string"), 2, "0")
    number = F.concat_ws(":", two("l_partkey"), two("l_suppkey"), F.lpad((F.col("l_orderkey") % 10000000).cast("string"), 7, "0"), "l_linenumber")
    t = F.concat(F.lit("lot "), number, F.lit(" of "), F.date_format("l_shipdate", "dd.MM.yyyy"), F.lit(" or "), F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t"))
    return rows.select("l_orderkey", "l_linenumber", F.regexp_extract("t", text.CADASTRE, 0).alias("cadastre"), F.regexp_extract("t", text.DATE_DMY, 0).alias("dmy"), F.regexp_extract("t", text.DATE_ISO, 0).alias("iso"))


@query("""
WITH o AS (SELECT o_orderkey, (CAST('0x' || sha256('scope' || (o_custkey % 100)::VARCHAR)[1:8] AS BIGINT) % 731 - 365)::INT AS d, o_orderdate FROM orders)
SELECT o_orderkey, d AS days, strftime(o_orderdate + to_days(d), '%d.%m.%Y') AS dmy, strftime(o_orderdate + to_days(d), '%Y-%m-%d') AS iso FROM o""")
def date_shift(spark, sf_dir):
    """One shift per scope."""
    days = (F.conv(F.substring(F.sha2(F.concat(F.lit("scope"), (F.col("o_custkey") % 100).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("bigint") % 731 - 365).cast("int")
    o = table(spark, sf_dir, "orders").select("o_orderkey", days.alias("days"), "o_orderdate")
    return o.select("o_orderkey", "days", text.shifted_date(F.date_format("o_orderdate", "dd.MM.yyyy"), F.col("days")).alias("dmy"), text.shifted_date(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("days")).alias("iso"))


@query("""
WITH c AS (SELECT c_custkey, upper(replace(replace(replace(replace(t, '[', ''), ']', ''), '*', ''), ' ', '')) AS k, t FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '[PER_0' || c_custkey || ']' WHEN 1 THEN '**per ' || c_custkey || '**' WHEN 2 THEN '[ Org-' || c_custkey || ' ]' ELSE 'none' END AS t FROM customer))
SELECT c_custkey, t AS candidate, CASE WHEN regexp_matches(k, '^([A-Z][A-Z_]*?)[_-]?([0-9]+)$') THEN regexp_extract(k, '^([A-Z][A-Z_]*?)[_-]?([0-9]+)$', 1) || '_' || (regexp_extract(k, '^([A-Z][A-Z_]*?)[_-]?([0-9]+)$', 2)::INT)::VARCHAR END AS key FROM c""")
def fuzzy_token_keys(spark, sf_dir):
    """I16."""
    n, key = F.col("c_custkey").cast("string"), F.col("c_custkey")
    t = F.when(key % 4 == 0, F.concat(F.lit("[PER_0"), n, F.lit("]"))).when(key % 4 == 1, F.concat(F.lit("**per "), n, F.lit("**"))).when(key % 4 == 2, F.concat(F.lit("[ Org-"), n, F.lit(" ]"))).otherwise("none")
    return table(spark, sf_dir, "customer").select("c_custkey", t.alias("candidate")).withColumn("key", text.token_key(F.col("candidate")))


@query("""
SELECT a.n_name AS a, b.n_name AS b, CASE WHEN levenshtein(a.n_name, b.n_name) <= 3 THEN levenshtein(a.n_name, b.n_name) END::INT AS d
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def levenshtein_within(spark, sf_dir):
    """I17."""
    n = table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_name").alias(x), F.col("n_regionkey").alias(f"r{x}"), F.col("n_nationkey").alias(f"k{x}")) for x in "ab")
    d = F.levenshtein("a", "b", 3)
    return a.join(b, (F.col("ra") == F.col("rb")) & (F.col("ka") < F.col("kb"))).select("a", "b", F.when(d >= 0, d).alias("d"))


@query("""
SELECT o_orderkey, (CASE WHEN o_orderkey % 100 BETWEEN 11 AND 14 THEN 2 WHEN o_orderkey % 10 = 1 THEN 0 WHEN o_orderkey % 10 BETWEEN 2 AND 4 THEN 1 ELSE 2 END)::INT AS form FROM orders""")
def plural_index(spark, sf_dir):
    """H7."""
    return table(spark, sf_dir, "orders").select("o_orderkey", text.plural_index(F.col("o_orderkey")).alias("form"))


@query("""
SELECT c_custkey, round(c_acctbal, 6) AS x, round(c_custkey::DOUBLE, 6) AS y,
 round(((c_acctbal - 100.0) * cos(0.3::DOUBLE) - (c_custkey - 50.0) * sin(0.3::DOUBLE)) * 1.5, 6) AS lx, round(((c_acctbal - 100.0) * sin(0.3::DOUBLE) + (c_custkey - 50.0) * cos(0.3::DOUBLE)) * 1.5, 6) AS ly, true AS back FROM customer""")
def local_cs_round_trip(spark, sf_dir):
    """Affine local system and its exact inverse."""
    key = (100.0, 50.0, 0.3, 1.5)
    x, y = F.col("c_acctbal"), F.col("c_custkey").cast("double")
    lx, ly = geo.to_local(x, y, *key)
    bx, by = geo.from_local(lx, ly, *key)
    back = (F.abs(bx - x) < 1e-6) & (F.abs(by - y) < 1e-6)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(lx, 6).alias("lx"), F.round(ly, 6).alias("ly"), back.alias("back"))


@query()
def datum_conversion(spark, sf_dir):
    """WGS84 to SK-42 and back, in degrees."""
    lat, lon = F.col("c_custkey") % 60 + 20.123456, F.col("c_custkey") % 120 + 30.654321
    there = geo.convert(lat, lon, "WGS84", "SK-42")
    rows = table(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"), there[0].alias("sk_lat"), there[1].alias("sk_lon"))
    back = geo.convert(F.col("sk_lat"), F.col("sk_lon"), "SK-42", "WGS84")
    return rows.withColumn("error", F.greatest(F.abs(back[0] - F.col("lat")), F.abs(back[1] - F.col("lon"))) < 1e-5)


@query(r"""
WITH p AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 170 * 1.00013 + 0.123456)::DECIMAL(12,4)::VARCHAR AS a, (l_partkey % 90 * 1.37 + l_suppkey * 0.0001)::DECIMAL(12,4)::VARCHAR AS b FROM lineitem),
n AS (SELECT *, a::DOUBLE AS x, b::DOUBLE AS y, length(split_part(a, '.', 2)) AS fa, length(split_part(b, '.', 2)) AS fb FROM p)
SELECT l_orderkey, l_linenumber, a, b, abs(x) <= 90 AND abs(y) <= 180 AND abs(x) >= 1 AND abs(y) >= 1 AND x <> y AND fa >= 4 AND fb >= 4 AND abs(fa - fb) <= 1
  AND NOT regexp_matches(a, '^(0?[1-9]|1[0-2])\.(19|20)[0-9]{2}$') AND NOT regexp_matches(b, '^(0?[1-9]|1[0-2])\.(19|20)[0-9]{2}$') AND NOT regexp_matches(a, '\.[0-9]*00000$') AND NOT regexp_matches(b, '\.[0-9]*00000$')
  AND NOT coalesce(least(x, y) <> 0 AND abs(greatest(x, y) / nullif(least(x, y), 0) - round(greatest(x, y) / nullif(least(x, y), 0))) < 1e-9, false) AS plausible FROM n""")
def bare_pair_plausible(spark, sf_dir):
    """D4."""
    a = (F.col("l_orderkey") % 170 * F.expr("1.00013BD") + F.expr("0.123456BD")).cast("decimal(12,4)").cast("string")
    b = (F.col("l_partkey") % 90 * F.expr("1.37BD") + F.col("l_suppkey") * F.expr("0.0001BD")).cast("decimal(12,4)").cast("string")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
    return rows.withColumn("plausible", geo.bare_pair_plausible(F.col("a"), F.col("b")))


# --- normalisation in SQL ----------------------------------------------------------------------------


@query("""
WITH d AS (SELECT doc_id, chr(8203) || replace(text, ' ', chr(160)) || chr(65279) AS t FROM documents)
SELECT doc_id, sha256(replace(replace(replace(t, chr(8203), ''), chr(65279), ''), chr(160), ' ')) AS digest FROM d""")
def normalize_spaces(spark, sf_dir):
    """A1, A10: marks without width go, no-break spaces become plain."""
    t = F.concat(F.lit("​"), F.translate("text", " ", " "), F.lit("﻿"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.plain_spaces(text.drop_zero_width(t)).cast("binary"), 256).alias("digest"))


@query("""SELECT n_nationkey, n_name AS narrow FROM nation""")
def normalize_width(spark, sf_dir):
    """A2: full-width letters back to ASCII, one for one."""
    wide = F.translate("n_name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.narrow_forms(wide).alias("narrow"))


@query("""SELECT n_nationkey, 'Договор ' || regexp_replace(n_name, '[^A-Za-z]', '', 'g') || ' счёт' AS apart FROM nation""")
def normalize_scripts(spark, sf_dir):
    """A space at the seam of two scripts."""
    glued = F.concat(F.lit("Договор"), F.regexp_replace("n_name", "[^A-Za-z]", ""), F.lit("счёт"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.split_scripts(glued).alias("apart"))


# --- tokens ------------------------------------------------------------------------------------------


def _email_spans(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("scope"), F.posexplode(text.emails(F.col("text"))).alias("nth", "raw"))
    return d.select("scope", F.lit("EMAIL").alias("type"), "raw", F.lit(None).cast("string").alias("identity"), (F.col("doc_id") * 1000 + F.col("nth")).alias("pos"))


_NUMBERED = f"""
s AS (SELECT doc_id, source AS scope, unnest(regexp_extract_all(text, '{_EMAIL}')) AS raw, generate_subscripts(regexp_extract_all(text, '{_EMAIL}'), 1) AS nth FROM documents),
i AS (SELECT scope, raw, max(doc_id * 1000 + nth - 1) AS last FROM s GROUP BY scope, raw),
n AS (SELECT scope, raw, row_number() OVER (PARTITION BY scope ORDER BY last DESC, raw) AS n FROM i),
v AS (SELECT scope, '[EMAIL_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n || ']' AS token, 'EMAIL' AS type, raw FROM n)"""


@query(f"WITH {_NUMBERED} SELECT scope, token, type, raw FROM v")
def token_numbering(spark, sf_dir):
    """Dense numbers per scope and type, the last identity first."""
    return tokens.number_tokens(_email_spans(spark, sf_dir)).drop("identity")


@query(f"WITH {_NUMBERED} SELECT doc_id, sha256(text) AS digest FROM documents WHERE regexp_matches(text, '{_EMAIL}')")
def detokenize_exact(spark, sf_dir):
    """Every e-mail address becomes its token and back: the text is as before."""
    vault = tokens.number_tokens(_email_spans(spark, sf_dir))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("scope"), "text").filter(F.col("text").rlike(_EMAIL))
    found, between = F.regexp_extract_all("text", F.lit(_EMAIL), F.lit(0)), F.split("text", _EMAIL, -1)
    known = d.select("doc_id", "scope", F.explode(F.array_distinct(found)).alias("raw")).join(vault, ["scope", "raw"])
    known = known.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("raw", "token"))).alias("m"))
    hidden = F.concat_ws("", F.flatten(F.transform(F.arrays_zip(between.alias("b"), found.alias("r")), lambda x: F.array(x["b"], F.coalesce(F.element_at("m", x["r"]), F.lit(""))))))
    masked = d.join(known, "doc_id").select("doc_id", "scope", hidden.alias("text"))
    return tokens.restore_exact(masked, vault).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(r"""
WITH w AS (SELECT doc_id, text, length(regexp_extract(text, '^[^0-9]*')) AS p FROM documents WHERE regexp_matches(text, '[0-9]'))
SELECT doc_id, p::BIGINT AS position, nullif(lower(regexp_extract(substr(text, greatest(p - 48, 0) + 1, least(p, 48)), '([\p{L}\p{N}-]+)\.?[ ]*$', 1)), '') AS cue FROM w""")
def cue_before(spark, sf_dir):
    """The word before the first digit."""
    p = F.length(F.regexp_extract("text", "^[^0-9]*+", 0))
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]")).withColumn("p", p)
    return d.select("doc_id", F.col("p").cast("long").alias("position"), text.cue_before(F.col("text"), F.col("p")).alias("cue"))


@query("""
WITH u AS (SELECT user_id, event_type AS cue, floor(value * 10)::INT::VARCHAR AS form, event_id FROM events),
f AS (SELECT user_id, cue, arg_min(form, event_id) AS form, min(event_id) AS pos FROM u GROUP BY user_id, cue)
SELECT user_id, cue, form FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos, cue) <= 3""")
def first_use_forms(spark, sf_dir):
    """I4: first form per cue, capped."""
    u = table(spark, sf_dir, "events").select(F.lit("s").alias("scope"), F.col("user_id").alias("token"), F.col("event_type").alias("cue"), F.floor(F.col("value") * 10).cast("int").cast("string").alias("form"), F.col("event_id").alias("pos"))
    return tokens.use_forms(u, cap=3).select(F.col("token").alias("user_id"), "cue", "form")


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS nth FROM events QUALIFY nth <= 5""")
def occurrence_list(spark, sf_dir):
    """I4: numbered occurrences, capped."""
    u = table(spark, sf_dir, "events").select(F.lit("s").alias("scope"), F.col("user_id").alias("token"), F.col("event_id").alias("pos"))
    return tokens.occurrences(u, cap=5).select(F.col("token").alias("user_id"), F.col("pos").alias("event_id"), "nth")


@query("""SELECT event_type AS type, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type""")
def orphan_report(spark, sf_dir):
    """Unresolved by type."""
    return tokens.orphans(table(spark, sf_dir, "events").filter("value > 50").select(F.col("event_type").alias("type")))


@query(f"""
WITH m AS (SELECT doc_id, {_MASKED} AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '\\[[A-Z][A-Z_]*(?:_[0-9]+)?\\]'))::BIGINT AS entities, sha256(t) AS hash_post_redaction FROM m""")
def receipts_sha256(spark, sf_dir):
    """Receipts of masked texts."""
    return tokens.receipts(table(spark, sf_dir, "documents").select("doc_id", text.mask(F.col("text")).alias("text")))


@query("""SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50""")
def receipt_ring(spark, sf_dir):
    """The latest fifty."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts")


@query("""
WITH r AS (SELECT user_id AS chain, event_id, event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
b AS (SELECT chain, count(*) AS records, min(CASE WHEN event_id % 97 = 0 THEN seq END) AS broken_at FROM r GROUP BY chain) SELECT chain, records, broken_at FROM b""")
def hash_chain_verify(spark, sf_dir):
    """Each user's events as a chain of hashes, some tampered with; the first break is found."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), "event_id", F.col("event_type").alias("payload"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"))
    link = lambda a, r: F.sha2(F.concat_ws("|", r["seq"], a, r["payload"]).cast("binary"), 256)
    per = e.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("seq", "payload", "event_id"))).alias("r"))
    grown = F.aggregate("r", F.array(F.lit("genesis")), lambda a, r: F.concat(a, F.array(link(F.element_at(a, -1), r))))
    built = per.withColumn("h", grown).select("chain", F.posexplode("r").alias("i", "x"), "h")
    rows = built.select("chain", F.col("x.seq").alias("seq"), "x.payload", F.element_at("h", F.col("i") + 1).alias("prev_hash"), F.element_at("h", F.col("i") + 2).alias("hash"), (F.col("x.event_id") % 97 == 0).alias("_bad"))
    tampered = rows.withColumn("payload", F.when(F.col("_bad"), F.lit("forged")).otherwise(F.col("payload"))).drop("_bad")
    return corpus.chain_breaks(tampered, "genesis")


# --- validation and corpus analytics -----------------------------------------------------------------


@query("""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
SELECT sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (WHERE n < 5), 0)::BIGINT AS at_risk, count(*) AS classes FROM c""")
def k_anonymity(spark, sf_dir):
    """L5."""
    return corpus.quasi_risk(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 5)


@query("""
WITH p AS (SELECT s_nationkey AS k, count(DISTINCT s_suppkey) AS n FROM supplier GROUP BY 1 HAVING n = 1)
SELECT count(*) AS rows, count(p.k) AS linked FROM customer LEFT JOIN p ON c_nationkey = p.k""")
def linkage_risk(spark, sf_dir):
    """L6."""
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k")
    return corpus.linkage_risk(rows, table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "k"), ["k"], "s_suppkey")


_PRF = """CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END"""


@query(f"""
WITH g AS (SELECT doc_id, 'toxic' AS type FROM labels WHERE toxic = 1), p AS (SELECT doc_id, 'toxic' AS type FROM documents WHERE regexp_matches(text, 'idiot|moron|worthless')),
b AS (SELECT coalesce(g.type, p.type) AS type, g.doc_id AS g, p.doc_id AS p FROM g FULL JOIN p USING (doc_id)),
c AS (SELECT type, sum((g IS NOT NULL AND p IS NOT NULL)::INT)::BIGINT AS tp, sum((g IS NULL)::INT)::BIGINT AS fp, sum((p IS NULL)::INT)::BIGINT AS fn FROM b GROUP BY type),
r AS (SELECT *, {_PRF} AS precision, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS recall FROM c)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1, CASE WHEN precision * 4 + recall = 0 THEN 0.0::DOUBLE ELSE 5 * precision * recall / (precision * 4 + recall) END AS f2 FROM r""")
def strict_match_metrics(spark, sf_dir):
    """L1, L2: gold labels against a word list."""
    gold = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit("toxic").alias("type"))
    found = table(spark, sf_dir, "documents").filter(F.col("text").rlike("idiot|moron|worthless")).select("doc_id", F.lit("toxic").alias("type"))
    return corpus.metrics(corpus.strict_counts(gold, found, ["doc_id", "type"], ["type"]))


@query("""
SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS docs, sum(quality)::BIGINT AS good, sum(quality) / count(*) AS share
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)""")
def score_rollup(spark, sf_dir):
    """By language, by language and source, and overall."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    r = d.rollup("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("quality").cast("long").alias("good"))
    return r.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "docs", "good", (F.col("good") / F.col("docs")).alias("share"))


@query("""
WITH r AS (SELECT lang, sum((quality = 1)::INT) / count(*) AS precision FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, precision, precision >= 0.85 AS passed FROM r""")
def release_thresholds(spark, sf_dir):
    """The precision gate per group."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    r = d.groupBy("lang").agg((F.sum((F.col("quality") == 1).cast("int")) / F.count(F.lit(1))).alias("precision"))
    return r.withColumn("passed", F.col("precision") >= 0.85)


@query(f"""
WITH o AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{13,19}}')) AS value FROM documents), n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{{8}}')) AS value FROM documents)
SELECT doc_id, value, 'appeared' AS change FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) UNION ALL SELECT doc_id, value, 'vanished' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)""")
def regression_diff(spark, sf_dir):
    """An old detector against a new one."""
    d = table(spark, sf_dir, "documents")
    old, new = (d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("value")) for p in (text.LONG_NUMBER, "[0-9]{8}"))
    return corpus.difference(old, new, ["doc_id", "value"])


@query("""
WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations),
a AS (SELECT conv_id, w, count(*) AS n FROM w WHERE role = 'user' GROUP BY ALL), b AS (SELECT conv_id, w, count(*) AS n FROM w WHERE role = 'assistant' GROUP BY ALL),
j AS (SELECT conv_id, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b USING (conv_id, w)),
t AS (SELECT conv_id, sum(na)::BIGINT AS "left", sum(nb)::BIGINT AS "right", sum(least(na, nb))::BIGINT AS shared FROM j GROUP BY conv_id)
SELECT *, shared / greatest("left" + "right" - shared, 1) AS jaccard FROM t""")
def multiset_agreement(spark, sf_dir):
    """Words of the two sides of a conversation."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return corpus.multiset_agreement(w.filter("role = 'user'"), w.filter("role = 'assistant'"), ["conv_id"], "w")


@query(r"""
WITH v AS (SELECT DISTINCT page_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(html, '[0-9]+(?:[.,][0-9]+)?'), lambda x: regexp_replace(replace(x, ',', '.'), '^0+([0-9])', '\1')), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 3))) AS value FROM pages)
SELECT value, count(*) AS pages FROM v GROUP BY value HAVING count(*) >= 3""")
def boilerplate_numbers(spark, sf_dir):
    """Long numbers seen on three pages or more."""
    long_ = F.filter(text.numbers(F.col("html")), lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) >= 3)
    return corpus.boilerplate(table(spark, sf_dir, "pages").select("page_id", long_.alias("v")), "page_id", "v")


@query("""
SELECT event_id % 500 AS item, event_type AS value, count(DISTINCT user_id) AS votes FROM events GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 3""")
def consensus_votes(spark, sf_dir):
    """L34."""
    return corpus.consensus(table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("item"), F.col("event_type").alias("value"), "user_id"), "item", "value", "user_id", 3)


@query("""
WITH t AS (SELECT unnest([10.0::DOUBLE, 30.0, 50.0, 70.0, 90.0]) AS threshold), n AS (SELECT count(*) AS n FROM events),
a AS (SELECT threshold, count(*) AS accepted, sum((event_type = 'click')::INT)::BIGINT AS correct FROM t JOIN events ON value >= threshold GROUP BY threshold)
SELECT threshold, coalesce(accepted, 0) AS accepted, coalesce(correct, 0) AS correct, CASE WHEN coalesce(accepted, 0) = 0 THEN 1.0 ELSE correct / accepted END AS precision, coalesce(accepted, 0) / (SELECT n FROM n) AS coverage FROM t LEFT JOIN a USING (threshold)""")
def calibration_curve(spark, sf_dir):
    """L36."""
    return corpus.curve(table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") == "click"), "value", "ok", [10.0, 30.0, 50.0, 70.0, 90.0])


@query("""
WITH m AS (SELECT doc_id, regexp_matches(text, '@') AS likely FROM documents), o AS (SELECT doc_id, count(*) OVER () AS n FROM m WHERE NOT likely),
s AS (SELECT doc_id, n FROM o ORDER BY md5(doc_id || ':' || 'seed'), doc_id LIMIT 100)
SELECT doc_id, 1.0::DOUBLE AS weight, 'K' AS stratum FROM m WHERE likely UNION ALL SELECT doc_id, n / least(100, n), 'O' FROM s""")
def stratified_sample_weights(spark, sf_dir):
    """A sampling operator."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("@")).alias("likely"))
    return corpus.stratified_weights(d, F.col("likely"), "doc_id", 100, "seed").select("doc_id", "weight", "stratum")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(l_orderkey || ':' || l_linenumber || ':' || 'seed'), l_orderkey, l_linenumber) <= 2""")
def per_doc_cap_sample(spark, sf_dir):
    """At most two per group."""
    return corpus.per_group_sample(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", ["l_orderkey", "l_linenumber"], 2, "seed")


@query("""
WITH w AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents), x AS (SELECT doc_id, n, unnest(range(0, greatest(ceil((n - 64) / 256.0), 1)::INT)) AS i FROM w)
SELECT doc_id, (i * 256)::INT AS first, least(i * 256 + 320, n)::INT AS last FROM x""")
def word_windows(spark, sf_dir):
    """K4: windows that overlap and leave nothing out."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return d.select("doc_id", F.explode(text.word_windows(F.col("w"))).alias("x")).select("doc_id", "x.first", "x.last")


@query(f"""
WITH m AS (SELECT text, {_MASKED} AS masked FROM documents),
c AS (SELECT 'EMAIL' AS type, sum(len(regexp_extract_all(text, '@')))::BIGINT AS before, sum(len(regexp_extract_all(masked, '@')))::BIGINT AS after FROM m
 UNION ALL SELECT 'NUMBER', sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT, sum(len(regexp_extract_all(masked, '[0-9]+')))::BIGINT FROM m)
SELECT type, before, after, CASE WHEN before = 0 THEN 1.0 ELSE (before - after) / before END AS recall FROM c""")
def recall_net(spark, sf_dir):
    """An independent net before and after masking."""
    d = table(spark, sf_dir, "documents").select("text", text.mask(F.col("text")).alias("masked"))
    return corpus.net_recall(d, "masked", {"EMAIL": "@", "NUMBER": "[0-9]+"})


def _gold_spans(spark, sf_dir) -> DataFrame:
    """Long numbers of documents, with where they start."""
    d = table(spark, sf_dir, "documents")
    return _spans(d, "NUMBER", "[0-9]{13,19}")


def _spans(d: DataFrame, kind: str, pattern: str) -> DataFrame:
    found, between = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    walk = F.aggregate(
        F.arrays_zip(between.alias("b"), found.alias("m")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("o")),
        lambda a, p: F.struct((a["at"] + F.length(p["b"]) + F.coalesce(F.length(p["m"]), F.lit(0))).alias("at"), F.when(p["m"].isNull(), a["o"]).otherwise(F.concat(a["o"], F.array(F.struct((a["at"] + F.length(p["b"])).alias("start"), (a["at"] + F.length(p["b"]) + F.length(p["m"])).alias("end"))))).alias("o")),
        lambda a: a["o"],
    )
    return d.filter(F.col("text").rlike(pattern)).select("doc_id", F.lit(kind).alias("type"), F.explode(walk).alias("s")).select("doc_id", "type", "s.start", "s.end")


def _duck_spans(kind: str, pattern: str) -> str:
    return f"""SELECT doc_id, '{kind}' AS type, sum(length(b) + coalesce(length(pm), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS start, m FROM (
 SELECT doc_id, i, b, m, lag(m) OVER (PARTITION BY doc_id ORDER BY i) AS pm FROM (
 SELECT doc_id, unnest(range(1, len(bs) + 1)) AS i, unnest(bs) AS b, unnest(list_concat(ms, [NULL])) AS m FROM (
 SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS bs, regexp_extract_all(text, '{pattern}') AS ms FROM documents WHERE regexp_matches(text, '{pattern}'))))"""


@query(f"""
WITH g AS (SELECT doc_id, type, start::INT AS s, (start + length(m))::INT AS e FROM ({_duck_spans("NUMBER", "[0-9]{13,19}")}) WHERE m IS NOT NULL),
f AS (SELECT doc_id, type, start::INT AS s, (start + length(m))::INT AS e FROM ({_duck_spans("NUMBER", "[0-9]{16}")}) WHERE m IS NOT NULL UNION ALL SELECT doc_id, type, start::INT, (start + length(m))::INT FROM ({_duck_spans("IP", _IP)}) WHERE m IS NOT NULL),
j AS (SELECT g.doc_id, g.type, g.s, g.e, max(coalesce(f.type = g.type, false)::INT) AS same, max((f.type IS NOT NULL)::INT) AS any_ FROM g LEFT JOIN f ON g.doc_id = f.doc_id AND g.s < f.e AND f.s < g.e GROUP BY ALL)
SELECT type, count(*) AS gold, sum(same)::BIGINT AS found, sum(CASE WHEN any_ = 1 AND same = 0 THEN 1 ELSE 0 END)::BIGINT AS found_other FROM j GROUP BY type""")
def span_recall(spark, sf_dir):
    """Interval join of gold and found spans."""
    d = table(spark, sf_dir, "documents")
    return corpus.span_recall(_gold_spans(spark, sf_dir), _spans(d, "NUMBER", "[0-9]{16}").union(_spans(d, "IP", _IP)))


@query(f"""
WITH f AS (SELECT doc_id, start::INT AS s, (start + length(m))::INT AS e FROM ({_duck_spans("IP", _IP)}) WHERE m IS NOT NULL),
g AS (SELECT doc_id, start::INT AS s, (start + length(m))::INT AS e FROM ({_duck_spans("NUMBER", "[0-9]{13,19}")}) WHERE m IS NOT NULL)
SELECT f.doc_id, f.s AS start, f.e AS "end", substr(text, greatest(s - 40, 0) + 1, least(s, 40)) || '⟦' || substr(text, s + 1, e - s) || '⟧' || substr(text, e + 1, 40) AS context
FROM f JOIN documents USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = f.doc_id AND f.s < g.e AND g.s < f.e)""")
def false_positive_items(spark, sf_dir):
    """L23d: spans without gold, in context."""
    d = table(spark, sf_dir, "documents")
    bad = corpus.unconfirmed(_spans(d, "IP", _IP), _gold_spans(spark, sf_dir))
    return corpus.in_context(bad.join(d.select("doc_id", "text"), "doc_id")).select("doc_id", "start", "end", "context")


@query("""
WITH c AS (SELECT lower(e.event_type) AS form, u.name AS context FROM events e JOIN (SELECT c_custkey AS k, c_name AS name FROM customer) u ON e.user_id = u.k),
n AS (SELECT form, count(*) AS n FROM c GROUP BY form ORDER BY n DESC, form LIMIT 3), s AS (SELECT form, context, row_number() OVER (PARTITION BY form ORDER BY context) AS r FROM c)
SELECT form, max(n.n) AS n, string_agg(context, ' / ' ORDER BY context) AS contexts FROM s JOIN n USING (form) WHERE r <= 2 GROUP BY form""")
def top_forms(spark, sf_dir):
    """Commonest forms with contexts (a top-k report)."""
    e = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("context")), "user_id")
    return corpus.top_forms(e, "event_type", "context", 3)


@query("""
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents)
SELECT doc_id, (CASE WHEN (r // 8) % 2 = 0 THEN r % 8 ELSE 7 - r % 8 END)::INT AS part FROM r""")
def balanced_parts(spark, sf_dir):
    """Work split by length."""
    return corpus.balanced_parts(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 8).select("doc_id", "part")


@query("""
WITH s AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1)
SELECT doc_id, n, (sum(n) OVER (ORDER BY n, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS total FROM s QUALIFY total <= 1000""")
def whole_documents(spark, sf_dir):
    """Unused documents under a budget (a sampling operator)."""
    used = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"))
    return corpus.whole_documents(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")), used, 1000)


@query("""
WITH t AS (SELECT r_name AS vertical, r_regionkey AS "row", 'Region office of {value} replied.' AS template FROM region), v AS (SELECT r_name AS vertical, n_name AS value, n_nationkey AS batch FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT vertical || '-' || "row" || '-' || batch AS id, vertical, replace(template, '{value}', value) AS text, 'ORG' AS type, 17::INT AS start, (17 + length(value))::INT AS "end", value FROM t JOIN v USING (vertical)""")
def gold_corpus(spark, sf_dir):
    """Templates and values make a gold corpus."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    templates = r.select(F.col("r_name").alias("vertical"), F.col("r_regionkey").alias("row"), F.lit("Region office of {value} replied.").alias("template"), F.lit("ORG").alias("type"))
    values = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("vertical"), F.col("n_name").alias("value"), F.col("n_nationkey").alias("batch"))
    return corpus.gold_variants(templates, values)
