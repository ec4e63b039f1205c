"""Queries that apply the operators to the driver's tables, each with SQL that gives the same rows where SQL can.

Every function reads whole tables. Scores are rounded before they rank, ties go to ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import idents, keys, predicates
from ..operators import chunks, evaluation, fusion, graph, incremental, keyword, resolve
from ..streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- scans and increments -------------------------------------------------------------------------------------


@query("""SELECT source, lang, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS distinct_hashes
FROM documents GROUP BY ALL""")
def file_inventory(spark, d):
    docs = _t(spark, d, "documents")
    return docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct(F.sha2("text", 256)).alias("distinct_hashes"))


@query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, d):
    h = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return h.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""WITH now AS (SELECT doc_id, sha256(text) AS hash, source FROM documents), before AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' ' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, source FROM now WHERE NOT EXISTS (SELECT 1 FROM before WHERE before.doc_id = now.doc_id AND before.hash = now.hash)""")
def incremental_changed(spark, d):
    """Documents as files; the index has an older text of every seventh and lacks every eleventh: those to index."""
    docs, text = _t(spark, d, "documents"), F.col("text")
    old = F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit(" "))).otherwise(text)
    before = docs.where("doc_id % 11 <> 0").select("doc_id", F.sha2(old, 256).alias("hash"))
    return incremental.changed(docs.select("doc_id", F.sha2(text, 256).alias("hash"), "source"), before, ["doc_id", "hash"]).select("doc_id", "source")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s JOIN nation n ON s_nationkey = n_nationkey JOIN part p ON p_size = n_nationkey WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey)")
def stale_removed(spark, d):
    """Pairs sold that a listing by part size and nation does not have."""
    pair = ["l_partkey", "l_suppkey"]
    sold = _t(spark, d, "lineitem").select(*pair)
    suppliers = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_nationkey").alias("p_size"))
    # The listing has a row for each part and supplier that meet in a size; those that nobody sold decide nothing, so sales come first.
    listed = sold.join(suppliers, "l_suppkey").join(_t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), ["l_partkey", "p_size"])
    return incremental.stale(sold.distinct(), listed, pair)


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_upsert(spark, d):
    return incremental.latest(_t(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""WITH f AS (SELECT conv_id AS repo, role || '/' || (turn % 3) AS path, CASE WHEN role = 'system' THEN 'delete' ELSE 'upsert' END AS action, turn FROM conversations)
SELECT repo, path, action FROM f QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY turn DESC) = 1""")
def commit_plan_lww(spark, d):
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("repo"), F.concat("role", F.lit("/"), F.col("turn") % 3).alias("path"), F.lit("").alias("old_path"), F.when(F.col("role") == "system", "D").otherwise("M").alias("status"), F.col("turn").alias("commit_ord"), F.lit(0).alias("file_ord"))
    return incremental.commit_plan(c)


@query("SELECT user_id AS repo_id, min(event_id) AS id, bool_or(value > 50) AS force, count(*) AS merged FROM events GROUP BY 1")
def one_pending_job(spark, d):
    return incremental.pending_jobs(_t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("repo_id"), (F.col("value") > 50).alias("force")))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS jobs, count(*) FILTER (o_orderstatus <> 'P' OR o_orderdate < TIMESTAMP '1998-01-01') AS claimable FROM orders GROUP BY ALL")
def lease_claimable(spark, d):
    o = _t(spark, d, "orders")
    ok = incremental.claimable(F.when(F.col("o_orderstatus") == "P", "indexing").otherwise("idle"), F.col("o_orderdate"), F.expr("timestamp_ntz'1998-01-01'"))
    return o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(ok).alias("claimable"))


@query("""WITH e AS (SELECT event_id, user_id AS client, (event_id * 7) % 400 AS server FROM events),
s AS (SELECT c_custkey FROM customer)
SELECT client, server, count(*) AS calls FROM e WHERE client IN (SELECT c_custkey FROM s) AND server IN (SELECT c_custkey FROM s) GROUP BY ALL""")
def runtime_edges_ingest(spark, d):
    calls = _t(spark, d, "events").select(F.format_string("Customer_%09d", "user_id").alias("client"), F.format_string("customer#%09d", (F.col("event_id") * 7) % 400).alias("server"), F.lit(1).alias("calls"))
    services = _t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("service_id"))
    edges, _ = incremental.runtime_edges(calls, services, keys.service_name_key)
    return edges.select(F.col("client_id").alias("client"), F.col("server_id").alias("server"), "calls")


@query("""WITH c AS (SELECT DISTINCT o_custkey AS repo, o_orderkey AS ord FROM orders), r AS (SELECT *, ord - row_number() OVER (PARTITION BY repo ORDER BY ord) + 1 AS lag, min(ord) OVER (PARTITION BY repo) AS base FROM c)
SELECT repo, max(ord) FILTER (lag = base) AS applied, CASE WHEN bool_or(lag <> base) THEN max(ord) FILTER (lag = base) + 1 END AS first_gap FROM r GROUP BY repo""")
def commit_cursor_gap(spark, d):
    return incremental.contiguous(_t(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("ord")))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, min(ts) AS opened, max(ts) AS closed, count(*) AS n FROM s GROUP BY user_id, s.n""")
def debounce_sessions(spark, d):
    return watch.debounce(_t(spark, d, "events"), "user_id", "ts", "1 hour")


# --- filters and names ----------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size NOT IN (1, 2, 3) AND lower(p_brand) <> '' AND (contains(lower(p_name), 'in') OR contains(lower(p_brand), 'in')) AND p_name LIKE '%g'")
def filter_builder_multi(spark, d):
    cond = predicates.matches(eq={"p_brand": ""}, within={"p_type": ["ECONOMY", "PROMO"], "p_name": []}, without={"p_size": [1, 2, 3]}, contains_fold=(("p_name", "p_brand"), "IN"), suffix=(("p_name",), "g"))
    return _t(spark, d, "part").where(cond).select("p_partkey", "p_name")


_FOLDERS = ["src", "Test", "tests", "latest", "testing", "testdata", "__tests__", "mocks", "mock", "fixtures", "vendor", "node_modules", "genproto", "generated", "load-gen", "load_test", "gatling", "lib/jmeter"]
_FILES = ["a.go", "a_test.go", "a.test.ts", "a.spec.js", "contest.go", "a.pb.go", "a.pb.cc", "a.pb.h", "a_pb2.py", "a_pb2_grpc.py", "a_pb.js", "a_pb.d.ts", "a.proto", "locustfile.py", "LoadGen.java"]


@query(f"""WITH p AS (SELECT page_id, {_FOLDERS}[1 + page_id % {len(_FOLDERS)}] || '/' || {_FILES}[1 + (page_id // 3) % {len(_FILES)}] AS path FROM pages), q AS (SELECT *, lower(path) AS l, '/' || lower(path) AS a FROM p)
SELECT page_id, path, regexp_matches(a, '/(test|tests|testing|testdata|__tests__|mocks|mock|fixtures|vendor|node_modules)/|_test[.]|[.]test[.]|[.]spec[.]') AS is_test,
regexp_matches(a, '/(genproto|generated)/|[.]pb[.](go|cc|h)|_pb2[._]|_pb[.](js|d[.]ts)|[.]proto') AS is_generated, regexp_matches(l, 'locustfile|load[-_]?(gen|test)|/(benchmarks|gatling|jmeter)/') AS is_synthetic FROM q""")
def penalty_paths(spark, d):
    """Paths of all kinds, made of the pages' ids."""
    pick = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), (i % len(names)).cast("int"))
    p = _t(spark, d, "pages").select("page_id", F.concat_ws("/", pick(_FOLDERS, F.col("page_id")), pick(_FILES, F.expr("page_id div 3"))).alias("path"))
    return p.select("*", predicates.is_test_path(F.col("path")).alias("is_test"), predicates.is_generated_path(F.col("path")).alias("is_generated"), predicates.is_synthetic_traffic(F.col("path")).alias("is_synthetic"))


@query("SELECT lang, count(*) AS n FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING bool_or(lang = 'es') AND avg(n_chars) > 100) GROUP BY lang")
def working_set_scope(spark, d):
    docs = _t(spark, d, "documents")
    repos = docs.groupBy(F.col("source").alias("id")).agg((F.bool_or(F.col("lang") == "es") & (F.avg("n_chars") > 100)).alias("active"))
    return predicates.in_working_set(docs, repos, "source").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT p_partkey, p_name, p_type = 'PROMO' AS penalty, p_name = 'red ring' AS exact FROM part WHERE contains(p_name, 'ring'))
SELECT p_partkey, p_name, row_number() OVER (ORDER BY CASE WHEN exact AND NOT penalty THEN 0 ELSE 1 END, penalty, NOT exact, length(p_name), p_partkey) AS rank FROM m QUALIFY rank <= 50""")
def symbol_lookup_tiers(spark, d):
    m = _t(spark, d, "part").where(F.contains("p_name", F.lit("ring"))).select("p_partkey", "p_name", (F.col("p_type") == "PROMO").alias("penalty"), (F.col("p_name") == "red ring").alias("exact"))
    order = [F.when(F.col("exact") & ~F.col("penalty"), 0).otherwise(1), F.col("penalty"), ~F.col("exact"), F.length("p_name"), F.col("p_partkey")]
    top = m.orderBy(*order).limit(50)
    return top.select("p_partkey", "p_name", F.row_number().over(W.orderBy(*order)).cast("long").alias("rank"))


@query("""WITH w AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), c AS (SELECT doc_id, unnest(range(0, greatest(ceil((n - 10) / 8), 0)::INT + 1)) AS ordinal, n FROM w),
x AS (SELECT doc_id, ordinal, ordinal * 8 + 1 AS start_line, least(ordinal * 8 + 10, n) AS end_line FROM c)
SELECT doc_id, ordinal::INT AS ordinal, start_line::INT AS start_line, end_line::INT AS end_line FROM x WHERE start_line <= 15 AND end_line >= 15 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start_line DESC, end_line) = 1""")
def line_containment(spark, d):
    """Of the windows around line 15 of a document the innermost."""
    w = chunks.line_windows(_t(spark, d, "documents"), ["doc_id"], "text", 10, 2).drop("chunk").where(predicates.matches(line=("start_line", "end_line", 15)))
    return resolve.best(w, ["doc_id"], [F.desc("start_line"), F.col("end_line")]).select("doc_id", "ordinal", F.col("start_line").cast("int"), F.col("end_line").cast("int"))


@query(r"""WITH s AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS host, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') AS p FROM pages)
SELECT page_id, host, 'http:GET /' || regexp_replace(regexp_extract(p, '^[^?#]*'), '^/+|/+$', '', 'g') AS key FROM s""")
def http_key_normalize(spark, d):
    s = _t(spark, d, "pages").select("page_id", keys.split_url(F.col("url")).alias("u"))
    return s.select("page_id", "u.host", keys.http_key(F.lit(" get "), F.col("u.path")).alias("key"))


_ROUTES = ["/deep/{a{b{c{d{e{f}}}}}}/x{1}}y", "/pets/{id:[0-9]{2}}", "/a/:id/b", "/x/<int:id>", "/y/[slug]", "/z/*/**", "/u/{id}N{t}/p", "/{open", "/s}t", "/plain/path"]


@query("SELECT * FROM (VALUES ('/deep/{a{b{c{d{e{f}}}}}}/x{1}}y', '/deep/{}/x{}y'), ('/pets/{id:[0-9]{2}}', '/pets/{}'), ('/a/:id/b', '/a/{}/b'), ('/x/<int:id>', '/x/{}'), ('/y/[slug]', '/y/{}'), ('/z/*/**', '/z/{}/{}'), ('/u/{id}N{t}/p', '/u/{}N{}/p'), ('/{open', '/{}'), ('/s}t', '/s}t'), ('/plain/path', '/plain/path')) t(path, reduced)")
def reduce_route_params(spark, d):
    df = spark.createDataFrame([(r,) for r in _ROUTES], "path string")
    return df.select("path", keys.reduce_path(F.col("path")).alias("reduced"))


_DUCK_WORDS = r"list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([^A-Z ])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"SELECT c_custkey, array_to_string({_DUCK_WORDS.format(x='c_mktsegment || c_name')}, ' ') AS words FROM customer")
def word_components(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.array_join(idents.word_components(F.concat("c_mktsegment", "c_name")), " ").alias("words"))


@query(r"""WITH s AS (SELECT DISTINCT p_name, replace(lower(p_name), ' ', '_') AS s FROM part)
SELECT p_name, CASE WHEN regexp_matches(s, '(s|x|z|ch|sh)$') THEN s || 'es' WHEN regexp_matches(s, '[^aeiou]y$') THEN regexp_replace(s, 'y$', '') || 'ies' ELSE s || 's' END AS table_name FROM s""")
def table_name_plural(spark, d):
    return _t(spark, d, "part").select("p_name").distinct().select("p_name", keys.table_name(F.concat(F.lit("*models."), F.initcap("p_name"))).alias("table_name"))


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
s AS (SELECT w, CASE WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%ing' THEN left(w, length(w) - 3) WHEN w LIKE '%ed' THEN left(w, length(w) - 2) WHEN w LIKE '%ss' THEN w WHEN w LIKE '%es' THEN left(w, length(w) - 2) WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END AS t FROM w),
e AS (SELECT w, CASE WHEN t LIKE '%e' THEN left(t, length(t) - 1) ELSE t END AS t FROM s)
SELECT CASE WHEN length(w) < 5 OR length(t) < 4 THEN w ELSE t END AS stem, count(*) AS n FROM e GROUP BY 1""")
def stem_words(spark, d):
    w = _t(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return w.select(idents.stem_word(F.col("w")).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line, count(*) AS n FROM l WHERE length(line) > 20 GROUP BY line HAVING count(*) > 1""")
def dup_line_stats(spark, d):
    line = _t(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return line.where(F.length("line") > 20).groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# --- resolution ------------------------------------------------------------------------------------------------


@query(r"""WITH t(route_id, route_repo, route_method, route_path) AS (VALUES (1, 'r1', 'GET', '/en/{id}'), (2, 'r2', 'ANY', '/{lang}/{id}'), (3, 'r1', 'GET', '/de/{id}'), (4, 'r2', 'POST', '/en/{id}'), (5, 'r2', 'GET', '/fr/{x}')),
c AS (SELECT page_id AS call_id, CASE WHEN url LIKE 'https%' THEN 'r1' ELSE 'r2' END AS repo, regexp_replace(regexp_extract(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '^[^?#]*'), '^/+|/+$', '', 'g') AS p FROM pages),
m AS (SELECT call_id, route_id, repo = route_repo AS same, round(0.95 * CASE WHEN route_method = 'GET' THEN 1.0 WHEN route_method = 'ANY' THEN 0.8 ELSE 0 END * CASE WHEN split_part(route_path, '/', 2) LIKE '{%' THEN 0.95 WHEN lower(split_part(route_path, '/', 2)) = lower(split_part(p, '/', 1)) THEN 1.0 ELSE 0 END * 0.95, 6) AS score
 FROM c JOIN t ON len(string_split(p, '/')) = 2),
r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS s2, lead(same) OVER w AS same2 FROM m WHERE score > 0 WINDOW w AS (PARTITION BY call_id ORDER BY score DESC, same, route_id))
SELECT call_id, route_id, score::DOUBLE AS score, coalesce(score - s2 <= 0.05 AND same = same2, false) AS ambiguous FROM r WHERE n = 1""")
def route_match_best(spark, d):
    routes = spark.createDataFrame([(1, "r1", "GET", "/en/{id}"), (2, "r2", "ANY", "/{lang}/{id}"), (3, "r1", "GET", "/de/{id}"), (4, "r2", "POST", "/en/{id}"), (5, "r2", "GET", "/fr/{x}")], "route_id int, route_repo string, route_method string, route_path string")
    calls = _t(spark, d, "pages").select(F.col("page_id").alias("call_id"), F.when(F.col("url").startswith("https"), "r1").otherwise("r2").alias("repo"), F.lit("GET").alias("method"), keys.trim_query(keys.split_url(F.col("url"))["path"]).alias("path"))
    return resolve.match_routes(calls, routes)


@query("""WITH u AS (SELECT c_custkey AS use_id, c_nationkey::VARCHAR AS repo, 'part' || (c_custkey % 40) AS name FROM customer),
t AS (SELECT s_suppkey AS table_id, s_nationkey::VARCHAR AS table_repo, CASE WHEN s_suppkey % 3 = 0 THEN 'pub.' ELSE '' END || 'part' || (s_suppkey % 30) AS table_name, CASE WHEN s_suppkey % 5 = 0 THEN 'part' || (s_suppkey % 37) END AS entity_name FROM supplier),
m AS (SELECT use_id, table_id, 0 AS tier, repo <> table_repo AS away FROM u JOIN t ON name = table_name
 UNION ALL SELECT use_id, table_id, 1, repo <> table_repo FROM u JOIN t ON table_name LIKE '%.%' AND name = split_part(table_name, '.', 2)
 UNION ALL SELECT use_id, table_id, 2, repo <> table_repo FROM u JOIN t ON name = entity_name),
r AS (SELECT *, dense_rank() OVER (PARTITION BY use_id ORDER BY tier, away) AS l FROM m),
g AS (SELECT use_id, min(table_id) AS table_id, min(tier) AS tier, bool_or(away)::INT AS away, count(*) AS c FROM r WHERE l = 1 GROUP BY use_id),
s AS (SELECT *, [0.95, 0.9, 0.8, 0.7, 0.6] AS steps, CASE WHEN tier = 0 AND away = 0 THEN 1 WHEN tier + away = 1 THEN 2 WHEN tier + away = 2 THEN 3 ELSE 4 END AS k FROM g)
SELECT use_id, table_id, tier, steps[CASE WHEN c > 1 THEN least(k + 1, 5) ELSE k END]::DOUBLE AS confidence FROM s""")
def table_match_tiers(spark, d):
    uses = _t(spark, d, "customer").select(F.col("c_custkey").alias("use_id"), F.col("c_nationkey").cast("string").alias("repo"), F.concat(F.lit("part"), F.col("c_custkey") % 40).alias("name"))
    k = F.col("s_suppkey")
    tables = _t(spark, d, "supplier").select(k.alias("table_id"), F.col("s_nationkey").cast("string").alias("table_repo"), F.concat(F.when(k % 3 == 0, "pub.").otherwise(""), F.lit("part"), k % 30).alias("table_name"), F.when(k % 5 == 0, F.concat(F.lit("part"), k % 37)).alias("entity_name"))
    return resolve.match_tables(uses, tables)


@query("""WITH c AS (SELECT p_partkey AS call_id, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'B' || p_size ELSE p_brand END AS service, p_type AS method FROM part),
i AS (SELECT min(p_partkey) AS impl_id, CASE WHEN p_size % 2 = 0 THEN 'pkg.' ELSE '' END || p_brand AS impl_service, p_type AS method FROM part GROUP BY 2, 3),
m AS (SELECT call_id, impl_id, CASE WHEN service = '' THEN 2 WHEN service = impl_service THEN 0 WHEN suffix(impl_service, '.' || service) THEN 1 ELSE 2 END AS tier FROM c JOIN i USING (method)),
b AS (SELECT *, min(tier) OVER (PARTITION BY call_id) AS l FROM m)
SELECT call_id, min(impl_id) AS impl_id, tier, CASE WHEN count(*) = 1 AND tier < 2 THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence FROM b WHERE tier = l GROUP BY call_id, tier""")
def rpc_match_tiers(spark, d):
    p = _t(spark, d, "part")
    size = F.col("p_size")
    calls = p.select(F.col("p_partkey").alias("call_id"), F.when(size % 4 == 0, "").when(size % 4 == 1, F.concat(F.lit("B"), size)).otherwise(F.col("p_brand")).alias("service"), F.col("p_type").alias("method"))
    impls = p.groupBy(F.concat(F.when(size % 2 == 0, "pkg.").otherwise(""), "p_brand").alias("impl_service"), F.col("p_type").alias("method")).agg(F.min("p_partkey").alias("impl_id"))
    return resolve.match_rpc(calls, impls)


@query("""WITH e AS (SELECT p_partkey AS edge_id, p_type AS repo, p_brand AS file, p_name AS name, p_size % 3 AS r FROM part),
u AS (SELECT p_partkey AS unit_id, p_type AS repo, p_brand AS unit_file, p_name AS name, p_size % 3 AS o, p_size AS pos FROM part WHERE p_size > 25),
c AS (SELECT edge_id, unit_id, pos, r > 0 AND o = r AS owned, file = unit_file AS same FROM e JOIN u USING (repo, name)),
n AS (SELECT *, count(*) FILTER (owned) OVER (PARTITION BY edge_id) AS n_owned, count(*) OVER (PARTITION BY edge_id) AS n_all, CASE WHEN owned AND same THEN 0 WHEN owned THEN 1 WHEN same THEN 2 ELSE 3 END AS tier FROM c)
SELECT edge_id, unit_id, tier, CASE tier WHEN 0 THEN 0.95 WHEN 1 THEN CASE WHEN n_owned = 1 THEN 0.8 ELSE 0.7 END WHEN 2 THEN 0.95 ELSE CASE WHEN n_all = 1 THEN 0.8 ELSE 0.7 END END::DOUBLE AS factor
FROM n QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY tier, pos, unit_id) = 1""")
def local_call_resolve(spark, d):
    p = _t(spark, d, "part")
    of = lambda c: F.when(c % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array((c % 3).cast("string")))
    edges = p.select(F.col("p_partkey").alias("edge_id"), F.col("p_type").alias("repo"), F.col("p_brand").alias("file"), F.col("p_name").alias("name"), of(F.col("p_size")).alias("receiver"))
    units = p.where("p_size > 25").select(F.col("p_partkey").alias("unit_id"), F.col("p_type").alias("repo"), F.col("p_brand").alias("unit_file"), F.col("p_name").alias("name"), F.array(F.lit("x"), (F.col("p_size") % 3).cast("string")).alias("owner"), F.col("p_size").alias("pos"))
    return resolve.resolve_local(edges, units)


@query("""WITH r AS (SELECT c_custkey AS ref_id, c_nationkey % 5 AS repo, CASE WHEN c_custkey % 2 = 0 THEN [(c_custkey % 7)::VARCHAR] ELSE ['a', (c_custkey % 5)::VARCHAR, (c_custkey % 7)::VARCHAR] END AS ref FROM customer),
k AS (SELECT s_suppkey AS key_id, s_nationkey % 5 AS key_repo, [(s_suppkey % 5)::VARCHAR, (s_suppkey % 9)::VARCHAR] AS path FROM supplier),
m AS (SELECT ref_id, key_id, repo, key_repo, CASE WHEN len(ref) <= 2 AND path[3 - len(ref):] = ref THEN 2 WHEN len(ref) >= 2 AND ref[len(ref) - 1:] = path THEN 1 END AS tier FROM r JOIN k ON ref[-1] = path[-1])
SELECT ref_id, key_id, tier FROM m WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY 2 * tier + (repo = key_repo)::INT DESC, key_id) = 1""")
def config_ref_resolve(spark, d):
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    refs = _t(spark, d, "customer").select(k.alias("ref_id"), (F.col("c_nationkey") % 5).alias("repo"), F.when(k % 2 == 0, F.array(text(k % 7))).otherwise(F.array(F.lit("a"), text(k % 5), text(k % 7))).alias("ref"))
    s = F.col("s_suppkey")
    paths = _t(spark, d, "supplier").select(s.alias("key_id"), (F.col("s_nationkey") % 5).alias("key_repo"), F.array(text(s % 5), text(s % 9)).alias("path"))
    return resolve.match_config(refs, paths)


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0 THEN l_discount ELSE l_tax END * 0.8, 6) AS once FROM lineitem")
def confidence_idempotent(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("base"), F.col("l_tax").alias("conf"))
    rows = rows.withColumn("base", F.when(F.col("base") > 0, F.col("base")).otherwise(F.col("conf")))
    once = rows.withColumn("conf", idents.confidence_after_resolve(F.col("base"), F.col("conf"), F.lit(0.8)))
    twice = once.withColumn("conf", idents.confidence_after_resolve(F.col("base"), F.col("conf"), F.when(F.col("base") > 0, 0.8).otherwise(1.0)))
    return twice.select("l_orderkey", "l_linenumber", F.round("conf", 6).alias("once"))


_TOPIC = "json_extract_string(props, '$.k')"


@query(f"""WITH p AS (SELECT {_TOPIC} AS topic, user_id AS src, max(value) AS conf FROM events WHERE event_type = 'click' GROUP BY 1, 2), c AS (SELECT {_TOPIC} AS topic, user_id AS dst, max(value) AS conf FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT topic, count(*) AS pairs, round(sum(least(p.conf, c.conf) * 0.95), 4) AS confidence FROM p JOIN c USING (topic) GROUP BY topic""")
def topic_flow_join(spark, d):
    e = _t(spark, d, "events").withColumn("topic", F.get_json_object("props", "$.k"))
    side = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("topic", F.col("user_id").alias(name)).agg(F.max("value").alias("conf"))
    f = resolve.flows(side("click", "src"), side("purchase", "dst"))
    return f.groupBy("topic").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS repo, regexp_replace(regexp_extract(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '^[^?#]*'), '^/+|/+$', '', 'g') AS path FROM pages)
SELECT page_id, CASE WHEN path = 'en' OR path LIKE 'en/%' THEN 'english' WHEN path = 'fr' OR path LIKE 'fr/%' THEN 'french' WHEN repo LIKE '%.com' THEN 'com' ELSE repo END AS service FROM p""")
def service_longest_prefix(spark, d):
    u = keys.split_url(F.col("url"))
    files = _t(spark, d, "pages").select("page_id", F.regexp_replace(u["host"], "^[a-z]+://", "").alias("repo"), F.regexp_replace(keys.trim_query(u["path"]), "^/+|/+$", "").alias("path"))
    repos = files.select("repo").distinct()
    roots = repos.select("repo", F.explode(F.array(F.struct(F.lit("en").alias("root"), F.lit("english").alias("service")), F.struct(F.lit("fr").alias("root"), F.lit("french").alias("service")))).alias("r")).select("repo", "r.*")
    roots = roots.unionByName(repos.where("repo like '%.com'").select("repo", F.lit("").alias("root"), F.lit("com").alias("service")))
    return resolve.longest_prefix(files, roots).select("page_id", "service")


@query("SELECT l_partkey, l_suppkey, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_suppkey, l_orderkey, l_linenumber) = 1")
def impl_of_contract(spark, d):
    return resolve.best(_t(spark, d, "lineitem"), ["l_partkey"], [F.desc("l_discount"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_suppkey", "l_discount")


# --- graph -----------------------------------------------------------------------------------------------------


@query("""SELECT sn.n_regionkey AS src_repo, sn.n_name AS src_service, cn.n_regionkey AS dst_repo, cn.n_name AS dst_service, 'sells' AS kind, l_returnflag AS via, count(*) AS links, max(l_discount) AS confidence
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey
WHERE sn.n_name <> cn.n_name GROUP BY ALL""")
def service_map(spark, d):
    n = _t(spark, d, "nation")
    sn = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("src_repo"), F.col("n_name").alias("src_service"))
    cn = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("dst_repo"), F.col("n_name").alias("dst_service"))
    e = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(sn, "s_nationkey").join(cn, "c_nationkey")
    return graph.service_links(e.select("src_repo", "src_service", "dst_repo", "dst_service", F.lit("sells").alias("kind"), F.col("l_returnflag").alias("via"), F.col("l_discount").alias("confidence")))


@query(f"""WITH e AS (SELECT {_TOPIC} AS topic, event_type FROM events), m AS (SELECT topic, list_sort(list(DISTINCT event_type) FILTER (event_type IN ('click', 'view'))) AS p, list_sort(list(DISTINCT event_type) FILTER (event_type NOT IN ('click', 'view'))) AS c FROM e GROUP BY topic),
d AS (SELECT DISTINCT p_size::VARCHAR AS topic FROM part)
SELECT coalesce(m.topic, d.topic) AS topic, coalesce(len(p), 0) AS producers, coalesce(len(c), 0) AS consumers, d.topic IS NOT NULL AS declared FROM m FULL JOIN d USING (topic)""")
def topic_map(spark, d):
    e = _t(spark, d, "events").select(F.get_json_object("props", "$.k").alias("topic"), F.when(F.col("event_type").isin("click", "view"), "produces").otherwise("consumes").alias("role"), F.col("event_type").alias("service"))
    m = graph.topic_map(e, _t(spark, d, "part").select(F.col("p_size").cast("string").alias("topic")))
    return m.select("topic", F.size("producers").cast("long").alias("producers"), F.size("consumers").cast("long").alias("consumers"), "declared")


@query("""WITH k AS (SELECT unnest(['click', 'view', 'purchase', 'refund']) AS kind), c AS (SELECT event_type AS kind, count(*) AS c, count(*) FILTER (value > 20) AS e FROM events GROUP BY 1),
s AS (SELECT kind, coalesce(c, 0) AS c, coalesce(e, 0) AS e FROM k LEFT JOIN c USING (kind)), a AS (SELECT * FROM s UNION ALL SELECT 'total', sum(c), sum(e) FROM s)
SELECT kind, c::BIGINT AS candidates, e::BIGINT AS edges, CASE WHEN c <= 0 THEN 1.0 ELSE round(e / c, 6) END::DOUBLE AS ratio FROM a""")
def coverage_report(spark, d):
    counts = _t(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("value") > 20).alias("edges"))
    return graph.coverage(counts, ["click", "view", "purchase", "refund"])


@query("SELECT p_name, count(*) AS units, count(DISTINCT p_brand) AS files FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY p_name HAVING count(*) > 1")
def name_multiplicity(spark, d):
    sold = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return _t(spark, d, "part").join(sold, "p_partkey", "left_semi").groupBy("p_name").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("p_brand").alias("files")).where("units > 1")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, round FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS round FROM lineitem) ORDER BY round, l_suppkey LIMIT 10""")
def callee_round_robin(spark, d):
    r = graph.round_robin(_t(spark, d, "lineitem"), "l_suppkey", [F.col("l_suppkey")], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 10)
    return r.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("round").cast("long").alias("round"))


def _sold(spark, d):
    return _t(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()


_EDGES = "e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e)"


@query(f"WITH {_EDGES}, n AS (SELECT 's' || s_suppkey AS node FROM supplier) SELECT node, 'in' AS direction, src AS far FROM n JOIN e ON dst = node")
def neighbors(spark, d):
    return graph.neighbors(_sold(spark, d), _t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")))


@query(f"""WITH RECURSIVE {_EDGES}, r(node, distance) AS (SELECT 's1', 0 UNION SELECT b, distance + 1 FROM r JOIN u ON a = node WHERE distance < 4)
SELECT node, min(distance)::INT AS distance FROM r GROUP BY node""")
def shortest_path_bfs(spark, d):
    return graph.distances(_sold(spark, d), spark.createDataFrame([("s1",)], "node string"), 4, directed=False)


@query(f"""WITH {_EDGES}, n AS (SELECT 's' || s_suppkey AS node FROM supplier), h AS (SELECT node, b AS far, 1 AS k FROM n JOIN u ON a = node UNION SELECT node, y.b, 2 FROM n JOIN u x ON x.a = node JOIN u y ON y.a = x.b),
m AS (SELECT node, far, min(k) AS distance FROM h WHERE far <> node GROUP BY ALL)
SELECT node, far, distance::INT AS distance FROM m QUALIFY row_number() OVER (PARTITION BY node ORDER BY distance, far) <= 24""")
def expand_khop(spark, d):
    return graph.expand(_sold(spark, d), _t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")), 2)


@query()
def param_trace(spark, d):
    """A fixture: user_id flows on under changing names, over a topic without field names, and around a cycle."""
    rows = [("handler", "create", [("user_id", "uid")], 1.0), ("create", "topic", [("uid", "user_id")], 0.6), ("create", "log", [("msg", "msg")], 1.0), ("topic", "billing", [], 0.6), ("billing", "table", [("user_id", "user_id")], 0.6), ("billing", "topic", [("user_id", "user_id")], 0.6)]
    edges = spark.createDataFrame(rows, "src string, dst string, passed array<struct<from: string, to: string>>, factor double")
    out = graph.trace(edges, spark.createDataFrame([("handler", "user_id")], "node string, name string"))
    return out.select(F.array_join(F.transform("path", lambda x: F.concat(x["node"], F.lit(":"), x["name"])), " > ").alias("chain"), F.round("confidence", 6).alias("confidence"))


@query("""WITH l AS (SELECT DISTINCT sn.n_name AS src, r_name AS dst FROM supplier JOIN nation sn ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'graph LR' || chr(10) || string_agg('  ' || src || ' -->|in| ' || dst, chr(10) ORDER BY src, dst) AS text FROM l""")
def mermaid_export(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(_t(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return graph.mermaid(n.select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit("in").alias("label")).distinct())


# --- retrieval -------------------------------------------------------------------------------------------------

_WINDOWS = """w AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), o AS (SELECT doc_id, l, unnest(range(0, greatest(ceil((len(l) - {n}) / {s}), 0)::BIGINT + 1)) AS ordinal FROM w)
SELECT doc_id, ordinal::INT AS ordinal, (ordinal * {s} + 1)::INT AS start_line, least(ordinal * {s} + {n}, len(l))::INT AS end_line, strlen(array_to_string(l[ordinal * {s} + 1 : ordinal * {s} + {n}], chr(10)))::BIGINT AS bytes FROM o"""


def _windows(spark, d, lines, overlap):
    return chunks.line_windows(_t(spark, d, "documents"), ["doc_id"], "text", lines, overlap).select("doc_id", "ordinal", "start_line", "end_line", F.octet_length("chunk").cast("long").alias("bytes"))


@query("WITH " + _WINDOWS.format(n=60, s=50))
def line_windows(spark, d):
    return _windows(spark, d, 60, 10)


@query("WITH " + _WINDOWS.format(n=10, s=8))
def line_windows_small(spark, d):
    return _windows(spark, d, 10, 2)


@query("""WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), w AS (SELECT doc_id, unnest(range(0, greatest(ceil((n - 10) / 8), 0)::BIGINT + 1)) AS lid, n FROM l), c AS (SELECT doc_id, lid, lid * 8 + 1 AS a, least(lid * 8 + 10, n) AS b FROM w),
s AS (SELECT doc_id, unnest(range(0, (n - 1) // 7 + 1)) AS sid, n FROM l), t AS (SELECT doc_id, sid, sid * 7 + 1 AS a, least(sid * 7 + 7, n) AS b FROM s)
SELECT c.doc_id, lid::INT AS lid, sid::INT AS sid, (least(c.b, t.b) - greatest(c.a, t.a) + 1)::INT AS overlap FROM c JOIN t ON c.doc_id = t.doc_id AND c.a <= t.b AND t.a <= c.b
QUALIFY row_number() OVER (PARTITION BY c.doc_id, lid ORDER BY overlap DESC, t.b - t.a, sid) = 1""")
def dominant_symbol(spark, d):
    docs = _t(spark, d, "documents")
    left = chunks.line_windows(docs, ["doc_id"], "text", 10, 2).select("doc_id", F.col("ordinal").alias("lid"), F.col("start_line").alias("l_start"), F.col("end_line").alias("l_end"))
    n = F.size(F.split("text", "\n"))
    spans = docs.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.expr("(size(split(text, '\n')) - 1) div 7").cast("int"))).alias("sid"))
    right = spans.select("doc_id", "sid", (F.col("sid") * 7 + 1).alias("r_start"), F.least(F.col("sid") * 7 + 7, F.col("n")).alias("r_end"))
    return chunks.best_overlap(left, right, ["doc_id"], [F.col("r_end") - F.col("r_start"), F.col("sid")]).select("doc_id", "lid", "sid", "overlap")


_TERMS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"
_BM25 = f"""q AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS.format(x="text")}) AS term FROM benchmark),
k AS (SELECT doc_id, {_TERMS.format(x="text")} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM k),
h AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM k), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM h WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 10)"""
# A second field, of the source's name, with a boost of 2.
_MULTI = f"""{_BM25},
k2 AS (SELECT doc_id, {_TERMS.format(x="source")} AS t FROM documents), st2 AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM k2),
q2 AS (SELECT DISTINCT query_id, term FROM q UNION SELECT item_id, 'src' || item_id % 20 FROM benchmark),
tf2 AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM k2) WHERE term IN (SELECT term FROM q2) GROUP BY ALL), df2 AS (SELECT term, count(*) AS df FROM tf2 GROUP BY term),
u AS (SELECT query_id, doc_id AS doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL
 UNION ALL SELECT query_id, doc_id, 2 * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) FROM tf2 JOIN df2 USING (term) JOIN q2 USING (term), st2 GROUP BY ALL),
mf AS (SELECT query_id, doc, round(sum(score), 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 4) DESC, doc) AS rank FROM u GROUP BY query_id, doc QUALIFY rank <= 10)"""


def _questions(spark, d):
    """All words of each benchmark text."""
    b = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(keyword.standard_tokens(F.col("text"))).alias("term"))
    return b.distinct()


def _truth(spark, d):
    """(query_id, doc): documents that hold a benchmark text as it is. A text's longest word (of equals the first in
    order) with white space on both sides stands in every document that holds the text, so it is the join key; a text
    without one is compared with all. The words of a document are looked up in the few keys before anything is shuffled."""
    b = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    inner = F.filter(F.split(F.regexp_extract("needle", r"(?s)^\S*\s(.*)\s\S*$", 1), r"\s+"), lambda w: w != "")
    b = b.withColumn("key", F.get(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"])
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    words = docs.select("doc", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("key")).join(b.where("key is not null").select("key").distinct(), "key", "left_semi")
    found = words.join(b, "key").join(docs, "doc").where(F.contains("text", F.col("needle"))).select("query_id", "doc")
    rest = b.where("key is null")
    return found if rest.isEmpty() else found.union(docs.join(rest, F.contains(docs["text"], rest["needle"])).select("query_id", "doc"))


def _bm25(spark, d):
    return keyword.top_k(keyword.scores(_t(spark, d, "documents"), "doc_id", keyword.standard_tokens(F.col("text")), _questions(spark, d), k=10), 10)


@query(f"WITH {_BM25} SELECT query_id, doc, score, rank FROM bm")
def bm25_topk(spark, d):
    return _bm25(spark, d).withColumn("rank", F.col("rank").cast("long"))


def _multi(spark, d):
    docs = _t(spark, d, "documents")
    names = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("term"))
    text = keyword.scores(docs, "doc_id", keyword.standard_tokens(F.col("text")), _questions(spark, d))
    source = keyword.scores(docs, "doc_id", keyword.standard_tokens(F.col("source")), _questions(spark, d).union(names).distinct(), 2.0)
    return keyword.top_k(text.unionByName(source).groupBy("query_id", "doc").agg(F.sum("score").alias("score")), 10)


@query(f"WITH {_MULTI} SELECT query_id, doc, score, rank FROM mf")
def bm25_multifield(spark, d):
    """Two fields, each with statistics of its own, summed: the text, and the source, which questions name."""
    return _multi(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_BM25}, f AS (SELECT s.query_id, s.doc, s.score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s JOIN documents ON doc = doc_id WHERE lang IN ('en', 'de') AND source <> 'src0' QUALIFY rank <= 10) SELECT * FROM f")
def bm25_filtered(spark, d):
    """Filters choose among the hits; the statistics are those of the whole index."""
    docs = _t(spark, d, "documents")
    allowed = docs.where(predicates.matches(within={"lang": ["en", "de"]}, without={"source": ["src0"]})).select(F.col("doc_id").alias("doc"))
    hits = keyword.scores(docs, "doc_id", keyword.standard_tokens(F.col("text")), _questions(spark, d)).join(allowed, "doc", "left_semi")
    return keyword.top_k(hits, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_MULTI}, tr AS (SELECT DISTINCT item_id AS query_id, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
a AS (SELECT query_id, min(rank) AS first_a FROM bm JOIN tr USING (query_id, doc) GROUP BY 1), b AS (SELECT query_id, min(rank) AS first_b FROM mf JOIN tr USING (query_id, doc) GROUP BY 1)
SELECT query_id, first_a, first_b, CASE WHEN coalesce(first_b, 99) < coalesce(first_a, 99) THEN 'better' WHEN coalesce(first_b, 99) > coalesce(first_a, 99) THEN 'worse' ELSE 'same' END AS verdict FROM a FULL JOIN b USING (query_id)""")
def ab_compare(spark, d):
    """One field against two: the first accepted document of each question in both runs."""
    truth = _truth(spark, d)
    first = lambda hits: hits.join(truth, ["query_id", "doc"]).groupBy("query_id").agg(F.min("rank").cast("long").alias("first"))
    return evaluation.compare(first(_bm25(spark, d)), first(_multi(spark, d)))


@query(f"""WITH {_BM25}, m AS (SELECT bm.*, sqrt(doc + 1) AS model, max(score) FILTER (rank <= 4) OVER w AS hi, min(score) FILTER (rank <= 4) OVER w AS lo, max(score) FILTER (rank > 4) OVER w AS tail, max(sqrt(doc + 1)) FILTER (rank <= 4) OVER w AS mh, min(sqrt(doc + 1)) FILTER (rank <= 4) OVER w AS ml FROM bm WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc, round(CASE WHEN rank > 4 OR mh = ml THEN score ELSE greatest(lo, coalesce(tail, lo)) + (hi - greatest(lo, coalesce(tail, lo))) * (model - ml) / (mh - ml) END, 5) AS blended FROM m""")
def rerank_blend(spark, d):
    """The first four hits of each question, ordered anew by a stand-in for a model that scores documents by their id."""
    hits = _bm25(spark, d).withColumn("model", F.sqrt(F.col("doc") + 1.0))
    return fusion.rerank_blend(hits, 4).select("query_id", "doc", F.round("blended", 5).alias("blended"))


_VECTOR = """qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
sc AS (SELECT query_id, vec_id AS doc, round(list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS score FROM embeddings, qv),
ve AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM sc QUALIFY rank <= 10)"""


def _vectors(spark, d):
    """Queries: every vector whose id is divisible by 50, against all."""
    e = _t(spark, d, "embeddings")
    return fusion.nearest(e, "vec_id", "embedding", e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10, 5)


@query(f"WITH {_VECTOR} SELECT query_id, doc, score, rank FROM ve")
def vector_topk(spark, d):
    return _vectors(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_VECTOR}, f AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM sc JOIN embeddings ON doc = vec_id WHERE label NOT IN (0, 3) QUALIFY rank <= 5) SELECT * FROM f")
def vector_topk_filtered(spark, d):
    """Filters hold before the neighbours are taken, so that there are as many as asked for."""
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return fusion.nearest(e.where(predicates.matches(without={"label": [0, 3]})), "vec_id", "embedding", q, 5, 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_BM25}, {_VECTOR}, x AS (SELECT query_id, doc, 1 / (60 + rank) AS x FROM bm UNION ALL SELECT query_id // 50, doc, 1 / (60 + rank) FROM ve) SELECT query_id, doc, round(sum(x), 8) AS fused FROM x GROUP BY ALL")
def rrf_fusion(spark, d):
    vec = _vectors(spark, d).withColumn("query_id", F.expr("query_id div 50"))
    return fusion.rrf([(_bm25(spark, d), 1.0), (vec, 1.0)])


@query(f"""WITH {_BM25}, {_VECTOR}, a AS (SELECT query_id, doc, score, least(0, min(score) OVER w) AS lo, max(score) OVER w AS hi FROM bm WINDOW w AS (PARTITION BY query_id) UNION ALL SELECT query_id // 50, doc, score, least(0, min(score) OVER w), max(score) OVER w FROM ve WINDOW w AS (PARTITION BY query_id))
SELECT query_id, doc, round(sum(0.5 * CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END), 6) AS fused FROM a GROUP BY ALL""")
def convex_fusion(spark, d):
    vec = _vectors(spark, d).withColumn("query_id", F.expr("query_id div 50"))
    return fusion.convex([(_bm25(spark, d), 0.5), (vec, 0.5)], 6)


@query()
def fusion_overlap_cluster(spark, d):
    """Two sources cut documents into unlike windows and rank them by length and by place: windows that overlap are one hit."""
    docs = _t(spark, d, "documents")
    a = chunks.line_windows(docs, ["doc_id"], "text", 10, 2).select("*", F.lit(0).alias("source"), F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.length("chunk")), "ordinal")).alias("rank"))
    b = chunks.line_windows(docs, ["doc_id"], "text", 16, 0).select("*", F.lit(1).alias("source"), (F.col("ordinal") + 1).alias("rank"))
    hits = a.unionByName(b).select("doc_id", "source", "rank", F.concat_ws("-", "start_line", "end_line").alias("doc"), "start_line", "end_line", (1 / (fusion.RRF_K + F.col("rank"))).alias("worth"))
    out = fusion.cluster(hits, ["doc_id"])
    return out.select("doc_id", "doc", "start_line", "end_line", F.round("score", 8).alias("fused"), F.size("sources").alias("n_sources"))


@query()
def merge_spans(spark, d):
    """Overlapping windows of each document, ranked by length: kept and widened spans."""
    w = chunks.line_windows(_t(spark, d, "documents"), ["doc_id"], "text", 10, 2)
    hits = w.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.length("chunk")), "ordinal")).alias("rank"), "start_line", "end_line", F.length("chunk").cast("double").alias("score"))
    return fusion.merge_spans(hits, ["doc_id"])


@query("""WITH r AS (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS running_bytes FROM conversations) SELECT * FROM r WHERE running_bytes <= 4096""")
def byte_budget_prefix(spark, d):
    c = _t(spark, d, "conversations")
    return fusion.byte_budget(c, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], F.octet_length("text"), 4096).select("conv_id", "turn", "running_bytes")


@query(f"""WITH {_BM25}, tr AS (SELECT DISTINCT item_id AS query_id, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
g AS (SELECT query_id, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM bm JOIN tr USING (query_id, doc) GROUP BY query_id),
i AS (SELECT query_id, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda x: 1 / log2(x + 1))) AS idcg FROM tr GROUP BY query_id),
a AS (SELECT item_id, first, dcg, idcg FROM benchmark LEFT JOIN g ON item_id = g.query_id LEFT JOIN i ON item_id = i.query_id)
SELECT round(avg((coalesce(first, 99) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(first, 99) <= 5)::INT), 6) AS recall_5, round(avg((coalesce(first, 99) <= 10)::INT), 6) AS recall_10, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg / idcg, 0)), 6) AS ndcg10, sum((first IS NULL)::INT)::BIGINT AS missed, count(*) AS n FROM a""")
def recall_mrr(spark, d):
    """Ground truth: the documents that hold a benchmark text."""
    b = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return evaluation.metrics(_bm25(spark, d), _truth(spark, d), b, (1, 5, 10))
