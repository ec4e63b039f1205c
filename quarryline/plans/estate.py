"""A small estate of six services in six languages, and queries that extract and link it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..extract import extractors, linking
from ..operators import promote
from ..sources import files as sources
from .catalogue import query

FILES = {
    ("shop", "web/package.json"): '{"name": "web", "version": "1"}',
    ("shop", "web/src/cart.ts"): "import axios from 'axios';\nexport async function placeOrder(order) {\n  return axios.post('/api/orders', order);\n}\nexport async function readOrder(id) {\n  return axios.get(`/api/orders/${id}`);\n}\n",
    ("shop", "edge/go.mod"): "module edge\n",
    ("shop", "edge/main.go"): 'package main\n\nfunc main() {\n\trouter.POST("/api/orders", createOrder)\n\trouter.GET("/api/orders/:id", showOrder)\n}\n\nfunc createOrder(c Ctx) {\n\torders := pb.NewOrderServiceClient(conn)\n\torders.PlaceOrder(ctx, &pb.PlaceRequest{UserId: c.UserID})\n}\n\nfunc showOrder(c Ctx) {\n\trender(c)\n}\n',
    ("shop", "proto/orders.proto"): 'syntax = "proto3";\npackage shop.v1;\nmessage PlaceRequest {\n  string user_id = 1;\n}\nmessage PlaceReply {}\nservice OrderService {\n  rpc PlaceOrder(PlaceRequest) returns (PlaceReply);\n}\n',
    ("orders", "go.mod"): "module orders\n",
    ("orders", "server.go"): 'package main\n\nconst placedTopic = "orders.placed"\n\ntype server struct {\n\tpb.UnimplementedOrderServiceServer\n}\n\nfunc (s *server) PlaceOrder(ctx Context, r *pb.PlaceRequest) (*pb.PlaceReply, error) {\n\ts.writer.WriteMessages(ctx, kafka.Message{Topic: placedTopic, Value: encode(r.UserId)})\n\treturn nil, nil\n}\n',
    ("billing", "pom.xml"): "<project/>",
    ("billing", "src/Listener.java"): 'package b;\n\nclass Listener {\n  @KafkaListener(topics = "orders.placed")\n  public void onPlaced(String userId) {\n    rest.postForEntity(base + "/api/mail/send", userId, Void.class);\n  }\n}\n',
    ("mail", "package.json"): "{}",
    ("mail", "mail.csproj"): "<Project/>",
    ("mail", "MailController.cs"): 'namespace M;\n[ApiController]\n[Route("api/[controller]")]\npublic class MailController : ControllerBase\n{\n    [HttpPost("send")]\n    public IActionResult Send(string userId)\n    {\n        return Ok();\n    }\n}\n',
    ("stats", "requirements.txt"): "",
    ("stats", "app.yaml"): "topics:\n  orders_topic: orders.placed\n",
    ("stats", "app.py"): 'import os\n\nORDERS = os.getenv("ORDERS_TOPIC")\n\n\ndef run(db):\n    consumer = KafkaConsumer(ORDERS)\n    for m in consumer:\n        db.execute("INSERT INTO order_events (user_id, at) VALUES (1, 2)")\n',
    ("stats", "db/001.sql"): "CREATE TABLE order_events (\n  user_id TEXT NOT NULL,\n  at TIMESTAMP,\n  PRIMARY KEY (user_id)\n);\n",
}


def _files(spark):
    rows = spark.createDataFrame([(repo, path, text) for (repo, path), text in FILES.items()], "repo_id string, path string, content string")
    return rows.withColumn("language", sources.language(F.col("path")))


@query()
def estate_extract(spark, d):
    f = _files(spark)
    return extractors.extract(f.where("language is not null"))


@query()
def estate_links(spark, d):
    f = _files(spark)
    return linking.link(f, extractors.extract(f.where("language is not null")), sources.services(f))


#: Questions and what they ask the callers of; null: not such a question.
INTENTS = [
    ("What calls the OrderService?", "OrderService"), ("which class listens to order events", "order events"), ("who constructs the PaymentGateway", "PaymentGateway"),
    ("what loads tax rates", "tax rates"), ("who emits  OrderPlaced", "OrderPlaced"), ("who dispatches the audit command", "audit command"), ("what code writes to the ledger", "ledger"),
    ("where is the retry policy wired up", "retry policy"), ("where is a config map used?", "config map"), ("where are sessions created in the web app", "sessions"),
    ("where does the edge service register routes", "routes"), ("where does POST /api/x go", None), ("callers of placeOrder", "placeOrder"), ("list all call sites of chargeCard", "chargeCard"),
    ("how does billing validate that a sku exists", "sku exists"), ("how does the gateway talk to stock", "stock"), ("what is an order", None), ("where is the schema defined", None),
    ("кто вызывает placeOrder", "placeOrder"), ("какой сервис публикует orders.placed", "orders.placed"), ("где используется кеш", "кеш"), ("who uses it", None),
]
#: Questions, contract keys, and how many words of the key the question spells out (null: not the key).
DESCRIBED = [
    ("who calls order item", "http:GET /api/v1/order/item", 2), ("which code gets basket items", "grpc:BasketApi.Basket/GetBasketItems", None), ("who calls get basket items", "grpc:BasketApi.Basket/GetBasketItems", 4), ("who handles events", "topic:events", None),
    ("who handles changed product prices", "topic:ProductPriceChangedIntegrationEvent", 3), ("which service posts an order item", "http:GET /order/item/{id}", None),
    ("which service posts an order item", "http:POST /order/item/{id}", 2), ("who creates", "grpc:shop.Carts/Create", None), ("who creates carts", "grpc:shop.Carts/Create", 2),
    ("read the owners", "http:GET /owners", None), ("the orders queue", "topic:orders", 1), ("the orders queue", "topic:${ORDERS}", None), ("who ships orders", "db:orders", None),
]
#: Questions and the contract keys that they name.
NAMED = [
    ("which code handles POST /api/orders/:id and writes the login_attempt table or topic orders.created via CartService/AddItem", "http:POST /api/orders/{} db:login_attempt topic:orders.created grpc:CartService/AddItem"),
    ("the database table and a message queue", ""), ("who reads table named 'users'?", "db:users db:reads"), ("the payments queue, and rpc method Charge", "topic:payments grpc:/Charge"),
    ("GET /health, then DELETE /users/{id}", "http:GET /health http:DELETE /users/{}"), ("topics of the estate", ""),
]


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


@query(_values(INTENTS, "question, callee"))
def callers_intent(spark, d):
    df = spark.createDataFrame([(q,) for q, _ in INTENTS], "question string")
    return df.select("question", promote.callee(F.col("question")).alias("callee"))


@query(_values(DESCRIBED, "question, key, words"))
def key_described(spark, d):
    df, q = spark.createDataFrame([r[:2] for r in DESCRIBED], "question string, key string"), F.col("question")
    return df.select("question", "key", promote.key_described(F.col("key"), promote.question_words(q), promote.verbs_named(q)).alias("words"))


@query(_values(NAMED, "question, keys"))
def contract_keys_in_query(spark, d):
    df = spark.createDataFrame([(q,) for q, _ in NAMED], "question string")
    return df.select("question", F.array_join(promote.contract_keys(F.col("question")), " ").alias("keys"))
