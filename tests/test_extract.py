from quarryline.extract import extractors
from quarryline.plans import estate


def test_links_of_the_estate(spark):
    got = {(r.src_service, r.dst_service, r.kind) for r in estate.estate_links(spark, "").collect()}
    assert got == {("web", "edge", "http_call"), ("edge", "orders", "rpc_call"), ("orders", "billing", "kafka_flow"), ("orders", "stats", "kafka_flow"), ("billing", "mail", "http_call")}


def test_units_and_edges(spark):
    rows = estate.estate_extract(spark, "").collect()
    assert not [r for r in rows if r.record == "error"]
    units = {(r.repo_id, r.kind, r.qualified) for r in rows if r.record == "unit"}
    assert {("shop", "http_route", "http:POST /api/orders"), ("shop", "http_route", "http:GET /api/orders/{}"), ("shop", "rpc_method", "grpc:shop.v1.OrderService/PlaceOrder"), ("shop", "field", "shop.v1.PlaceRequest.user_id"), ("orders", "method", "server.PlaceOrder"), ("billing", "method", "Listener.onPlaced"), ("mail", "http_route", "http:POST /api/mail/send"), ("stats", "db_table", "db:order_events"), ("stats", "column", "order_events.user_id"), ("stats", "config_key", "config:topics.orders_topic")} <= units
    assert not any(q.endswith(".primary") for _, _, q in units)
    edges = {(r.repo_id, r.kind, r.qualified, r.src_name) for r in rows if r.record == "edge"}
    assert {("shop", "handled_by", "createOrder", "http:POST /api/orders"), ("shop", "http_call", "http:GET /api/orders/{}", "readOrder"), ("stats", "consumes", "topic:${ORDERS_TOPIC}", "run"), ("stats", "writes_to", "db:order_events", "run"), ("orders", "produces", "topic:orders.placed", "server.PlaceOrder"), ("shop", "call", "render", "showOrder")} <= edges


def test_more_snippets():
    of = lambda lang, text: {(r["record"], r["kind"], r["qualified"]) for r in extractors.extract_file("r", "f", lang, text)}
    assert ("unit", "http_route", "http:GET /v1/items/{}") in of("python", '@app.get("/v1/items/{item_id}")\nasync def item(item_id):\n    return requests.get(f"http://stock/api/{item_id}")\n')
    assert ("edge", "http_call", "http:GET /api/{}") in of("python", 'def f(i):\n    return requests.get(f"http://stock/api/{i}")\n')
    assert ("unit", "http_route", "http:GET /pets/{}") in of("java", '@RequestMapping("/pets")\npublic class Pets {\n  @GetMapping("/{id}")\n  public Pet one(String id) {\n    return null;\n  }\n}\n')
    assert ("unit", "topic_channel", "topic:orders.placed") in of("yaml", "asyncapi: 2.0.0\nchannels:\n  orders.placed:\n    publish:\n      message: x\n")
    assert ("unit", "http_route", "http:GET /pets/{}") in of("yaml", "openapi: 3.0.0\npaths:\n  /pets/{id}:\n    get:\n      summary: x\n")
    assert ("unit", "config_key", "config:a.b") in of("json", '{"a": {"b": 1}}') and ("unit", "config_key", "config:a.b") in of("properties", "a.b=1\n")
    assert {k for r, k, _ in of("json", "{broken") if r == "error"} == {"JSONDecodeError"}
    assert of("go", "") == set()
