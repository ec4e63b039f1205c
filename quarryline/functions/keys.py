"""Contract keys: the strings by which services meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .idents import word_components

# Request methods.
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


def trim_query(path: Column) -> Column:
    return F.regexp_extract(path, r"^[^?#]*", 0)


def is_path_param(segment: Column) -> Column:
    return segment.rlike(r"^[{:\[<]|^\*{1,2}$")


def reduce_segment(segment: Column) -> Column:
    """Parameters of a path segment become {}, however deep their braces; an unclosed brace takes the rest, a stray closing one goes."""

    def step(s: Column, c: Column) -> Column:
        out, depth = s["out"], s["depth"]
        state = lambda o, d: F.struct(o.alias("out"), d.alias("depth"))
        plain = lambda x: F.when(depth == 0, F.concat(out, x)).otherwise(out)
        return F.when(c == "{", state(plain(F.lit("{}")), depth + 1)).when(c == "}", state(out, F.greatest(depth - 1, F.lit(0)))).otherwise(state(plain(c), depth))

    holes = F.aggregate(F.split(segment, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("depth")), step, lambda s: s["out"])
    return F.when(segment.rlike(r"^[:<\[]|^\*{1,2}$"), F.lit("{}")).when(~segment.contains("{"), segment).otherwise(holes)


def reduce_path(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/"), reduce_segment), "/")


def http_key(method: Column, path: Column) -> Column:
    verb = F.upper(F.trim(F.coalesce(method, F.lit(""))))
    tidy = F.concat(F.lit("/"), F.regexp_replace(trim_query(F.trim(path)), r"^/+|/+$", ""))
    return F.concat(F.lit("http:"), F.when(verb == "", F.lit("ANY")).otherwise(verb), F.lit(" "), reduce_path(tidy))


def grpc_key(service: Column, method: Column) -> Column:
    return F.concat(F.lit("grpc:"), service, F.lit("/"), method)


def topic_key(name: Column) -> Column:
    return F.concat(F.lit("topic:"), name)


def topic_ref(name: Column) -> Column:
    return F.concat(F.lit("topic:${"), name, F.lit("}"))


def db_key(name: Column) -> Column:
    return F.concat(F.lit("db:"), name)


def config_key(path: Column) -> Column:
    return F.concat(F.lit("config:"), path)


def parse_http(key: Column) -> Column:
    """struct(method, path) of an http key; a key without a method is ANY."""
    rest = F.regexp_replace(key, "^http:", "")
    verb = F.regexp_extract(rest, r"^([A-Za-z]+) ", 1)
    return F.struct(F.when(verb == "", F.lit("ANY")).otherwise(F.upper(verb)).alias("method"), F.regexp_replace(rest, r"^[A-Za-z]+ ", "").alias("path"))


def parse_grpc(key: Column) -> Column:
    rest = F.regexp_replace(key, "^grpc:", "")
    return F.struct(F.when(rest.contains("/"), F.regexp_extract(rest, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("")).alias("service"), F.regexp_extract(rest, r"[^/]*$", 0).alias("method"))


def parse_topic_ref(key: Column) -> Column:
    """The reference's name; empty for a topic that is known."""
    return F.regexp_extract(key, r"^topic:\$\{(.*)\}$", 1)


def is_kind(key: Column, kind: str) -> Column:
    return key.startswith(kind + ":")


def trim_kind(key: Column, kind: str) -> Column:
    return F.when(is_kind(key, kind), F.substring(key, len(kind) + 2, 1 << 30)).otherwise(key)


def canonical_via(key: Column) -> Column:
    return F.when(is_kind(key, "http"), F.lower(parse_http(key)["path"])).otherwise(key)


def table_name(entity: Column) -> Column:
    """The table an entity maps to: its words in snake case, in the plural."""
    name = F.substring_index(F.regexp_replace(F.trim(entity), r"^[*&]+", ""), ".", -1)
    s = F.array_join(word_components(name), "_")
    return F.when(s == "", s).when(s.rlike("(s|x|z|ch|sh)$"), F.concat(s, F.lit("es"))).when(s.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(s, "y$", ""), F.lit("ies"))).otherwise(F.concat(s, F.lit("s")))


def sql_table_name(name: Column) -> Column:
    return F.array_join(F.transform(F.split(F.lower(F.trim(name)), r"\."), lambda p: F.regexp_replace(p, r"^[\"`\[\]']+|[\"`\[\]']+$", "")), ".")


def split_url(url: Column) -> Column:
    """struct(host: scheme and host, path); a path alone has no host."""
    return F.struct(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0).alias("host"), F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "").alias("path"))


def service_name_key(name: Column) -> Column:
    return F.array_join(word_components(name), "")


def normalize_repo_ref(ref: Column) -> Column:
    out = F.lower(F.trim(ref))
    out = F.regexp_replace(F.regexp_replace(out, r"^[a-z+]+://", ""), r"^[^@/]+@", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"/+$", ""), r"\.git$", ""), "^([^/:]+):", "$1/")


def repo_id(name: Column, url: Column) -> Column:
    return F.concat(name, F.lit("-"), F.substring(F.sha2(F.concat(name, F.lit("\0"), url), 256), 1, 12))


def chunk_uuid(repo: Column, path: Column, start: Column, end: Column) -> Column:
    h = F.sha2(F.concat_ws("\0", repo, path, F.concat(start.cast("string"), F.lit("-"), end.cast("string"))), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
