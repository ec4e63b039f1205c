"""Files to units and edges (C1-C19): a scanner with rules per language, run over Arrow batches of files.

There is no parser for most of these languages here, so definitions and contract sites are found by pattern and
spans by braces or indentation. A file that cannot be read this way gives an error row, never a failed job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules

FIELDS = [("repo_id", pa.string()), ("file_path", pa.string()), ("record", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("qualified", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("src_name", pa.string()), ("confidence", pa.float64()), ("detail", pa.string())]
SCHEMA = "repo_id string, file_path string, record string, kind string, name string, qualified string, start_line int, end_line int, src_name string, confidence double, detail string"
MAX_CONFIG_KEYS = 500


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _end(text: str, at: int, language: str) -> int:
    """The line on which what starts at `at` ends."""
    if language == "python":
        lines, first = text.split("\n"), _line(text, at + len(text[at:]) - len(text[at:].lstrip()))
        depth = len(lines[first - 1]) - len(lines[first - 1].lstrip())
        last = first
        for i in range(first, len(lines)):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= depth:
                    break
                last = i + 1
        return last
    depth, i = 0, text.find("{", at)
    while 0 <= i < len(text):
        if text[i] in "\"'`":
            j = i + 1
            while j < len(text) and text[j] != text[i] and (text[i] == "`" or text[j] != "\n"):
                j += 1 + (text[j] == "\\")
            i = j
        elif text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if depth == 0:
                return _line(text, i)
        i += 1
    return _line(text, len(text))


def template_path(raw: str) -> str | None:
    """A URL or path literal with its interpolations as {}; None if it isn't one."""
    path = re.sub(r"\$\{[^}]*\}|\{[^{}]*\}|%[sdv]|<[^<>]*>|(?<=/):\w+", "{}", raw)
    path = re.sub(r"^(?:\{\}|[a-z]+://[^/]+)(?=/)", "", path)
    return path if path.startswith("/") and " " not in path else None


class _File:
    def __init__(self, repo: str, path: str, language: str, text: str) -> None:
        self.repo, self.path, self.language, self.text = repo, path, language, text
        self.rows: list[dict] = []
        self.spans: list[tuple[int, int, str]] = []
        self.constants = {m["name"]: m["value"] for m in rules.CONSTANT.finditer(text)}
        self.config = {m["name"]: m["key"] for m in rules.CONFIG_REF.finditer(text)}

    def unit(self, kind: str, name: str, qualified: str, start: int, end: int, detail: str = "") -> None:
        self.rows.append({"record": "unit", "kind": kind, "name": name, "qualified": qualified, "start_line": start, "end_line": end, "src_name": "", "confidence": 1.0, "detail": detail})

    def edge(self, kind: str, target: str, line: int, confidence: float, detail: str = "") -> None:
        inside = [s for s in self.spans if s[0] <= line <= s[1]]
        src = min(inside, key=lambda s: s[1] - s[0])[2] if inside else ""
        self.rows.append({"record": "edge", "kind": kind, "name": target, "qualified": target, "start_line": line, "end_line": line, "src_name": src, "confidence": confidence, "detail": detail})

    def topic(self, m: re.Match) -> str | None:
        g = m.groupdict()
        if name := g.get("topic") or g.get("topic2"):
            return f"topic:{name}"
        if ref := (g.get("ref") or g.get("ref2") or "").rpartition(".")[2]:
            if ref in self.config:
                return "topic:${" + self.config[ref] + "}"
            if ref in self.constants:
                return f"topic:{self.constants[ref]}"
        return None

    def code(self) -> None:
        text, taken = self.text, set()
        for kind, pattern, _ in rules.DEFINITIONS[self.language]:
            for m in pattern.finditer(text):
                at = m.start() + len(m[0]) - len(m[0].lstrip())
                if (line := _line(text, at)) in taken or m["name"] in rules.KEYWORDS:
                    continue
                taken.add(line)
                end = _end(text, m.start("name") if self.language != "python" else at, self.language)
                owner = m.groupdict().get("owner") or next((s[2] for s in self.spans if s[0] <= line <= s[1] and kind in ("method", "function") and self.language != "go"), "")
                qualified = f"{owner}.{m['name']}" if owner else m["name"]
                if kind in ("class", "type"):
                    self.spans.append((line, end, m["name"]))
                else:
                    self.spans.append((line, end, qualified))
                self.unit(kind, m["name"], qualified, line, end, text[at:].split("\n", 1)[0].strip())
        base, entities, stubs = "", {}, {}
        for kind, pattern, conf in rules.SITES[self.language]:
            for m in pattern.finditer(text):
                g, line = m.groupdict(), _line(text, m.start())
                if kind == "route_base":
                    base = g["path"].replace("[controller]", (g.get("name") or "").removesuffix("Controller").lower())
                elif kind == "http_route":
                    path = "/".join(x.strip("/") for x in ("", base, g.get("path") or "") if x is not None).replace("//", "/")
                    key = f"http:{(g.get('verb') or 'ANY').upper()} {template_path('/' + path.strip('/')) or '/'}"
                    self.unit("http_route", key.partition(":")[2], key, line, line)
                    if g.get("handler"):
                        self.rows.append({"record": "edge", "kind": "handled_by", "name": g["handler"].rpartition(".")[2], "qualified": g["handler"].rpartition(".")[2], "start_line": line, "end_line": line, "src_name": key, "confidence": conf, "detail": ""})
                elif kind == "http_call":
                    if path := template_path(g["path"]):
                        verb = (g.get("verb") or g.get("verb2") or "GET").upper().removesuffix("FORM")
                        self.edge(kind, f"http:{verb} {path}", line, conf if "{}" not in path else 0.7)
                elif kind in ("produces", "consumes"):
                    if topic := self.topic(m):
                        self.edge(kind, topic, line, conf)
                elif kind == "rpc_client":
                    stubs[g["var"]] = g["service"]
                elif kind == "implements_service":
                    for s in list(self.spans):
                        if "." in s[2] or self.language != "go":
                            self.rows.append({"record": "edge", "kind": "implements_rpc", "name": f"grpc:{g['service']}/{s[2].rpartition('.')[2]}", "qualified": f"grpc:{g['service']}/{s[2].rpartition('.')[2]}", "start_line": s[0], "end_line": s[0], "src_name": s[2], "confidence": conf, "detail": "candidate"})
                elif kind == "entity":
                    entities[g["entity"]] = g["table"]
                    self.unit("db_table", g["table"], f"db:{g['table'].lower()}", line, line, g["entity"])
                elif g.get("entity"):
                    self.edge(kind, "entity:" + g["entity"], line, conf)
        for m in re.finditer(r"\"\"\"(.*?)\"\"\"|`([^`]*)`|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'", text, re.S):
            body = next((x for x in m.groups() if x is not None), "")
            if rules.SQL_START.search(body):
                for q in rules.SQL_TEXT.finditer(body):
                    columns = re.findall(r"\w+", q["cols"] or "")
                    self.edge("writes_to" if q["write"] else "reads_from", f"db:{q['table'].strip('\"`').lower()}", _line(text, m.start()), 0.9, ",".join(columns))
        for s in [s for s in self.rows if s["record"] == "unit" and s["kind"] in ("function", "method")]:
            first = s["start_line"]
            for i, row in enumerate(text.split("\n")[first : s["end_line"]], first + 1):
                for m in rules.CALL.finditer(row):
                    if m["recv"] in stubs:
                        self.edge("rpc_call", f"grpc:{stubs[m['recv']]}/{m['name']}", i, 0.9)
                    elif m["name"] not in rules.KEYWORDS:
                        self.edge("call", m["name"], i, 0.9, m["recv"] or "")

    def proto(self) -> None:
        package, scope = "", []
        for i, raw in enumerate(self.text.split("\n"), 1):
            row = raw.split("//")[0]
            if m := re.match(r"\s*package\s+([\w.]+)", row):
                package = m[1] + "."
            if m := re.match(r"\s*(service|message|enum)\s+(\w+)", row):
                scope.append((m[1], m[2]))
                self.unit(m[1], m[2], package + m[2], i, i)
                if "{" in row and "}" in row:
                    scope.pop()
                continue
            if m := re.match(r"\s*rpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)", row):
                service = next((n for k, n in reversed(scope) if k == "service"), "")
                self.unit("rpc_method", m[1], f"grpc:{package}{service}/{m[1]}", i, i, f"{m[2]} -> {m[3]}")
                for kind, target in (("rpc_request", m[2]), ("rpc_response", m[3])):
                    self.rows.append({"record": "edge", "kind": kind, "name": target, "qualified": target, "start_line": i, "end_line": i, "src_name": f"grpc:{package}{service}/{m[1]}", "confidence": 0.95, "detail": ""})
                if row.rstrip().endswith("{"):
                    scope.append(("rpc", m[1]))
                continue
            if (m := re.search(r"\b(get|post|put|delete|patch):\s*\"([^\"]+)\"", row)) and scope:
                self.unit("http_route", f"{m[1].upper()} {m[2]}", f"http:{m[1].upper()} {template_path(m[2])}", i, i)
            elif scope and scope[-1][0] == "message" and (m := re.match(r"\s*(?:repeated\s+|optional\s+)?[\w.<>, ]+\s+(\w+)\s*=\s*\d+", row)):
                self.unit("field", m[1], f"{package}{scope[-1][1]}.{m[1]}", i, i)
            for c in row:
                if c == "{" and not re.match(r"\s*(service|message|enum|rpc)", row):
                    scope.append(("block", ""))
                elif c == "}" and scope:
                    scope.pop()

    def sql(self) -> None:
        for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\"`\w.]+)\s*\((.*?)\)\s*;", self.text, re.I | re.S):
            table = re.sub(r"[\"`]", "", m[1]).lower()
            self.unit("db_table", table, f"db:{table}", _line(self.text, m.start()), _line(self.text, m.end()))
            for part in re.split(r",(?![^(]*\))", m[2]):
                if (c := re.match(r"\s*[\"`]?(\w+)[\"`]?\s+\w", part)) and c[1].upper() not in ("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK", "KEY", "INDEX"):
                    at = self.text.find(part, m.start())
                    self.unit("column", c[1].lower(), f"{table}.{c[1].lower()}", _line(self.text, at + len(part) - len(part.lstrip())), _line(self.text, at + len(part)))
        for m in re.finditer(r"alter\s+table\s+([\"`\w.]+)\s+add\s+(?:column\s+)?[\"`]?(\w+)", self.text, re.I):
            table = re.sub(r"[\"`]", "", m[1]).lower()
            self.unit("column", m[2].lower(), f"{table}.{m[2].lower()}", _line(self.text, m.start()), _line(self.text, m.end()))

    def keys(self) -> list[tuple[str, str, int]]:
        """Dotted paths, values and lines of a configuration file."""
        if self.language == "json":
            out: list[tuple[str, str, int]] = []

            def walk(x, path: str) -> None:
                for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
                    p = f"{path}.{k}" if path else str(k)
                    walk(v, p) if isinstance(v, (dict, list)) else out.append((p, str(v), 1))

            walk(json.loads(self.text), "")
            return sorted(out)
        if self.language == "properties":
            return [(m[1], m[2].strip(), _line(self.text, m.start())) for m in re.finditer(r"^\s*([\w.\-\[\]]+)\s*[=:]\s*(.*)$", self.text, re.M)]
        out, stack = [], []
        for i, row in enumerate(self.text.split("\n"), 1):
            if m := re.match(r"(\s*)(?:-\s+)?[\"']?([^\s#\"':][^:\"']*)[\"']?:(?:\s+(.*))?$", row):
                while stack and stack[-1][0] >= len(m[1]):
                    stack.pop()
                stack.append((len(m[1]), m[2].strip()))
                value = (m[3] or "").split(" #")[0].strip().strip("\"'")
                if value:
                    out.append((".".join(k for _, k in stack), value, i))
                else:
                    out.append((".".join(k for _, k in stack), "", i))
        return out

    def settings(self) -> None:
        found = self.keys()
        head = {k for k, _, _ in found}
        if any(k.startswith(("openapi", "swagger")) for k in head):
            for k, _, i in found:
                if m := re.match(r"paths\.(/[^.]*(?:\.[^.]*)*?)\.(get|post|put|delete|patch)$", k):
                    self.unit("http_route", f"{m[2].upper()} {m[1]}", f"http:{m[2].upper()} {template_path(m[1])}", i, i)
        elif any(k.startswith("asyncapi") for k in head):
            for k, _, i in found:
                if m := re.match(r"channels\.(.+?)(?:\.(?:publish|subscribe))?$", k):
                    if not re.search(r"\.(publish|subscribe|message|payload|bindings|description)\b", k):
                        self.unit("topic_channel", m[1], f"topic:{m[1]}", i, i)
        for k, v, i in [x for x in found if x[1]][:MAX_CONFIG_KEYS]:
            self.unit("config_key", k, f"config:{k}", i, i, v)

    def read(self) -> list[dict]:
        if self.language in rules.DEFINITIONS:
            self.code()
        elif self.language == "proto":
            self.proto()
        elif self.language == "sql":
            self.sql()
        elif self.language in ("yaml", "json", "properties"):
            self.settings()
        return self.rows


def extract_file(repo: str, path: str, language: str, text: str) -> list[dict]:
    try:
        rows = _File(repo, path, language, text or "").read()
    except Exception as e:  # one odd file must not stop the scan; the row says which and why
        rows = [{"record": "error", "kind": type(e).__name__, "name": "", "qualified": "", "start_line": 0, "end_line": 0, "src_name": "", "confidence": 0.0, "detail": str(e)}]
    return [{"repo_id": repo, "file_path": path} | r for r in rows]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for f in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in extract_file(*f)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(FIELDS))


def extract(files: DataFrame) -> DataFrame:
    """files(repo_id, path, language, content) -> unit, edge and error rows (SCHEMA)."""
    return files.select("repo_id", "path", "language", F.coalesce("content", F.lit(""))).mapInArrow(_run, SCHEMA)
