"""What each language's sources say about contracts, as data.

A rule is (kind, pattern, ...) with named groups: verb, path, name, handler, topic, service, method, table. Patterns
are matched over whole files, so a rule may span lines. Confidence is that of the evidence alone.
"""

from __future__ import annotations

import re

_S = r"[\"'`]"
_PATH = rf"[$@fF]?{_S}(?P<path>[^\"'`\n]+){_S}"
_TOPIC = rf"(?:{_S}(?P<topic>[^\"'`\n]+){_S}|(?P<ref>[A-Za-z_][\w.]*))"


def _c(*rules: tuple[str, str, float]) -> list[tuple[str, re.Pattern, float]]:
    return [(kind, re.compile(pattern, re.M), conf) for kind, pattern, conf in rules]


#: Definitions: (kind, pattern with the group name).
DEFINITIONS = {
    "go": _c(("method", r"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)\s*\(", 1), ("function", r"^func\s+(?P<name>\w+)\s*[\[(]", 1), ("type", r"^type\s+(?P<name>\w+)\s+(?:struct|interface)\b", 1)),
    "java": _c(("class", r"^\s*(?:public\s+|abstract\s+|final\s+)*(?:class|interface|enum|record)\s+(?P<name>\w+)", 1), ("method", r"^\s+(?:(?:public|protected|private|static|final|synchronized|default)\s+)+(?:<[^>]+>\s*)?[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*\([^;{]*\)\s*(?:throws\s+[\w., ]+)?\{", 1)),
    "kotlin": _c(("class", r"^\s*(?:\w+\s+)*(?:class|interface|object)\s+(?P<name>\w+)", 1), ("method", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(?P<name>\w+)\s*\(", 1)),
    "csharp": _c(("class", r"^\s*(?:(?:public|internal|abstract|sealed|static|partial)\s+)*(?:class|interface|record|struct)\s+(?P<name>\w+)", 1), ("method", r"^\s+(?:(?:public|protected|private|internal|static|async|override|virtual)\s+)+[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*\([^;{]*\)\s*\{", 1)),
    "typescript": _c(("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+(?P<name>\w+)", 1), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)", 1), ("function", r"^\s*(?:export\s+)?const\s+(?P<name>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::\s*[\w<>\[\] |]+)?=>", 1), ("method", r"^\s+(?:(?:public|private|protected|static|async|readonly)\s+)*(?P<name>(?!if|for|while|switch|catch|return|function)\w+)\s*\([^;{}]*\)\s*(?::\s*[\w<>\[\] |]+)?\{", 1)),
    "python": _c(("class", r"^\s*class\s+(?P<name>\w+)", 1), ("function", r"^\s*(?:async\s+)?def\s+(?P<name>\w+)\s*\(", 1)),
}
_VERBS = r"(?P<verb>[Gg][Ee][Tt]|[Pp][Oo][Ss][Tt]|[Pp][Uu][Tt]|[Dd][Ee][Ll][Ee][Tt][Ee]|[Pp][Aa][Tt][Cc][Hh]|[Hh][Ee][Aa][Dd])"
#: Contract sites: http_route, http_call, produces, consumes, rpc_call, implements_rpc, reads_from, writes_to.
SITES = {
    "go": _c(
        ("http_route", rf"\b(?!http\b|client\b)\w+\.{_VERBS}\(\s*{_PATH}\s*,\s*(?P<handler>[\w.]+)", 0.9),
        ("http_route", rf"\.Handle(?:Func)?\(\s*{_S}(?:(?P<verb>[A-Z]+)\s+)?(?P<path>/[^\"`\n]*){_S}\s*,\s*(?P<handler>[\w.]+)", 0.9),
        ("http_call", rf"\bhttp\.(?P<verb>Get|Post|Head|PostForm)\(\s*{_PATH}", 0.9),
        ("http_call", rf"NewRequest(?:WithContext)?\(\s*(?:ctx\s*,\s*)?(?:http\.Method(?P<verb2>\w+)|{_S}(?P<verb>\w+){_S})\s*,\s*(?:[\w.]+\s*\+\s*)?{_PATH}", 0.9),
        ("produces", rf"(?:Topic:\s*|\b(?:WriteMessages|SendMessages?|Produce|Publish)\(\s*(?:ctx\s*,\s*)?){_TOPIC}", 0.9),
        ("consumes", rf"\b(?:Subscribe|Consume|ConsumeTopic|NewConsumer|ReaderFor)\(\s*(?:ctx\s*,\s*)?{_TOPIC}", 0.9),
        ("rpc_client", r"(?P<var>\w+)\s*:?=\s*(?:\w+\.)?New(?P<service>\w+)Client\(", 0.9),
        ("implements_service", r"\bUnimplemented(?P<service>\w+)Server\b", 0.9),
        ("writes_to", r"\.(?:Create|Save|Updates?|Delete)\(\s*&(?:\w+\.)?(?P<entity>[A-Z]\w*)\{", 0.8),
        ("reads_from", r"\.(?:First|Find|Take|Last|Scan)\(\s*&?(?:\w+\.)?(?P<entity>[A-Z]\w*)\{", 0.8),
    ),
    "java": _c(
        ("route_base", r"@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?\"(?P<path>[^\"]*)\"[^)]*\)\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:public\s+|abstract\s+|final\s+)*class\b", 0.9),
        ("http_route", rf"@{_VERBS}Mapping(?:\(\s*(?:(?:value|path)\s*=\s*)?\"(?P<path>[^\"]*)\"[^)]*\)|(?:\(\s*\))?)[^;{{]*?\s(?P<handler>\w+)\s*\(", 0.9),
        ("http_call", rf"\.(?P<verb>get|post|put|patch|delete)For(?:Object|Entity|Location)\(\s*(?:[\w.]+\s*\+\s*)?{_PATH}", 0.9),
        ("http_call", rf"\.exchange\(\s*(?:[\w.]+\s*\+\s*)?{_PATH}\s*,\s*HttpMethod\.(?P<verb>\w+)", 0.9),
        ("produces", rf"\b\w*(?:[Kk]afka|[Rr]abbit|[Jj]ms)\w*\.(?:send|convertAndSend)\(\s*{_TOPIC}", 0.9),
        ("consumes", rf"@(?:KafkaListener|RabbitListener|JmsListener)\([^)]*?(?:topics|queues|destination)\s*=\s*\{{?\s*{_TOPIC}", 0.9),
        ("implements_service", r"extends\s+(?:\w+\.)*(?P<service>\w+)Grpc\.\w+ImplBase", 0.9),
        ("rpc_client", r"(?P<var>\w+)\s*=\s*(?:\w+\.)*(?P<service>\w+)Grpc\.new(?:Blocking|Future)?Stub\(", 0.9),
        ("entity", r"@Table\(\s*name\s*=\s*\"(?P<table>[^\"]+)\"[^)]*\)[^{;]*?class\s+(?P<entity>\w+)", 0.9),
    ),
    "csharp": _c(
        ("route_base", r"\[Route\(\s*\"(?P<path>[^\"]*)\"\s*\)\]\s*(?:\[[^\]]*\]\s*)*(?:public\s+|sealed\s+)*class\s+(?P<name>\w+)", 0.9),
        ("http_route", rf"\[Http{_VERBS}(?:\(\s*\"(?P<path>[^\"]*)\"[^)]*\))?\][^;{{]*?\s(?P<handler>\w+)\s*\(", 0.9),
        ("http_route", rf"\.Map{_VERBS}\(\s*{_PATH}(?:\s*,\s*(?P<handler>[\w.]+))?", 0.9),
        ("http_call", rf"\.(?P<verb>Get|Post|Put|Delete|Patch)(?:\w*)Async\(\s*{_PATH}", 0.9),
        ("produces", r"\.Publish(?:Async)?\(\s*new\s+(?P<topic>\w+(?:Event|Message|Command|Notification))\b", 0.8),
        ("consumes", r":\s*(?:[\w<>, ]*\b)?(?:IConsumer|IIntegrationEventHandler|INotificationHandler)<(?P<topic>\w+)>", 0.8),
        ("implements_service", r":\s*(?P<service>\w+)\.\w+Base\b", 0.9),
        ("rpc_client", r"(?P<var>\w+)\s*=\s*new\s+(?:\w+\.)*(?P<service>\w+)Client\(", 0.9),
        ("entity", r"DbSet<(?P<entity>\w+)>\s+(?P<table>\w+)", 0.8),
    ),
    "typescript": _c(
        ("route_base", rf"@Controller\(\s*{_PATH}", 0.9),
        ("http_route", rf"@{_VERBS}\(\s*(?:{_PATH})?\s*\)[^;{{]*?\b(?P<handler>\w+)\s*\(", 0.9),
        ("http_route", rf"\b(?:app|router|server|fastify)\.{_VERBS}\(\s*{_PATH}\s*,\s*(?P<handler>[\w.]+)?", 0.9),
        ("http_call", rf"\b(?:axios|http|client|api|ky|got|superagent)\.{_VERBS}(?:<[^>(]*>)?\(\s*{_PATH}", 0.9),
        ("http_call", rf"\bfetch\(\s*{_PATH}(?:\s*,\s*\{{[^}}]*?method:\s*{_S}(?P<verb>\w+){_S})?", 0.9),
        ("produces", rf"\.(?:send|publish|emit)\(\s*(?:\{{\s*topic:\s*)?{_S}(?P<topic>[\w.:-]+){_S}", 0.8),
        ("consumes", rf"\.subscribe\(\s*(?:\{{\s*topic:\s*)?{_S}(?P<topic>[\w.:-]+){_S}|@(?:EventPattern|MessagePattern)\(\s*{_S}(?P<topic2>[^\"'`]+){_S}", 0.9),
        ("entity", rf"@Entity\(\s*{_S}(?P<table>\w+){_S}\s*\)\s*(?:export\s+)?class\s+(?P<entity>\w+)", 0.9),
    ),
    "python": _c(
        ("http_route", rf"@\w+\.{_VERBS}\(\s*{_PATH}[^)]*\)\s*(?:@[^\n]*\n\s*)*(?:async\s+)?def\s+(?P<handler>\w+)", 0.9),
        ("http_route", rf"@\w+\.route\(\s*{_PATH}(?:[^)]*methods\s*=\s*\[\s*{_S}(?P<verb>\w+){_S})?[^)]*\)\s*(?:async\s+)?def\s+(?P<handler>\w+)", 0.9),
        ("http_call", rf"\b(?:requests|httpx|\w*client|\w*session)\.{_VERBS}\(\s*{_PATH}", 0.9),
        ("produces", rf"\bproducer\.(?:send|produce|send_and_wait)\(\s*{_TOPIC}", 0.9),
        ("consumes", rf"\b(?:KafkaConsumer|AIOKafkaConsumer)\(\s*{_TOPIC}|\bconsumer\.subscribe\(\s*\[?\s*{_TOPIC.replace('topic', 'topic2').replace('ref', 'ref2')}", 0.9),
        ("implements_service", r"class\s+\w+\(\s*(?:\w+\.)*(?P<service>\w+)Servicer\s*\)", 0.9),
        ("rpc_client", r"(?P<var>\w+)\s*=\s*(?:\w+\.)*(?P<service>\w+)Stub\(", 0.9),
        ("entity", rf"class\s+(?P<entity>\w+)\([^)]*\):\s*(?:[^\n]*\n)*?\s+__tablename__\s*=\s*{_S}(?P<table>\w+){_S}", 0.9),
    ),
}
SITES["kotlin"], SITES["javascript"] = SITES["java"], SITES["typescript"]
DEFINITIONS["javascript"] = DEFINITIONS["typescript"]
#: String constants, through which topics and paths are named.
CONSTANT = re.compile(rf"(?:const|val|let|var|final\s+String|string)?\s*\b(?P<name>[A-Za-z_]\w*)\s*(?::\s*\w+\s*)?=\s*{_S}(?P<value>[^\"'`\n]+){_S}", re.M)
#: A name read from the environment or a configuration.
CONFIG_REF = re.compile(rf"(?P<name>[A-Za-z_]\w*)\s*:?=\s*(?:os\.(?:getenv|Getenv|environ\.get)\(|os\.environ\[|process\.env\.|System\.getenv\()\s*{_S}?(?P<key>\w+)", re.M)
SQL_TEXT = re.compile(r"\b(?:(?P<write>insert\s+into|update|delete\s+from)|(?P<read>from|join))\s+(?P<table>[\"`\w.]+)(?P<cols>\s*\([\w\s,\"`]+\))?", re.I)
SQL_START = re.compile(r"\b(?:insert\s+into|update\s+\w+\s+set|delete\s+from|select\b[^;]*?\bfrom)\b", re.I | re.S)
CALL = re.compile(r"(?:(?P<recv>[A-Za-z_]\w*)\s*\.\s*)?(?P<name>[A-Za-z_]\w*)\s*\(")
KEYWORDS = frozenset("if for while switch catch return func function def class new await async else elif and or not in with lambda select case go defer range make len append print super this self throw sizeof typeof using lock foreach when try do".split())
