"""Predicates over units, edges, paths and hits (F1-F16)."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of lower-case paths that mark tests and generated code.
TEST_MARKERS = ("/test/", "/tests/", "/testing/", "/testdata/", "/__tests__/", "/mocks/", "/mock/", "/fixtures/", "/vendor/", "/node_modules/", "_test.", ".test.", ".spec.")
GENERATED_MARKERS = ("/genproto/", "/generated/", ".pb.go", ".pb.cc", ".pb.h", "_pb2.", "_pb2_", "_pb.js", "_pb.d.ts", ".proto")
SYNTHETIC_TRAFFIC = ("locustfile", "loadgen", "load-gen", "load_gen", "loadtest", "load-test", "load_test", "/benchmarks/", "/gatling/", "/jmeter/")


def _contains_any(path: Column, marks: tuple[str, ...]) -> Column:
    anchored = F.concat(F.lit("/"), F.lower(path))
    return reduce(or_, [anchored.contains(m) for m in marks])


def is_test_path(path: Column) -> Column:
    return _contains_any(path, TEST_MARKERS)


def is_generated_path(path: Column) -> Column:
    return _contains_any(path, GENERATED_MARKERS)


def is_penalty_path(path: Column) -> Column:
    return is_test_path(path) | is_generated_path(path)


def is_synthetic_traffic(path: Column) -> Column:
    """Of the path as it is: a folder at its very start has no slash before it and is no sign."""
    return reduce(or_, [F.lower(path).contains(m) for m in SYNTHETIC_TRAFFIC])


def matches(eq: dict | None = None, within: dict | None = None, without: dict | None = None, fold: tuple | None = None, contains_fold: tuple | None = None, suffix: tuple | None = None, line: tuple | None = None) -> Column:
    """All given conditions. Empty lists and empty values are no conditions. fold, contains_fold and suffix: (columns, value), true if any of the columns fits; line: (start column, end column, line)."""
    of: list[Column] = [F.col(c) == v for c, v in (eq or {}).items() if v not in (None, "")]
    of += [F.col(c).isin(list(v)) for c, v in (within or {}).items() if v]
    of += [~F.col(c).isin(list(v)) for c, v in (without or {}).items() if v]
    if fold and fold[1]:
        of.append(reduce(or_, [F.lower(c) == fold[1].lower() for c in fold[0]]))
    if contains_fold and contains_fold[1]:
        of.append(reduce(or_, [F.contains(F.lower(c), F.lit(contains_fold[1].lower())) for c in contains_fold[0]]))
    if suffix and suffix[1]:
        of.append(reduce(or_, [F.col(c).endswith(suffix[1]) for c in suffix[0]]))
    if line and line[2]:
        of.append((F.col(line[0]) <= line[2]) & (F.col(line[1]) >= line[2]))
    return reduce(and_, of, F.lit(True))


def in_working_set(rows: DataFrame, repos: DataFrame, key: str = "repo_id", chosen: list[str] | None = None) -> DataFrame:
    """Rows of the chosen repositories, or else of the active ones; repos(id, active)."""
    if chosen:
        return rows.where(F.col(key).isin(chosen))
    active = repos.where("active").select(F.col("id").alias("__id"))
    return rows.join(active, rows[key] == active["__id"], "left_semi")
