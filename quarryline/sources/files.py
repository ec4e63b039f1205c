"""Scans of source trees (S2-S5, S30) and service detection (C20)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Languages by file name extension.
LANGUAGES = {"go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "proto": "proto", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "properties": "properties", "env": "properties", "toml": "toml", "md": "markdown", "rst": "rst", "txt": "text"}
#: File names that make their folder a service, by priority.
MANIFESTS = {"docker-compose.yml": 1, "docker-compose.yaml": 1, "main.go": 2, "go.mod": 3, "pom.xml": 3, "build.gradle": 3, "build.gradle.kts": 3, "package.json": 3, "pyproject.toml": 3, "requirements.txt": 3, "Dockerfile": 3}


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(path.endswith(".csproj"), F.lit("csproj")).otherwise(table[ext])


def ignored(path: Column, globs: list[str]) -> Column:
    """**/x matches x as any part of the path, x/** what lies below x, * within a part; the last rule that matches wins, ! takes back."""
    out = F.lit(False)
    for g in globs:
        back, g = g.startswith("!"), g.lstrip("!")
        body = g.removeprefix("**/").removesuffix("/**").strip("/")
        pattern = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "/_" else f"\\{c}" for c in body.replace("**", "*"))
        anywhere = g.startswith("**/") or "/" not in g.strip("/")
        out = F.when(path.rlike(("(^|/)" if anywhere else "^") + pattern + "(/|$)"), F.lit(not back)).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, repo: str, globs: list[str] = ()) -> DataFrame:
    """Files of known languages below root: (repo_id, path, language, content, hash, size).

    Paths are listed and chosen first, a scan that opens no file; then the chosen files are read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/"), f"^{base}/", "")
    listed = raw.select(F.col("path").alias("file"), rel.alias("path")).withColumn("language", language(F.col("path")))
    chosen = listed.where(F.col("language").isNotNull() & ~ignored(F.col("path"), list(globs)))
    paths = [r.file for r in chosen.select("file").collect()]  # of one repository
    if not paths:
        return spark.createDataFrame([], "repo_id string, path string, language string, content string, hash string, size long")
    df = spark.read.format("binaryFile").load(paths).withColumn("rel", rel)
    return df.select(F.lit(repo).alias("repo_id"), F.col("rel").alias("path"), language(F.col("rel")).alias("language"), F.decode("content", "utf-8").alias("content"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"))


def services(files: DataFrame) -> DataFrame:
    """files(repo_id, path) -> (repo_id, root, name, detected_by): folders with a manifest, of several in one the first by priority."""
    table = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    base = F.substring_index("path", "/", -1)
    root = F.regexp_replace(F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(""), "/?cmd/[^/]+$", "")
    m = files.select("repo_id", root.alias("root"), base.alias("detected_by"), table[base].alias("p")).where("p is not null and size(split(root, '/')) <= 6")
    first = F.row_number().over(W.partitionBy("repo_id", "root").orderBy("p", "detected_by"))
    return m.withColumn("n", first).where("n = 1").select("repo_id", "root", F.when(F.col("root") == "", F.col("repo_id")).otherwise(F.substring_index("root", "/", -1)).alias("name"), "detected_by")
