"""A repository's files and history as tables: listings with ignore rules, logs, settings, incremental scans.

Listings come from Spark's file source, so a store of any kind will do; rules are patterns over paths.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import cut_at_word, glob_pattern, plain_text

# Folders that hold nothing of one's own, files read, the most of them, the least worth a word when skipped.
VENDORED = (".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".next", "target", "site-packages", "vendor")
EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".jsx")
MOST_FILES, WORTH_TELLING = 50_000, 50


def ignore_pattern(line: str) -> str | None:
    """A line of an ignore file as a regular expression over relative paths, null for comments and blank lines."""
    rule = line.rstrip()
    if not rule or rule.startswith("#"):
        return None
    rule, folder = rule.lstrip("!"), rule.endswith("/")
    rule = rule.rstrip("/")
    anchored = "/" in rule
    body = re.sub(r"(?:^|(?<=/))\\\*\\\*(?:/|$)", "(?:.*/)?", "/".join(re.escape(p) if p == "**" else glob_pattern(p)[4:-2].replace(".*", "[^/]*") for p in rule.lstrip("/").split("/")))
    return ("^" if anchored else "(?:^|.*/)") + body + ("/.*" if folder else "(?:/.*)?") + "$"


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the last rule that fits a path leaves it out; a rule with ! takes it back in."""
    out = F.lit(False)
    for line in lines:
        if pattern := ignore_pattern(line):
            out = F.when(path.rlike(pattern), F.lit(not line.startswith("!"))).otherwise(out)
    return out


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), length of every file below a folder, empty ones too where the store tells them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    prefix = re.escape(root.split(":", 1)[-1].rstrip("/")) + "/"
    return files.select(F.regexp_replace("path", f"^(?:[a-z0-9]+:)?/*{prefix.lstrip('/')}", "").alias("path"), "length")


def discover(files: DataFrame, ignore: list[str] | None = None, extensions: tuple[str, ...] = EXTENSIONS, most: int = MOST_FILES) -> tuple[DataFrame, DataFrame]:
    """The files to read, and what was left out by reason and first folder; too many files are an error, never a cut."""
    parts = F.split("path", "/")
    vendored = F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, VENDORED)))
    wanted = F.coalesce(F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1), F.lit("")).isin(*extensions)
    told = files.withColumn("reason", F.when(vendored, "vendored").when(ignored(F.col("path"), ignore or []), "ignored").when(~wanted, "extension"))
    kept = told.filter("reason is null").drop("reason")
    n = kept.count()
    if n > most:
        raise ValueError(f"{n} files are more than {most}: exclude some")
    skipped = told.filter("reason is not null").groupBy("reason", F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("(root)").alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    return kept, skipped


def vendored_summary(skipped: DataFrame, least: int = WORTH_TELLING) -> DataFrame:
    """dir, n of the folders of others' code that are worth a word."""
    return skipped.filter("reason = 'vendored'").groupBy("dir").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def named(files: DataFrame, *names: str) -> DataFrame:
    """Files by basename, outside folders of others' code."""
    folders = "|".join(re.escape(v) for v in VENDORED)
    return files.filter(F.substring_index("path", "/", -1).isin(*names) & ~F.col("path").rlike(rf"(?:^|/)(?:{folders})/"))


def changes(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, sha) to parse again, and paths that are gone. A source that is suddenly empty is an error."""
    if new.isEmpty() and not old.isEmpty():
        raise ValueError("the source is empty, but was not before: nothing is deleted")
    same = [F.col("n.path") == F.col("o.path"), F.col("n.sha").eqNullSafe(F.col("o.sha"))]
    return new.alias("n").join(old.alias("o"), same, "left_anti"), old.select("path").join(new.select("path"), "path", "left_anti")


def log_history(lines: DataFrame, prefix: str = "") -> DataFrame:
    """path, commits, authors, last of a log (n, line): lines 'commit|author|seconds' each before the paths they touched.

    The header before a path is its own: headers are numbered within ranges of lines, and the last one of a range is
    carried on to the next, so that no task reads the whole log. A prefix of a larger tree is cut off, and other paths go.
    """
    head = r"^([0-9a-f]{7,64})\|([^|]*)\|(\d+)$"
    t = lines.withColumn("head", F.when(F.col("line").rlike(head), F.col("line"))).withColumn("part", F.floor(F.col("n") / 100_000))
    last = t.filter("head is not null").groupBy("part").agg(F.max_by("head", "n").alias("last"))
    ranges = t.select("part").distinct().join(last, "part", "left")
    carried = ranges.withColumn("carried", F.last("last", True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).drop("last")  # a row for each range
    own = F.last("head", True).over(W.partitionBy("part").orderBy("n"))
    t = t.withColumn("own", own).join(carried, "part").withColumn("h", F.coalesce("own", "carried")).filter("head is null and line <> '' and h is not null")
    path = F.regexp_replace("line", f"^{re.escape(prefix)}", "") if prefix else F.col("line")
    t = t.filter(F.startswith("line", F.lit(prefix))) if prefix else t
    part = lambda k: F.regexp_extract("h", head, k)
    c = t.select(path.alias("path"), part(1).alias("sha"), part(2).alias("author"), part(3).cast("long").alias("at")).distinct()
    return c.groupBy("path").agg(F.countDistinct("sha").alias("commits"), F.countDistinct("author").alias("authors"), F.timestamp_seconds(F.max("at")).alias("last"))


def description(package: Column, project: Column, readme: Column) -> Column:
    """What a repository says of itself: package.json, then the project file, then the first paragraph of the readme that is prose."""
    said = F.nullif(F.trim(F.get_json_object(package, "$.description")), F.lit(""))
    project_said = F.nullif(F.regexp_extract(project, r'(?m)^description\s*=\s*"([^"]+)"', 1), F.lit(""))
    paragraphs = F.filter(F.split(readme, r"\n\s*\n"), lambda p: ~F.trim(p).rlike(r"^(#|!\[|\[!|<|```|[-*] |\||>|=+$)") & (F.length(F.trim(p)) > 0))
    return cut_at_word(plain_text(F.coalesce(said, project_said, F.try_element_at(paragraphs, F.lit(1)))))


def path_aliases(configs: DataFrame) -> DataFrame:
    """dir, alias, targets of settings files (path, content): each alias with its targets below the base folder; null without any."""
    bare = F.regexp_replace("content", r"(?m)^\s*//.*$", "")
    options = F.from_json(bare, "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")["compilerOptions"]
    c = configs.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.coalesce(options["baseUrl"], F.lit(".")).alias("base"), F.explode_outer(options["paths"]).alias("alias", "targets"))
    from graphloom.operators.code import normal_path

    return c.select("dir", "alias", F.transform("targets", lambda t: normal_path(F.concat_ws("/", "dir", "base", t))).alias("targets"))


def workspaces(packages: DataFrame) -> DataFrame:
    """dir, glob of the workspace folders that package files (path, content) name."""
    w = F.from_json("content", "workspaces array<string>")["workspaces"]
    nested = F.from_json("content", "workspaces struct<packages:array<string>>")["workspaces"]["packages"]
    return packages.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.explode(F.coalesce(w, nested)).alias("glob"))


def nearest(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """path, dir: the deepest of some folders above each path; paths under none are left out."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    e = paths.select("path", F.explode(up).alias("dir"))
    return e.join(folders.select("dir").distinct(), "dir", "left_semi").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The table, if it has the columns that a reader relies on."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def whole_graph(vertices: DataFrame, edges: DataFrame, ranks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every file with its ranks, symbols and edges nested, in order; each list is one file's own."""
    require_columns(vertices, "id", "path")
    require_columns(edges, "src", "dst", "kind")
    nested = lambda df, key, *c: df.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(*c))).alias(c[-1] + "s"))
    v = vertices.join(nested(ranks, "file_id", "scorer", "score", "rank"), "id", "left").join(nested(symbols, "file_id", "line_start", "kind", "name"), "id", "left").join(nested(edges, "src", "dst", "kind"), "id", "left")
    return v
