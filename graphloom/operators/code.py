"""Source files to a graph: symbols and imports, imports to files, kinds of edges, roots, and metrics of functions.

Files are tables (path, content). Parsing one file is a small helper inside an Arrow batch; what the facts of many
files say together, resolution above all, is joins. A null or unparsable content has no facts; metrics of a language
without rules are null, never zero.
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections import Counter
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.rules import is_test_file
from graphloom.operators.scripts import script_facts, script_metrics
from graphloom.plans.projections import FILES_SQL, KIND_WEIGHTS, STEPS_SQL, files, kind_weight, line_kind
from graphloom.plans.rounds import written
from graphloom.registry import query
from graphloom.session import table

# Extensions in the order in which they are tried, default roots, and the least share and number of
# imports that promote a root.
JS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
DEFAULT_ROOTS = ("", "src")
LEAST_SHARE, LEAST_IMPORTS = 0.05, 3
HEAVY_USE = 5

FACTS = (
    "path string, symbols array<struct<name:string,kind:string,parent:string,signature:string,docstring:string,line_start:int,line_end:int>>, "
    "imports array<struct<specifier:string,names:array<string>,locals:array<string>,line:int,reexport:boolean>>"
)
SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("parent", pa.string()), ("signature", pa.string()), ("docstring", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())])
IMPORT = pa.struct([("specifier", pa.string()), ("names", pa.list_(pa.string())), ("locals", pa.list_(pa.string())), ("line", pa.int32()), ("reexport", pa.bool_())])


def python_facts(source: str) -> tuple[list[dict], list[dict]]:
    """Symbols (functions, classes and their members) and imports, wherever these stand, of one file."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    symbols: list[dict] = []

    def visit(body: list, parent: str | None) -> None:
        for n in body:
            if not isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            is_class = isinstance(n, ast.ClassDef)
            text = f"class {n.name}" if is_class else f"def {n.name}({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
            kind = "class" if is_class else "method" if parent else "function"
            symbols.append({"name": n.name, "kind": kind, "parent": parent, "signature": text, "docstring": ast.get_docstring(n), "line_start": n.lineno, "line_end": n.end_lineno})
            if is_class:
                visit(n.body, n.name)

    visit(tree.body, None)
    imports = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports += [{"specifier": a.name, "names": [], "locals": [a.asname or a.name.partition(".")[0]], "line": n.lineno, "reexport": False} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            names = [a.name for a in n.names]
            imports.append({"specifier": "." * n.level + (n.module or ""), "names": names, "locals": [None if a.name == "*" else a.asname or a.name for a in n.names], "line": n.lineno, "reexport": False})
    return symbols, sorted(imports, key=lambda i: i["line"])


def facts_of(path: str | None, text: str | None) -> tuple[list[dict], list[dict]]:
    """Symbols and imports of a file in a known language, else none."""
    read = python_facts if path and path.endswith(".py") else script_facts if path and path.endswith(JS_EXTENSIONS) else None
    return read(text) if read and text else ([], [])


def extract(sources: DataFrame) -> DataFrame:
    """path, symbols, imports of files (path, content); the language goes by the extension, others have no facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, imports = [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                s, i = facts_of(path, text)
                symbols.append(s)
                imports.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(symbols, pa.list_(SYMBOL)), pa.array(imports, pa.list_(IMPORT))], ["path", "symbols", "imports"])

    return sources.select("path", "content").mapInArrow(run, FACTS)


def normal_path(path: Column) -> Column:
    """Without empty and . segments, .. and what it leaves gone; what leads out of the tree keeps its .. in front."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    step = lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def under(root: Column, path: Column) -> Column:
    return F.when(root == "", path).otherwise(F.concat_ws("/", root, path))


def python_bases(specifier: Column, name: Column, from_path: Column, roots: Column) -> Column:
    """Modules' paths without ending in the order in which they are tried: the name as a submodule under each base, then each base itself.

    A relative specifier has one base, so many folders up as it has dots less one; an absolute one has a base under
    each root.
    """
    dots = F.length(F.regexp_extract(specifier, r"^(\.+)", 1))
    module = F.replace(F.regexp_replace(specifier, r"^\.+", ""), F.lit("."), F.lit("/"))
    relative = F.array(normal_path(F.concat_ws("/", folder(from_path), F.array_join(F.array_repeat(F.lit(".."), dots - 1), "/"), module)))
    bases = F.when(dots > 0, relative).otherwise(F.transform(roots, lambda r: under(r, module)))
    return F.when(name.isNull() | (name == "*"), bases).otherwise(F.concat(F.transform(bases, lambda b: F.concat_ws("/", b, name)), bases))


def python_candidates(specifier: Column, name: Column, from_path: Column, roots: Column) -> Column:
    """Paths in the order in which they are tried: a file and then a package of each base."""
    return F.flatten(F.transform(python_bases(specifier, name, from_path, roots), lambda b: F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py")))))


def bases_of(paths: DataFrame) -> DataFrame:
    """python, base, nth, target: what each path answers, and as the how-manieth of the files that are tried for it.

    A Python base is tried as a file, then as a package; a script's as it stands, then with each extension, then as
    an index file of each.
    """
    path = F.col("path")
    ends = lambda python, endings: [(python, e, k) for k, e in enumerate(endings)]
    forms = [*ends(True, (".py", "/__init__.py")), *ends(False, ("", *JS_EXTENSIONS, *(f"/index{e}" for e in JS_EXTENSIONS)))]
    each = F.array(*(F.when(F.endswith(path, F.lit(e)), F.struct(F.lit(python).alias("python"), F.left(path, F.length(path) - len(e)).alias("base"), F.lit(k).alias("nth"))) for python, e, k in forms))
    return paths.select(path.alias("target"), F.inline(F.filter(each, lambda x: x.isNotNull())))


def nearest_config(folders: DataFrame, dirs: DataFrame) -> DataFrame:
    """folder, dir: the deepest of the folders (dir) that a folder is or lies in; those above it meet dirs by equality."""
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = folders.select("folder", F.explode(F.array_distinct(up)).alias("dir")).join(dirs.select("dir").distinct(), "dir")
    return above.groupBy("folder").agg(F.max_by("dir", F.length("dir")).alias("dir"))


def aliased(asked: DataFrame, bases: DataFrame, aliases: DataFrame) -> DataFrame:
    """base, specifier, target of specifiers that an alias of a settings file (base: its folder) leads to a file; aliases: dir, alias, targets.

    Beginnings of a specifier, of the lengths that the file's aliases have, meet these by equality; the longest that
    leads anywhere wins, then the first target, then the first extension.
    """
    named = aliases.filter("alias IS NOT NULL").select(F.col("dir").alias("base"), "alias", F.rtrim(F.col("alias"), F.lit("*")).alias("prefix"), "targets")
    lengths = named.groupBy("base").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    begun = asked.select("base", "specifier").join(lengths, "base")
    begun = begun.select("base", "specifier", F.explode(F.filter("lengths", lambda n: n <= F.length("specifier"))).alias("n")).withColumn("prefix", F.left("specifier", F.col("n")))
    hit = begun.join(named.select("base", "prefix", "alias", F.posexplode("targets").alias("nth", "to")), ["base", "prefix"])
    rest = F.substr("specifier", F.col("n") + 1)
    c = hit.select(F.col("base").alias("dir"), "specifier", "n", "alias", F.col("nth").alias("at"), normal_path(F.concat(F.rtrim(F.col("to"), F.lit("*")), rest)).alias("base"))
    found = c.join(bases.filter("not python"), "base")
    return found.groupBy(F.col("dir").alias("base"), "specifier").agg(F.min_by("target", F.struct((-F.col("n")).alias("n"), "alias", "at", "nth")).alias("target"))


def imports_of(facts: DataFrame) -> DataFrame:
    """A row for each import and name: id, path, specifier, name, local, line, reexport; a bare import has no name."""
    i = facts.select("path", F.posexplode("imports").alias("k", "i"))
    pairs = F.when(F.size("i.names") > 0, F.arrays_zip(F.col("i.names").alias("names"), F.col("i.locals").alias("locals"))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("names"), F.get("i.locals", F.lit(0)).alias("locals"))))
    i = i.select("path", "k", "i.specifier", "i.line", "i.reexport", F.posexplode(pairs).alias("m", "p"))
    return i.select(F.xxhash64("path", "k", "m").alias("id"), "path", "specifier", F.col("p.names").alias("name"), F.col("p.locals").alias("local"), "line", "reexport")


def resolve(imports: DataFrame, paths: DataFrame, roots: tuple[str, ...] = DEFAULT_ROOTS, aliases: DataFrame | None = None) -> DataFrame:
    """The imports with target, null where no file answers; aliases: dir, alias, targets, by settings file.

    An import's answer hangs on its specifier and name (of Python), and on the folder that it is relative to or whose
    settings hold for it: each such question is asked once. Of settings files only the nearest counts, none above it.
    """
    python, relative = F.endswith("path", F.lit(".py")), F.startswith("specifier", F.lit("."))
    i = imports.withColumn("python", python).withColumn("base", F.when(relative, folder(F.col("path"))))
    if aliases is not None:  # relative imports have no alias, and no other script's has files of its own
        by_alias = ~relative & F.lower("path").rlike(r"\.(ts|tsx|js|jsx)$")
        own = i.withColumn("folder", F.when(by_alias, folder(F.col("path"))))
        i = own.join(nearest_config(own.filter("folder is not null").select("folder").distinct(), aliases), "folder", "left").withColumn("base", F.coalesce("base", "dir")).drop("folder", "dir")
    i = i.withColumn("asked", F.when(F.col("python"), F.col("name")))
    key = ["python", "base", "specifier", "asked"]
    q, bases = i.filter("python or base is not null").select(*key).distinct(), bases_of(paths)
    from_path = F.concat("base", F.lit("/"))
    tried = F.when(F.col("python"), python_bases(F.col("specifier"), F.col("asked"), from_path, F.array(*map(F.lit, roots)))).when(relative, F.array(normal_path(F.concat_ws("/", "base", "specifier"))))
    c = q.select("python", F.col("base").alias("dir"), "specifier", "asked", F.posexplode(tried).alias("pos", "base"))
    found = c.join(bases, ["python", "base"]).groupBy("python", F.col("dir").alias("base"), "specifier", "asked").agg(F.min_by("target", F.struct("pos", "nth")).alias("target"))
    if aliases is not None:
        more = aliased(q.filter(~F.col("python") & ~relative), bases, aliases)
        found = found.unionByName(more.select(F.lit(False).alias("python"), "base", "specifier", F.lit(None).cast("string").alias("asked"), "target"))
    met = [F.col(f"i.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    return i.alias("i").join(found.alias("f"), met, "left").select(*(f"i.{c}" for c in imports.columns), "f.target")


def candidate_roots(paths: DataFrame) -> DataFrame:
    """root: every folder that holds a Python file's package or script, the top included."""
    folders = paths.filter(F.endswith("path", F.lit(".py"))).select(F.split(folder(F.col("path")), "/").alias("parts")).distinct()
    up = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/"))
    return folders.select(F.explode(up).alias("root")).distinct()


def score_roots(unresolved: DataFrame, paths: DataFrame) -> DataFrame:
    """root, score, share: the unresolved absolute Python imports that each root would answer.

    A root answers a specifier if the path that it stands for ends a file's path at a folder: so every file is taken
    apart into root and rest, and rests meet specifiers by equality; no root is tried against a row it can't answer.
    A file that several roots lead to counts for the deepest alone.
    """
    rows = unresolved.filter(F.endswith("path", F.lit(".py")) & ~F.startswith("specifier", F.lit("."))).groupBy("specifier", "name").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("path", "/")
    cuts = paths.filter(F.endswith("path", F.lit(".py"))).select("path", parts.alias("parts")).select("path", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("k"))
    rest = cuts.select(F.col("path").alias("target"), F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("root"), F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), "/").alias("candidate"), F.col("k").alias("depth"))
    tried = rows.select("specifier", "name", "n", F.posexplode(python_candidates(F.col("specifier"), F.col("name"), F.lit(""), F.array(F.lit("")))).alias("pos", "candidate"))
    hits = tried.join(rest, "candidate").groupBy("specifier", "name", "n", "root").agg(F.min_by(F.struct("target", "depth"), "pos").alias("hit"))
    deepest = hits.groupBy("hit.target").agg(F.max("hit.depth").alias("depth"))
    kept = hits.select("n", "root", "hit.target", "hit.depth").join(deepest, ["target", "depth"])
    n = F.broadcast(rows.agg(F.sum("n").alias("all")))  # one row
    return kept.groupBy("root").agg(F.sum("n").alias("score")).crossJoin(n).select("root", "score", (F.col("score") / F.col("all")).alias("share"))


def promoted_roots(scores: DataFrame, least_share: float = LEAST_SHARE, least: int = LEAST_IMPORTS) -> DataFrame:
    return scores.filter((F.col("share") >= least_share) & (F.col("score") >= least)).select("root")


def resolve_in_two_stages(imports: DataFrame, paths: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Default roots first; what stays open is tried under promoted roots: those above the file deepest first, then the others.

    Files meet roots by the path's rest, as in score_roots; of the files that answer a row, the first candidate under
    the nearest root wins.
    """
    first = written(resolve(imports, paths, aliases=aliases), "resolved")
    left = first.filter("target is null")
    roots = promoted_roots(score_roots(left, paths))
    rows = left.filter(F.endswith("path", F.lit(".py")) & ~F.startswith("specifier", F.lit("."))).select("id", "path", "specifier", "name")
    parts = F.split("path", "/")
    cuts = paths.select(F.col("path").alias("target"), parts.alias("parts")).select("target", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("k"))
    rest = cuts.select("target", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("root"), F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), "/").alias("candidate"), F.col("k").alias("depth")).join(roots, "root", "left_semi")
    asked = rows.select("specifier", "name").distinct()
    tried = asked.select("specifier", "name", F.posexplode(python_candidates(F.col("specifier"), F.col("name"), F.lit(""), F.array(F.lit("")))).alias("pos", "candidate"))
    known = tried.join(rest, "candidate").alias("k")
    hits = rows.alias("r").join(known, (F.col("r.specifier") == F.col("k.specifier")) & F.col("r.name").eqNullSafe(F.col("k.name"))).select("id", "path", "root", "depth", "pos", "target")
    above = (F.col("root") == "") | F.startswith("path", F.concat("root", F.lit("/")))
    best = hits.groupBy("id").agg(F.min_by("target", F.struct((~above).alias("far"), (-F.col("depth")).alias("depth"), "root", "pos")).alias("second"))
    return first.join(best, "id", "left").select(*[c for c in first.columns if c != "target"], F.coalesce("target", "second").alias("target"))


WORD, CALLED, BASES = re.compile(r"\w+"), re.compile(r"(?<!\w)(\w++)[ \t\n\x0b\f\r]*\("), re.compile(r"class[ \t\n\x0b\f\r]+[A-Za-z0-9_]+[ \t\n\x0b\f\r]*\(([^)]*)")
KINDS = "path string, kinds array<array<string>>"


def use_kinds(text: str, imports: list[dict]) -> list[list[str]]:
    """The kind of every name of every import by the strongest use of it in the file, whose words are looked through once.

    Uses are counted after the last import. A name in a class's bases, one before a parenthesis, and the number of
    uses are told by patterns over the text.
    """
    body = "\n".join(text.split("\n")[max((i["line"] for i in imports), default=0) :])
    uses, called = Counter(WORD.findall(body)), set(CALLED.findall(text))
    bases = {w for b in BASES.findall(text) for w in WORD.findall(b)}

    def kind(name: str | None, local: str | None, reexport: bool) -> str:
        if reexport:
            return "reexport"
        if not local or name == "*":
            return "unresolvable_binding"
        if WORD.fullmatch(local):
            derived, calls, n = local in bases, local in called, uses[local]
        else:  # a name with other signs, such as $, isn't one word of the text
            word = rf"\b{re.escape(local)}\b"
            derived, calls, n = any(re.search(word, b) for b in BASES.findall(text)), re.search(word + r"[ \t\n\x0b\f\r]*\(", text), len(re.findall(word, body))
        return "inherits" if derived else "calls" if calls else "heavy_use" if n >= HEAVY_USE else "light_use" if n else "type_only"

    pairs = lambda i: zip_longest(i["names"], i["locals"]) if i["names"] else [(None, i["locals"][0] if i["locals"] else None)]
    return [[kind(n, l, i["reexport"]) for n, l in pairs(i)] for i in imports]


def kinds_of(sources: DataFrame) -> DataFrame:
    """path, kinds (by import, then by name) of files (path, content), read in one pass; a test's imports are all of one kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in batch.schema.names]
            known = columns[2] if len(columns) > 2 else [facts_of(p, t)[1] for p, t in zip(*columns, strict=True)]
            kinds = [use_kinds(t or "", i) if i else [] for t, i in zip(columns[1], known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(kinds, pa.list_(pa.list_(pa.string())))], ["path", "kinds"])

    k = sources.select("path", "content", *(c for c in ("imports",) if c in sources.columns)).mapInArrow(run, KINDS)
    tests = F.transform("kinds", lambda i: F.transform(i, lambda _: F.lit("test_edge")))
    return k.select("path", F.when(is_test_file(F.col("path")), tests).otherwise(F.col("kinds")).alias("kinds"))


def classified(sources: DataFrame, facts: DataFrame) -> DataFrame:
    """id, kind of every import of imports_of, told inside each file's own row: a text is never copied to its imports."""
    f = kinds_of(sources.select("path", "content").join(facts.select("path", "imports"), "path"))
    k = f.select("path", F.posexplode("kinds").alias("k", "kinds")).select("path", "k", F.posexplode("kinds").alias("m", "kind"))
    return k.select(F.xxhash64("path", "k", "m").alias("id"), "kind")


# Generated sources: a file's imports are the files that follow it in an order, used as the edge's kind says.
USE_KINDS = ("inherits", "calls", "heavy_use", "light_use", "type_only")
_STRENGTH = "CASE kind WHEN 'inherits' THEN 0 WHEN 'calls' THEN 1 WHEN 'heavy_use' THEN 2 WHEN 'light_use' THEN 3 ELSE 4 END"
CODE_EDGES_SQL = f"""{STEPS_SQL}, {FILES_SQL}, ce AS (SELECT src, dst, min({_STRENGTH}) AS k FROM steps WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2)"""
CODE = r"\.(py|ts|tsx|js|jsx)$"


def code_edges(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst and the place of the strongest kind of use among the steps between them.

    The place is told from a line alone, so that orders are put together from numbers, without flags.
    """
    kind, strength = line_kind(), F.lit(4)
    for k in (3, 2, 1, 0):
        strength = F.when(kind == USE_KINDS[k], k).otherwise(strength)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), "l_suppkey", strength.alias("k"))
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "src", "l_suppkey")
    s = lines.select("src", F.lead("src").over(order).alias("dst"), "k")
    return s.filter("dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("k").alias("k"))


def generated_sources(spark: SparkSession, sf: str) -> DataFrame:
    """path, content of the files in Python and JavaScript or TypeScript.

    Edges carry nothing but keys and the name of the file that they lead to; lines are put together file by file.
    """
    f = files(spark, sf).select("id", "path")
    e = code_edges(spark, sf).join(f.select(F.col("id").alias("dst"), F.regexp_replace("path", CODE, "").alias("bare")), "dst")
    rows = e.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "k", "bare"))).alias("rows")).withColumnRenamed("src", "id")
    python = F.endswith("path", F.lit(".py"))
    name = lambda r: F.concat(F.lit("Part"), r["dst"].cast("string"))

    def line(r: Column) -> Column:
        module = F.replace(F.regexp_replace(r["bare"], "/__init__$", ""), F.lit("/"), F.lit("."))
        # A path with a dot in a name, such as a config file's, is no module: Python can't import it.
        return F.when(python, F.concat(F.lit("from "), F.regexp_replace(module, r"\.config\.", ".config_"), F.lit(" import "), name(r))).otherwise(F.concat(F.lit("import { "), name(r), F.lit(" } from '@/"), r["bare"], F.lit("';")))

    def use(r: Column) -> Column:
        own = F.concat(F.lit("class Own"), r["dst"].cast("string"), F.when(python, F.lit("(")).otherwise(F.lit(" (")), name(r), F.lit(")"), F.when(python, F.lit(": pass")).otherwise(F.lit(" {}")))
        u = F.when(r["k"] == 0, own).when(r["k"] == 1, F.concat(F.lit("x = "), name(r), F.lit("()"))).when(r["k"] == 2, F.array_join(F.array_repeat(F.concat(F.lit("y = "), name(r)), 5), "\n"))
        return u.when(r["k"] == 3, F.concat(F.lit("z = "), name(r))).otherwise(F.lit(""))

    body = F.concat_ws("\n", F.transform("rows", line), F.transform("rows", use))
    tail = F.when(python, F.lit("\n\ndef run(a, b=1):\n    \"\"\"Runs.\"\"\"\n    return a\n\n\nclass Kept:\n    def go(self):\n        return 1\n")).otherwise(F.lit("\n\nexport function run(a, b) {\n  return a;\n}\n\nclass Kept {\n  go() {\n    return 1;\n  }\n}\n"))
    return f.filter(F.col("path").rlike(CODE)).join(rows, "id", "left").select("path", F.concat(F.when(F.col("rows").isNotNull(), body).otherwise(F.lit("")), tail).alias("content"))


def top_config(spark: SparkSession) -> DataFrame:
    """The settings file of a repository whose alias stands for its top."""
    from graphloom.sources.repository import path_aliases

    return path_aliases(spark.createDataFrame([("tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["*"]}}}')], "path string, content string"))


@query("src_symbols", f"""WITH {FILES_SQL} SELECT path, s.name, s.kind, s.parent FROM files, (VALUES ('run', 'function', NULL), ('Kept', 'class', NULL), ('go', 'method', 'Kept')) s(name, kind, parent) WHERE regexp_matches(path, '{CODE}')
UNION ALL (WITH {CODE_EDGES_SQL} SELECT path, 'Own' || dst, 'class', NULL FROM ce JOIN files ON id = src WHERE k = 0 AND regexp_matches(path, '{CODE}'))""")
def symbols_query(spark: SparkSession, sf: str) -> DataFrame:
    """Every symbol of every generated file."""
    return extract(generated_sources(spark, sf)).select("path", F.inline("symbols")).select("path", "name", "kind", "parent")


RESOLVED_SQL = f"""{CODE_EDGES_SQL}, t AS (SELECT id, path, regexp_matches(path, '\\.py$') AS py, regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AS js FROM files),
im AS (SELECT a.path, b.id AS dst, k, CASE WHEN a.py AND b.py AND NOT contains(b.path, '.config.') THEN b.path WHEN a.js AND NOT b.py THEN b.path END AS target FROM ce JOIN t a ON a.id = src JOIN t b ON b.id = dst WHERE a.py OR a.js)"""


@query("src_imports", f"WITH {RESOLVED_SQL} SELECT path, 'Part' || dst AS name, target FROM im")
def imports_query(spark: SparkSession, sf: str) -> DataFrame:
    """Every import and the file that answers it, in two stages of roots."""
    s = generated_sources(spark, sf)
    i = written(imports_of(extract(s)).select("id", "path", "specifier", "name"), "imports")
    return resolve_in_two_stages(i, files(spark, sf).select("path"), top_config(spark)).select("path", "name", "target")


@query("src_alias_nearest", f"""WITH {CODE_EDGES_SQL}, j AS (SELECT id, path, split_part(path, '/', 1) AS top, regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AS js FROM files)
SELECT a.path, b.id AS dst, CASE WHEN a.top = b.top AND NOT ends_with(b.path, '.py') THEN b.path END AS target FROM ce JOIN j a ON a.id = src JOIN j b ON b.id = dst WHERE a.js""")
def alias_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Imports by one alias that every top folder's settings file gives another meaning, and the repository's own a third."""
    from graphloom.sources.repository import path_aliases

    f = files(spark, sf).select("id", "path").withColumn("top", F.substring_index("path", "/", 1))
    own = F.lit('{"compilerOptions": {"paths": {"@/*": ["./nowhere/*", "./*"]}}}')
    above = spark.createDataFrame([("tsconfig.json", '{"compilerOptions": {"baseUrl": "lib", "paths": {"@/*": ["*"], "@": ["x"]}}}')], "path string, content string")
    configs = f.select(F.concat("top", F.lit("/tsconfig.json")).alias("path"), own.alias("content")).distinct().unionByName(above)
    rest = F.regexp_replace(F.regexp_replace("path", CODE, ""), "^[^/]*/", "")
    e = code_edges(spark, sf).join(f.select(F.col("id").alias("src"), "path"), "src").filter(F.col("path").rlike(r"\.(ts|tsx|js|jsx)$")).join(f.select(F.col("id").alias("dst"), F.concat(F.lit("@/"), rest).alias("specifier")), "dst")
    i = written(e.select("path", "dst", "specifier", F.lit(None).cast("string").alias("name")), "imports")
    return resolve(i, f.select("path"), aliases=path_aliases(configs)).select("path", "dst", "target")


@query("gr_edge_kinds", f"""WITH {RESOLVED_SQL} SELECT kind, count(*) AS n, CAST(max(CASE kind WHEN 'inherits' THEN 1 WHEN 'calls' THEN .8 WHEN 'heavy_use' THEN .8 WHEN 'light_use' THEN .4 WHEN 'type_only' THEN .25 ELSE .05 END) AS DOUBLE) AS weight FROM
(SELECT CASE WHEN regexp_matches(path, '(^|/)test_[^/]*$') THEN 'test_edge' ELSE ['inherits', 'calls', 'heavy_use', 'light_use', 'type_only'][k + 1] END AS kind FROM im) GROUP BY 1""")
def edge_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Imports by kind of use, and what each kind weighs."""
    k = kinds_of(generated_sources(spark, sf)).select(F.explode(F.flatten("kinds")).alias("kind"))
    return k.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", "n", kind_weight(F.col("kind")).alias("weight"))


@query("join_two_stage", f"""WITH {FILES_SQL}, py AS (SELECT path, replace(regexp_replace(regexp_extract(path, '^[^/]+/(.*)$', 1), '(/__init__)?\\.py$', ''), '/', '.') AS spec FROM files WHERE ends_with(path, '.py') AND NOT contains(path, '.config.')),
im AS (SELECT DISTINCT spec FROM py), hits AS (SELECT im.spec, py.path, split_part(py.path, '/', 1) AS root FROM im JOIN py USING (spec)), good AS (SELECT root FROM hits GROUP BY 1 HAVING count(DISTINCT spec) >= 3 AND count(DISTINCT spec) >= .05 * (SELECT count(*) FROM im))
SELECT spec, min(path) AS target FROM hits WHERE root IN (SELECT root FROM good) GROUP BY 1 UNION ALL SELECT spec, NULL FROM im WHERE spec NOT IN (SELECT spec FROM hits WHERE root IN (SELECT root FROM good))""")
def two_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Imports that leave the first folder out: open under the default roots, answered under the folders that enough of them promote."""
    p = files(spark, sf).select("path")
    bare = F.regexp_replace(F.regexp_extract("path", "^[^/]+/(.*)$", 1), r"(/__init__)?\.py$", "")
    spec = p.filter(F.endswith("path", F.lit(".py")) & ~F.contains("path", F.lit(".config."))).select(F.replace(bare, F.lit("/"), F.lit(".")).alias("specifier")).distinct()
    i = spec.select(F.xxhash64("specifier").alias("id"), F.lit("main.py").alias("path"), "specifier", F.lit(None).cast("string").alias("name"))
    return resolve_in_two_stages(i, p).select(F.col("specifier").alias("spec"), "target")


# Functions' metrics in Python; those of JavaScript and TypeScript are in scripts.py.
DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)
NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
METRICS = "path string, nloc int, function_count int, max_cyclomatic int, max_nesting int, max_operands int, max_function_nloc int, broad_handlers int, worst_symbol string, worst_line int"


def function_metrics(f: ast.AST) -> tuple[int, int, int]:
    """Cyclomatic complexity, depth of nested blocks and most operands of one condition; inner functions count for themselves."""
    complexity, deepest, operands = 1, 0, 0
    stack = [(child, 0, False) for child in ast.iter_child_nodes(f)]
    while stack:
        n, depth, inside = stack.pop()
        if isinstance(n, FUNCTIONS):
            continue
        is_elif = isinstance(n, ast.If) and getattr(n, "elif_", False)
        if isinstance(n, NESTING) and not is_elif:
            depth += 1
            deepest = max(deepest, depth)
        complexity += isinstance(n, DECISIONS)
        if isinstance(n, ast.comprehension):
            complexity += len(n.ifs)
        whole = isinstance(n, ast.BoolOp) and not inside
        if isinstance(n, ast.BoolOp):
            complexity += len(n.values) - 1
        if whole:
            operands = max(operands, 1 + sum(len(x.values) - 1 for x in ast.walk(n) if isinstance(x, ast.BoolOp)))
        if isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and n.orelse[0].col_offset == n.col_offset:
            n.orelse[0].elif_ = True
            stack += [(c, depth, inside or whole) for c in ast.iter_child_nodes(n) if c is not n.orelse[0]]
            stack.append((n.orelse[0], depth, False))
            continue
        stack += [(c, depth, inside or whole) for c in ast.iter_child_nodes(n)]
    return complexity, deepest, operands


def is_broad(n: ast.ExceptHandler) -> bool:
    """A bare except, or one of every exception that does nothing but pass."""
    if n.type is None:
        return True
    return isinstance(n.type, ast.Name) and n.type.id in ("Exception", "BaseException") and len(n.body) == 1 and isinstance(n.body[0], ast.Pass)


def file_metrics(source: str) -> dict | None:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines = source.split("\n")
    code = [bool(x.strip()) and not x.lstrip().startswith("#") for x in lines]
    for n in ast.walk(tree):  # a # that starts a line of a string is no comment
        if isinstance(n, ast.Constant) and isinstance(n.value, str) and n.end_lineno > n.lineno:
            for k in range(n.lineno, n.end_lineno):
                code[k] = bool(lines[k].strip())
    functions = [n for n in ast.walk(tree) if isinstance(n, FUNCTIONS[:2])]
    each = [(function_metrics(f), sum(code[f.lineno - 1 : f.end_lineno]), f) for f in functions]
    worst = max(each, key=lambda e: (e[0][0], -e[2].lineno), default=None)
    most = lambda k: max((k(e) for e in each), default=0)
    return {
        "nloc": sum(code), "function_count": len(each), "max_cyclomatic": most(lambda e: e[0][0]), "max_nesting": most(lambda e: e[0][1]), "max_operands": most(lambda e: e[0][2]),
        "max_function_nloc": most(lambda e: e[1]), "broad_handlers": sum(isinstance(n, ast.ExceptHandler) and is_broad(n) for n in ast.walk(tree)),
        "worst_symbol": worst[2].name if worst else None, "worst_line": worst[2].lineno if worst else None,
    }


def code_metrics(sources: DataFrame) -> DataFrame:
    """Metrics of every Python, JavaScript and TypeScript file, by path; of others, and of those that don't parse, all null."""

    def measure(path: str | None):
        return file_metrics if path and path.endswith(".py") else script_metrics if path and path.endswith(JS_EXTENSIONS) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("nloc", "function_count", "max_cyclomatic", "max_nesting", "max_operands", "max_function_nloc", "broad_handlers", "worst_symbol", "worst_line")
        for batch in batches:
            found = [measure(p)(t) if t is not None and measure(p) else None for p, t in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            columns = [pa.array([f[k] if f else None for f in found], pa.string() if k == "worst_symbol" else pa.int32()) for k in names]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], ["path", *names])

    return sources.select("path", "content").mapInArrow(run, METRICS)


def generated_functions(spark: SparkSession, sf: str) -> DataFrame:
    """path, content: a function whose branches, depth, operands and length follow from the file's size."""
    f = files(spark, sf).withColumn("s", (F.col("nloc") / 20).cast("int"))
    repeat = lambda text, n, sep: F.array_join(F.array_repeat(F.lit(text), n), sep)
    depth = F.transform(F.sequence(F.lit(1), F.col("s") % 5 + 1), lambda k: F.concat(F.repeat(F.lit("    "), k), F.lit("for i in a:")))
    deep = F.concat(F.array_join(depth, "\n"), F.lit("\n"), F.repeat(F.lit("    "), F.col("s") % 5 + 2), F.lit("pass\n"))
    text = F.concat(
        F.lit("# A comment\n\ndef worst(a, b):\n"), deep, repeat("    if a:\n        b = 1", F.col("s") % 7, "\n"), F.when(F.col("s") % 7 > 0, "\n").otherwise(""),
        F.lit("    c = "), repeat("a", F.col("s") % 4 + 1, " and "), F.lit("\n    return c\n\n\ndef other():\n    try:\n        pass\n    except"), F.when(F.col("s") % 2 == 0, ":").otherwise(" ValueError:"), F.lit("\n        pass\n"),
    )
    loops = F.col("s") % 5 + 1
    script = F.concat(
        F.lit("// if (a) { for (;;) {\n\nfunction worst(a, b) {\n"), F.array_join(F.array_repeat(F.lit("for (const i of a) {"), loops), "\n"), F.lit("\ngo(`}${a ? '}' : /[/}]/}`);\n"), F.array_join(F.array_repeat(F.lit("}"), loops), "\n"), F.lit("\n"),
        repeat("if (a) {\n  b = 1;\n}", F.col("s") % 7, "\n"), F.when(F.col("s") % 7 > 0, "\n").otherwise(""), F.lit("const c = "), repeat("a", F.col("s") % 4 + 1, " && "), F.lit(";\nreturn c;\n}\n\nexport const other = () => {\n  try {\n    go();\n  } catch (e) {\n"),
        F.when(F.col("s") % 2 == 0, "").otherwise("    throw e;\n"), F.lit("  }\n};\n"),
    )
    return f.select("path", F.when(F.col("path").rlike(r"\.(ts|tsx|js|jsx)$"), script).otherwise(text).alias("content"))


_BOTH = "CASE WHEN py THEN {py} WHEN js THEN {js} END"
_WORST = "1 + 2 * (s % 5 + 1) + 1 + 3 * (s % 7) + 3"


#: Metrics of the generated functions, by file, as table cm; null where nothing reads the file's language.
CODE_METRICS_SQL = f"""ms AS (SELECT id, path, nloc // 20 AS s, ends_with(path, '.py') AS py, regexp_matches(path, '\\.(ts|tsx|js|jsx)$') AS js FROM files),
cm AS (SELECT id, path, {_BOTH.format(py='s % 5 + 5 + 2 * (s % 7) + 5', js=f'{_WORST} + 6 + s % 2')} AS nloc, CASE WHEN py OR js THEN 2 END AS function_count, {_BOTH.format(py='greatest(2, 1 + s % 5 + 1 + s % 7 + s % 4)', js='greatest(2, 2 + s % 5 + 1 + s % 7 + s % 4)')} AS max_cyclomatic, CASE WHEN py OR js THEN s % 5 + 1 END AS max_nesting,
CASE WHEN py OR js THEN CASE WHEN s % 4 = 0 THEN 0 ELSE s % 4 + 1 END END AS max_operands, {_BOTH.format(py='greatest(5, s % 5 + 5 + 2 * (s % 7))', js=f'greatest(6 + s % 2, {_WORST})')} AS max_function_nloc, CASE WHEN py OR js THEN CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END END AS broad_handlers, CASE WHEN py OR js THEN 'worst' END AS worst_symbol FROM ms)"""


@query("hs_code_metrics", f"WITH {FILES_SQL}, {CODE_METRICS_SQL} SELECT * EXCLUDE (id) FROM cm")
def metrics_query(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of generated functions of known shape."""
    return code_metrics(generated_functions(spark, sf)).drop("worst_line")
