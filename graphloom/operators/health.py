"""Health axes of files, compiled from declared markers: severities, category and axis caps, withheld and provisional values.

A marker is data: what it reads, where its severity begins and saturates, what it weighs, and when it can't apply. An
axis is markers, caps, reasons to leave a file out, and the marker without which its value isn't shown. ``compiled``
makes one expression of an axis; inputs come from the files' own metrics, the graph's components and history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.aggregates import nearest_ranks
from graphloom.operators.code import CODE_METRICS_SQL, code_metrics, generated_functions
from graphloom.operators.graph import SCC_SQL, degrees, strong_components, whole_graph
from graphloom.operators.text import FIXED_SQL, fixed
from graphloom.plans.projections import FILE_HIST_SQL, FILES_SQL, file_history, files
from graphloom.plans.rounds import written
from graphloom.registry import query
from graphloom.session import table

AXIS_CAP, REVIEW_FLOOR = 9.0, 30  # fixed values: the most an axis loses, the fewest lines that a review costs


@dataclass(frozen=True)
class Marker:
    """value, warn, saturate, applies and gate are SQL over the inputs' columns; a file outside the gate has severity 0.

    With ``factors`` (value, warn, saturate each) the value is the product of their severities.
    """

    key: str
    category: str
    weight: float
    value: str = ""
    warn: float | str = 0
    saturate: float | str = 0
    applies: str = "true"
    gate: str = "true"
    factors: tuple[tuple[str, float | str, float | str], ...] = ()


@dataclass(frozen=True)
class Axis:
    """required: markers whose missing input is declared; ``dominant``, or any of them if None, withholds the value."""

    name: str
    markers: tuple[Marker, ...]
    caps: dict[str, float]
    excluded: tuple[tuple[str, str], ...]
    required: tuple[str, ...] = ()
    dominant: str | None = None
    higher_is_better: bool = True


_HAS = "function_count > 0"
# Markers with their weights and thresholds, caps, and the least size of a file with substance.
MAINTAINABILITY = Axis(
    "maintainability",
    (
        Marker("complex_method", "complexity", 2.5, "max_cyclomatic", 10, 25, _HAS), Marker("deep_nesting", "complexity", 1.5, "max_nesting", 4, 8, _HAS), Marker("complex_conditional", "complexity", 1.0, "max_operands", 4, 10, _HAS),
        Marker("large_method", "size", 2.0, "max_function_nloc", 60, 200, _HAS), Marker("large_file", "size", 1.5, "nloc", 400, 1500), Marker("broad_error_handling", "error", 2.0, "broad_handlers", 0, 5),
    ),
    {"complexity": 4.0, "size": 3.0, "error": 2.0},
    (("too_small", "nloc < 10"), ("no_analyzer", "NOT analysed")),
)
ARCHITECTURE = Axis(
    "architecture",
    (Marker("cycle_participation", "cycles", 4.0, "cycle_size", 1, 12), Marker("bidirectional_coupling_hub", "coupling", 3.0, "CASE WHEN fan_in IS NOT NULL AND fan_out IS NOT NULL THEN least(fan_in, fan_out) END", "least(i90, o90)", "least(i99, o99)", gate="fan_in >= i90 AND fan_out >= o90")),
    {"cycles": 4.0, "coupling": 3.0},
    (("no_graph", "cycle_size IS NULL AND fan_in IS NULL"),),
    ("cycle_participation", "bidirectional_coupling_hub"),
    "cycle_participation",
)
CHANGE_HOTSPOT = Axis(
    "change_hotspot",
    (Marker("churn_volume", "hotspot", 2.5, "commits", "c50", "c95"), Marker("complexity_under_churn", "hotspot", 2.5, warn=0.2, saturate=0.8, applies=f"analysed AND {_HAS}", factors=(("max_cyclomatic", 10, 25), ("commits", "c50", "c95")))),
    {"hotspot": 5.0},
    (("no_variation", "NOT usable"), ("too_small", "nloc < 10"), ("no_history", "commits = 0")),
    higher_is_better=False,
)
AXES = (MAINTAINABILITY, ARCHITECTURE, CHANGE_HOTSPOT)


def ramp(v: Column, warn: Column | float, saturate: Column | float) -> Column:
    """0 up to warn, 1 from saturate on, linear between; a step at warn where these don't differ; null of null."""
    v, warn, saturate = v.cast("double"), *(x if isinstance(x, Column) else F.lit(float(x)) for x in (warn, saturate))
    return F.when(v.isNull(), None).when(v <= warn, 0.0).when((saturate <= warn) | (v >= saturate), 1.0).otherwise((v - warn) / (saturate - warn))


def bound(x: float | str) -> Column | float:
    return F.expr(x).cast("double") if isinstance(x, str) else x


def marker_state(m: Marker) -> tuple[Column, Column]:
    """State and deduction (null where there is none) of a marker."""
    value = F.expr(m.value) if m.value else None
    if m.factors:
        value = ramp(F.expr(m.factors[0][0]), bound(m.factors[0][1]), bound(m.factors[0][2]))
        for v, warn, saturate in m.factors[1:]:
            value = value * ramp(F.expr(v), bound(warn), bound(saturate))
    lost = m.weight * F.when(F.expr(m.gate), ramp(value, bound(m.warn), bound(m.saturate))).otherwise(0.0)
    known = F.expr(m.applies) & value.isNotNull()
    state = F.when(~F.expr(m.applies), "not_applicable").when(value.isNull(), "no_input").when(lost > 0, "fired").otherwise("zero_severity")
    return state, F.when(known, lost)


def compiled(axis: Axis, rows: DataFrame) -> DataFrame:
    """The rows and a struct of the axis's name: na_reason, value (a score, or points), provisional, missing, categories_capped, axis_capped, markers.

    A category takes off no more than its cap, the axis no more than AXIS_CAP; which caps bind is told. The value is
    withheld where the dominant input is missing, and where any required one is, it is given as provisional too.
    """
    told = [(m, *marker_state(m)) for m in axis.markers]
    rows = rows.withColumn("_m", F.array(*(F.struct(F.lit(m.key).alias("key"), F.lit(m.category).alias("category"), s.alias("state"), d.alias("deduction")) for m, s, d in told)))
    raw = {c: sum((F.coalesce(d, F.lit(0.0)) for m, _, d in told if m.category == c), F.lit(0.0)) for c in axis.caps}
    total = sum((F.least(r, F.lit(axis.caps[c])) for c, r in raw.items()), F.lit(0.0))
    capped = F.filter(F.array(*(F.when(r > axis.caps[c], F.lit(c)) for c, r in raw.items())), lambda x: x.isNotNull())
    missing = F.transform(F.filter("_m", lambda x: (x["state"] == "no_input") & x["key"].isin(*axis.required)), lambda x: x["key"])
    value = F.least(total, F.lit(AXIS_CAP))
    value = fixed(10 - value if axis.higher_is_better else value, 6)
    reason = F.lit(None).cast("string")
    for name, test in reversed(axis.excluded):
        reason = F.when(F.expr(test), name).otherwise(reason)
    withheld = F.array_contains(missing, axis.dominant) if axis.dominant else F.size(missing) > 0
    judged = reason.isNull()
    only = lambda c: F.when(judged, c)
    out = F.struct(
        reason.alias("na_reason"), F.when(judged & ~withheld, value).alias("value"), F.when(judged & (F.size(missing) > 0), value).alias("provisional"), only(missing).alias("missing"),
        only(capped).alias("categories_capped"), only(total > AXIS_CAP).alias("axis_capped"), only(F.col("_m")).alias("markers"),
    )
    return rows.withColumn(axis.name, out).drop("_m")


# The same in SQL, from the same declarations.
def _ramp_sql(v: str, a: float | str, b: float | str) -> str:
    return f"CASE WHEN ({v}) IS NULL THEN NULL WHEN ({v}) <= {a} THEN 0 WHEN {b} <= {a} OR ({v}) >= {b} THEN 1 ELSE (({v}) - {a}) / CAST({b} - {a} AS DOUBLE) END"


def axis_sql(axis: Axis) -> str:
    """Tables <axis>_d (id and each marker's state and deduction) and <axis> (the struct's fields) over table h."""
    columns, keys = [], [m.key for m in axis.markers]
    for m in axis.markers:
        value = " * ".join(f"({_ramp_sql(*f)})" for f in m.factors) if m.factors else m.value
        columns.append(f"CASE WHEN NOT ({m.applies}) THEN 'not_applicable' WHEN ({value}) IS NULL THEN 'no_input' ELSE CASE WHEN {m.gate} THEN {_ramp_sql(value, m.warn, m.saturate)} ELSE 0 END::VARCHAR END AS s_{m.key}")
    of = lambda c: " + ".join(f"coalesce(d_{m.key}, 0)" for m in axis.markers if m.category == c)
    total = " + ".join(f"least({of(c)}, {cap}e0)" for c, cap in axis.caps.items())
    value = FIXED_SQL.format(x=f"10e0 - least(total, {AXIS_CAP}e0)" if axis.higher_is_better else f"least(total, {AXIS_CAP}e0)", n=6)
    reason = "CASE " + " ".join(f"WHEN {t} THEN '{n}'" for n, t in axis.excluded) + " END"
    missing = "list_filter([" + ", ".join(f"CASE WHEN s_{k} = 'no_input' THEN '{k}' END" for k in axis.required) + "]::VARCHAR[], lambda x: x IS NOT NULL)"
    capped = "list_filter([" + ", ".join(f"CASE WHEN {of(c)} > {cap}e0 THEN '{c}' END" for c, cap in axis.caps.items()) + "]::VARCHAR[], lambda x: x IS NOT NULL)"
    withheld = f"list_contains(missing, '{axis.dominant}')" if axis.dominant else "len(missing) > 0"
    n = axis.name
    deductions = ", ".join(f"{m.weight}e0 * TRY_CAST(s_{m.key} AS DOUBLE) AS d_{m.key}" for m in axis.markers)
    states = ", ".join(f"CASE WHEN d_{k} > 0 THEN 'fired' WHEN d_{k} = 0 THEN 'zero_severity' ELSE s_{k} END AS s_{k}" for k in keys)
    return f"""{n}_0 AS (SELECT *, {', '.join(columns)} FROM h), {n}_1 AS (SELECT *, {deductions} FROM {n}_0), {n}_2 AS (SELECT *, {reason} AS na_reason, {total} AS total, {missing} AS missing, {capped} AS capped FROM {n}_1), {n}_d AS (SELECT * REPLACE ({states}) FROM {n}_2 WHERE na_reason IS NULL),
{n} AS (SELECT id, path, nloc, na_reason, CASE WHEN na_reason IS NULL AND NOT ({withheld}) THEN {value} END AS value, CASE WHEN na_reason IS NULL AND len(missing) > 0 THEN {value} END AS provisional, CASE WHEN na_reason IS NULL THEN missing END AS missing, CASE WHEN na_reason IS NULL THEN capped END AS categories_capped, CASE WHEN na_reason IS NULL THEN total > {AXIS_CAP} END AS axis_capped FROM {n}_2)"""


NEAREST = "list_sort(list({x}))[CAST(round_even({p} / 100.0 * (count({x}) - 1), 0) AS INTEGER) + 1]"
HEALTH_SQL = f"""{SCC_SQL}, {FILES_SQL}, {FILE_HIST_SQL}, {CODE_METRICS_SQL}, z AS (SELECT scc_id, count(*) AS n FROM scc GROUP BY 1), fi AS (SELECT dst AS id, count(*) AS fan_in FROM g1 GROUP BY 1), fo AS (SELECT src AS id, count(*) AS fan_out FROM g1 GROUP BY 1),
hi AS (SELECT files.id, files.path, coalesce(cm.nloc, files.nloc) AS nloc, cm.nloc IS NOT NULL AS analysed, coalesce(function_count, 0) AS function_count, max_cyclomatic, max_nesting, max_operands, max_function_nloc, broad_handlers, CASE WHEN cm.nloc IS NOT NULL THEN z.n END AS cycle_size, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, commits
FROM files JOIN cm USING (id) JOIN scc USING (id) JOIN z USING (scc_id) JOIN fhist USING (id) LEFT JOIN fi USING (id) LEFT JOIN fo USING (id)),
cx AS (SELECT count(DISTINCT commits) >= 3 AS usable, {", ".join(f"CAST({NEAREST.format(x=x, p=p)} AS DOUBLE) AS {n}" for x, p, n in (("commits", 50, "c50"), ("commits", 95, "c95"), ("fan_in", 90, "i90"), ("fan_in", 99, "i99"), ("fan_out", 90, "o90"), ("fan_out", 99, "o99")))} FROM hi), h AS (SELECT * FROM hi, cx)"""


def inputs(spark: SparkSession, sf: str) -> DataFrame:
    """A file's measures joined to its facts from the graph and from history; what wasn't measured is null.

    Only files whose language is read have metrics, and a place in a circle of imports.
    """
    e, n, _ = whole_graph(spark, sf)
    c = strong_components(e, n).select("id", F.col("scc_size").alias("cycle_size"))
    m = code_metrics(generated_functions(spark, sf)).drop("worst_symbol", "worst_line").withColumnRenamed("nloc", "code_nloc")
    f = files(spark, sf).select("id", "path", F.col("nloc").alias("lines"))
    j = f.join(m, "path").join(c, "id").join(degrees(e, n), "id").join(file_history(spark, sf).select("id", "commits"), "id")
    read = F.col("code_nloc").isNotNull()
    j = j.select("id", "path", F.coalesce("code_nloc", "lines").alias("nloc"), read.alias("analysed"), F.coalesce("function_count", F.lit(0)).alias("function_count"), "max_cyclomatic", "max_nesting", "max_operands", "max_function_nloc", "broad_handlers", F.when(read, F.col("cycle_size")).alias("cycle_size"), "fan_in", "fan_out", "commits")
    return written(j, "health-inputs")


def context(h: DataFrame) -> DataFrame:
    """One row: whether churn tells files apart, and nearest-rank percentiles of churn and coupling."""
    out = h.agg((F.countDistinct("commits") >= 3).alias("usable"))
    for column, points, names in (("commits", (50, 95), ("c50", "c95")), ("fan_in", (90, 99), ("i90", "i99")), ("fan_out", (90, 99), ("o90", "o99"))):
        out = out.crossJoin(nearest_ranks(h, [], column, points).select(*(F.col(f"p{p}").cast("double").alias(n) for p, n in zip(points, names, strict=True))))  # one row each
    return out


def judged(spark: SparkSession, sf: str, axes: tuple[Axis, ...] = AXES) -> DataFrame:
    """Every file's inputs and axes, written."""
    h = inputs(spark, sf)
    h = h.crossJoin(F.broadcast(written(context(h), "context")))  # one row beside each
    for axis in axes:
        h = compiled(axis, h)
    return written(h, "judged")


@query("hs_inputs", f"WITH RECURSIVE {HEALTH_SQL} SELECT * EXCLUDE (path) FROM hi")
def inputs_query(spark: SparkSession, sf: str) -> DataFrame:
    return inputs(spark, sf).drop("path")


def axis_query(axis: Axis):
    """Registers an axis: its value or why there is none, what bounds it and what is missing, and every marker's state."""
    states = "[" + ", ".join(f"'{m.key}:' || s_{m.key}" for m in axis.markers) + "]"
    sql = f"WITH RECURSIVE {HEALTH_SQL}, {axis_sql(axis)} SELECT a.id, a.na_reason, a.value, a.provisional, a.missing, a.categories_capped, a.axis_capped, CASE WHEN d.id IS NOT NULL THEN {states} END AS states FROM {axis.name} a LEFT JOIN {axis.name}_d d USING (id)"

    @query(f"hs_{axis.name}", sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        a = judged(spark, sf, (axis,)).select("id", f"{axis.name}.*")
        return a.select(*[c for c in a.columns if c != "markers"], F.transform("markers", lambda m: F.concat(m["key"], F.lit(":"), m["state"])).alias("states"))

    return run


maintainability, architecture, change_hotspot = map(axis_query, AXES)

_ALL_SQL = f"WITH RECURSIVE {HEALTH_SQL}, " + ", ".join(map(axis_sql, AXES))
EXPOSURE_SQL = f"value / (greatest(nloc, {REVIEW_FLOOR}) / 100e0)"


def exposure() -> Column:
    """Points by what a review of the file costs."""
    return F.col("change_hotspot.value") / (F.greatest(F.col("nloc"), F.lit(REVIEW_FLOOR)) / 100)


@query("hs_axes", f"{_ALL_SQL} SELECT id, m.value AS maintainability, a.value AS architecture, c.value AS hotspot, {FIXED_SQL.format(x='c.' + EXPOSURE_SQL.replace('nloc', 'c.nloc'), n=6)} AS exposure FROM maintainability m JOIN architecture a USING (id) JOIN change_hotspot c USING (id)")
def axes_query(spark: SparkSession, sf: str) -> DataFrame:
    """The three axes side by side, and the third by effort."""
    return judged(spark, sf).select("id", F.col("maintainability.value").alias("maintainability"), F.col("architecture.value").alias("architecture"), F.col("change_hotspot.value").alias("hotspot"), fixed(exposure(), 6).alias("exposure"))


def marker_rows(rows: DataFrame, axes: tuple[Axis, ...] = AXES) -> DataFrame:
    return rows.select(F.inline(F.flatten(F.array(*(F.coalesce(f"{a.name}.markers", F.array()) for a in axes)))))


_LONG_SQL = " UNION ALL ".join(f"SELECT '{m.key}' AS marker, s_{m.key} AS state, d_{m.key} AS d FROM {a.name}_d" for a in AXES for m in a.markers)
_STATE_SQL = "CASE WHEN count(*) FILTER (state = 'fired') > 0 THEN 'fired' WHEN count(d) > 0 THEN 'zero_severity' WHEN count(*) FILTER (state = 'no_input') > 0 THEN 'no_input' ELSE 'not_applicable' END"


@query("agg_marker_rollup", f"{_ALL_SQL}, l AS ({_LONG_SQL}) SELECT marker, count(d) AS evaluated, count(*) FILTER (d > 0) AS fired, {FIXED_SQL.format(x='count(*) FILTER (d > 0) / count(d)', n=4)} AS fire_rate, {FIXED_SQL.format(x='avg(d)', n=4)} AS mean_deduction, {FIXED_SQL.format(x='max(d)', n=4)} AS max_deduction, {_STATE_SQL} AS state FROM l GROUP BY 1")
def marker_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """How often each marker was evaluated and fired, what it took off, and the strongest state it is in."""
    n, fired, d = F.count("deduction"), F.count_if(F.col("deduction") > 0), F.col("deduction")
    state = F.when(fired > 0, "fired").when(n > 0, "zero_severity").when(F.count_if(F.col("state") == "no_input") > 0, "no_input").otherwise("not_applicable")
    long = marker_rows(judged(spark, sf))
    return long.groupBy(F.col("key").alias("marker")).agg(n.alias("evaluated"), fired.alias("fired"), fixed(F.try_divide(fired, n), 4).alias("fire_rate"), fixed(F.avg(d), 4).alias("mean_deduction"), fixed(F.max(d), 4).alias("max_deduction"), state.alias("state"))


@query("agg_coverage", f"WITH RECURSIVE {HEALTH_SQL}, {axis_sql(ARCHITECTURE)}, l AS ({' UNION ALL '.join(f"SELECT '{m.key}' AS marker, d_{m.key} AS d FROM architecture_d" for m in ARCHITECTURE.markers)}), k AS (SELECT marker, coalesce(max(d), 0) > 0 AS active FROM l GROUP BY 1) SELECT (SELECT count(DISTINCT cycle_size) FROM hi WHERE cycle_size > 1) AS file_level_cycles, coalesce((SELECT list_sort(list(marker)) FROM k WHERE active), []) AS active, coalesce((SELECT list_sort(list(marker)) FROM k WHERE NOT active), []) AS inactive")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Which markers of the architecture axis fired at all. Cycles are counted by distinct sizes, not by components."""
    j = judged(spark, sf, (ARCHITECTURE,))
    cycles = j.agg(F.countDistinct(F.when(F.col("cycle_size") > 1, F.col("cycle_size"))).alias("file_level_cycles"))
    k = marker_rows(j, (ARCHITECTURE,)).groupBy("key").agg((F.coalesce(F.max("deduction"), F.lit(0.0)) > 0).alias("active"))
    named = k.agg(F.array_sort(F.collect_list(F.when(F.col("active"), F.col("key")))).alias("active"), F.array_sort(F.collect_list(F.when(~F.col("active"), F.col("key")))).alias("inactive"))  # one row for each marker
    return cycles.crossJoin(named)  # one row each


@query("srt_health_files", f"WITH RECURSIVE {HEALTH_SQL}, {axis_sql(CHANGE_HOTSPOT)}, x AS (SELECT id, {FIXED_SQL.format(x=EXPOSURE_SQL, n=6)} AS exposure FROM change_hotspot) SELECT id, exposure, (SELECT count(*) FROM x WHERE exposure IS NULL) AS not_available FROM x WHERE exposure IS NOT NULL ORDER BY exposure DESC, id LIMIT 40")
def health_files(spark: SparkSession, sf: str, top: int = 40) -> DataFrame:
    """Files by exposure for the effort of a review; those without a value are left out and counted."""
    x = judged(spark, sf, (CHANGE_HOTSPOT,)).select("id", fixed(exposure(), 6).alias("exposure"))
    none = F.broadcast(x.agg(F.count_if(F.col("exposure").isNull()).alias("not_available")))  # one row
    return x.filter("exposure is not null").orderBy(F.desc("exposure"), "id").limit(top).crossJoin(none)


@query("hs_bands", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE CASE WHEN c_acctbal / 100 >= 70 THEN 'good' WHEN c_acctbal / 100 >= 45 THEN 'fair' ELSE 'poor' END END AS band FROM customer")
def bands(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100)
    return table(spark, sf, "customer").select("c_custkey", F.when(v >= 70, "good").when(v >= 45, "fair").when(v.isNotNull(), "poor").alias("band"))
