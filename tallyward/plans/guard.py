"""A read-only SQL surface: Spark's own parser decides what a statement is, an allowlist what it may read."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Row, SparkSession

MOST_ROWS = 200
#: The kinds of logical plan nodes that only read.
READING = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Limit Offset Distinct Union Except Intersect SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving "
    "WithWindowDefinition Pivot UnresolvedPivot Unpivot UnresolvedSubqueryColumnAliases Window OneRowRelation UnresolvedInlineTable LocalRelation GroupingSets Generate Tail CTERelationRef WithCTE CTERelationDef SetOperation LateralJoin Expand Sample".split()
)


#: Functions that a statement may call. None of them reads files, settings, the session or the machine, or runs code.
FUNCTIONS = frozenset(
    "abs acos approx_count_distinct approx_percentile array array_contains array_distinct array_join array_max array_min array_size array_sort ascii asin atan atan2 avg bit_count bool_and bool_or bround cardinality cast cbrt ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if "
    "covar_pop covar_samp cume_dist current_date current_timestamp date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear degrees dense_rank element_at endswith every exp explode extract first first_value floor format_number format_string from_unixtime get greatest grouping grouping_id "
    "hour if ifnull in initcap instr isnan isnotnull isnull kurtosis lag last last_day last_value lead least left len length ln log log10 log2 lower lpad ltrim make_date map_keys map_values max max_by mean median min min_by minute mod mode month months_between named_struct nanvl next_day not now nth_value ntile nullif nullifzero nvl nvl2 "
    "percent_rank percentile percentile_approx pi pmod posexplode position positive pow power quarter radians rank regexp_count regexp_extract regexp_like regexp_replace regr_count repeat replace reverse right rint rlike round row_number rpad rtrim second sequence sha2 sign signum sin size skewness slice some sort_array split sqrt startswith "
    "std stddev stddev_pop stddev_samp string struct substr substring sum tan timestamp to_date to_timestamp translate trim trunc try_add try_avg try_cast try_divide try_subtract try_sum try_to_timestamp unix_timestamp upper var_pop var_samp variance weekday weekofyear width_bucket window year zeroifnull".split()
)


class Refused(ValueError):
    """The statement isn't allowed; the message says why."""


def _each(seq) -> list:
    it, out = seq.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def _expression(e) -> None:
    kind = e.getClass().getSimpleName()
    if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        name = [str(x).lower() for x in _each(e.nameParts())] if kind == "UnresolvedFunction" else [str(e.name().funcName()).lower()]
        if len(name) != 1 or name[0] not in FUNCTIONS:
            raise Refused(f"function {'.'.join(name)} isn't on the list")
    elif "UnresolvedIdentifier" in kind:
        raise Refused("names can't be computed")
    elif kind == "UnresolvedAttribute" and any(str(x).lower() == "_metadata" for x in _each(e.nameParts())):
        raise Refused("file metadata can't be read")
    for x in _each(e.children()):
        _expression(x)


def _walk(plan, scope: frozenset[str], tables: frozenset[str]) -> None:
    """Refuse what isn't allowed in plan, where the common table expressions in scope can be named."""
    kind = plan.getClass().getSimpleName()
    if kind not in READING:
        raise Refused(f"{kind} isn't allowed")
    if kind == "UnresolvedWith":  # each is seen by those after it and by the statement, and nowhere else
        for entry in _each(plan.cteRelations()):
            _walk(entry._2(), scope, tables)
            scope |= {str(entry._1()).lower()}
    elif kind == "UnresolvedRelation":
        name = [str(x).lower() for x in _each(plan.multipartIdentifier())]
        if not (len(name) == 1 and name[0] in scope) and ".".join(name) not in tables:
            raise Refused(f"{'.'.join(name)} isn't on the allowlist")
    for e in _each(plan.expressions()):
        _expression(e)
    for x in (*_each(plan.children()), *_each(plan.subqueries())):
        _walk(x, scope, tables)


def check(spark: SparkSession, sql: str, allowed: Iterable[str]) -> None:
    """Raise Refused unless sql is one SELECT (set operations included) over allowed tables, with listed functions."""
    if not sql or not sql.strip():
        raise Refused("no statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # the parser's own error, wrapped or not
        raise Refused(f"not one valid statement: {str(e).splitlines()[0] if isinstance(e, ParseException) else 'syntax error'}") from e
    _walk(plan, frozenset(), frozenset(t.lower() for t in allowed))


#: What a name can turn out to be, without being a column, that tells of the session or the machine.
SESSION = frozenset("VariableReference CurrentUser CurrentDatabase CurrentCatalog InputFileName InputFileBlockStart InputFileBlockLength SparkPartitionID MonotonicallyIncreasingID FileSourceMetadataAttribute SparkVersion CurrentTimeZone CallMethodViaReflection Uuid".split())


def _resolved(plan, views: frozenset[str]) -> None:
    """Refuse an analysed plan whose names turned out to be anything but columns, or whose leaves lie outside the views."""
    kind = plan.getClass().getSimpleName()
    for e in _each(plan.expressions()):
        _resolved_expression(e)
    for x in _each(plan.subqueries()):
        _resolved(x, views)
    if kind == "SubqueryAlias" and str(plan.identifier().name()).lower() in views:
        return  # what lies below is the table that was given
    children = _each(plan.children())
    if not children and kind not in ("OneRowRelation", "LocalRelation", "CTERelationRef"):
        raise Refused(f"{kind} isn't an allowed table")
    for x in (*children, *([d for d in _each(plan.cteDefs())] if kind == "WithCTE" else [])):
        _resolved(x, views)


def _resolved_expression(e) -> None:
    kind = e.getClass().getSimpleName()
    if kind in SESSION:
        raise Refused(f"{kind} isn't a column")
    for x in _each(e.children()):
        _resolved_expression(x)


def run(spark: SparkSession, sql: str, allowed: Mapping[str, DataFrame], most_rows: int = MOST_ROWS, args: dict | None = None) -> DataFrame:
    """The result of a checked statement, of at most most_rows rows. Tables are given by schema.table.

    Each allowed table is a temporary view under a name of this call's own, for the time of planning. The statement is
    checked three times: as given; with the views in the places where the parser found tables, where each relation must be
    one of these views; and as Spark has analysed it, where every leaf must be one of them, and no name may have turned
    out to be a session variable or a session's property. args fill the statement's named parameters (:name), as values,
    never as text.
    """
    check(spark, sql, allowed)
    views = {name.lower(): f"allowed_{uuid.uuid4().hex}" for name in allowed}
    renamed = _renamed(spark, sql, views)
    check(spark, renamed, views.values())
    try:
        for name, df in allowed.items():
            df.createOrReplaceTempView(views[name.lower()])
        result = spark.sql(renamed, args=args) if args else spark.sql(renamed)
        _resolved(result._jdf.queryExecution().analyzed(), frozenset(views.values()))
        return result.limit(most_rows)
    finally:  # the plan holds the tables themselves by now
        for view in views.values():
            spark.catalog.dropTempView(view)


def _renamed(spark: SparkSession, sql: str, views: Mapping[str, str]) -> str:
    """The statement with views in the places of the allowed tables, as the parser has them; everything else stays.

    A table without an alias gets its own name as one, so that columns can still be qualified by it, with its schema or
    without.
    """
    edits: dict[int, tuple[int, str]] = {}
    qualified: list[tuple[int, int, list[str]]] = []

    def span(node) -> tuple[int, int]:
        return node.origin().startIndex().get(), node.origin().stopIndex().get() + 1

    def expression(e) -> None:
        kind = e.getClass().getSimpleName()
        names = _each(e.nameParts()) if kind == "UnresolvedAttribute" else _each(e.target().get()) if kind == "UnresolvedStar" and e.target().isDefined() else []
        if len(names) >= (2 if kind == "UnresolvedStar" else 3):
            qualified.append((*span(e), [str(x) for x in names]))
        for x in _each(e.children()):
            expression(x)

    def walk(plan, parent: str) -> None:
        if plan.getClass().getSimpleName() == "UnresolvedRelation":
            name = [str(x) for x in _each(plan.multipartIdentifier())]
            if (view := views.get(".".join(name).lower())) is not None:
                start, end = span(plan)
                edits[start] = (end, view if parent in ("SubqueryAlias", "Sample", "GlobalLimit", "LocalLimit") else f"{view} AS `{name[-1].replace('`', '``')}`")
        kind = plan.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            for entry in _each(plan.cteRelations()):
                walk(entry._2(), "")
        for e in _each(plan.expressions()):
            expression(e)
        for x in (*_each(plan.children()), *_each(plan.subqueries())):
            walk(x, kind)

    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), "")
    for start, end, names in qualified:
        if ".".join(names[:2]).lower() in views:  # schema.table.column: the alias is the table's name
            rest = ".".join(f"`{x.replace('`', '``')}`" for x in names[1:])
            edits[start] = (end, rest + (".*" if sql[start:end].rstrip().endswith("*") else ""))
    out, at = [], 0
    for start, (end, text) in sorted(edits.items()):
        out += [sql[at:start], text]
        at = end
    return "".join([*out, sql[at:]])


def ask(spark: SparkSession, question: str, generator: Callable[[str], str], allowed: Mapping[str, DataFrame]) -> DataFrame:
    """The guarded result of whatever statement the generator makes of a question."""
    return run(spark, generator(question), allowed)


def answer(spark: SparkSession, question: str, generator: Callable[[str], str], allowed: Mapping[str, DataFrame], seconds: float = 30.0) -> list[Row]:
    """ask()'s rows, at most MOST_ROWS. Work that takes longer than `seconds` is cancelled, and TimeoutError raised."""
    sc, group, late = spark.sparkContext, f"ask-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    result = ask(spark, question, generator, allowed)
    before = [(k, sc.getLocalProperty(k)) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")]
    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, question, interruptOnCancel=True)
    timer.start()
    try:
        return result.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no answer within {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        for k, v in before:
            sc.setLocalProperty(k, v)


#: What each role may read.
ROLES = {"bi": ("features.fact_feature_snapshots", "decisions.fact_decisions"), "pipeline": ("features.fact_feature_snapshots", "dim.dim_users", "dim.dim_devices"), "agent": ("features.fact_feature_snapshots", "decisions.fact_decisions", "dim.dim_users")}


def tables_for(role: str, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that a role may read; unknown, empty and administrator roles are refused."""
    if role not in ROLES:
        raise Refused(f"role {role!r} is not a reading role")
    return {k: v for k, v in tables.items() if k.lower() in ROLES[role]}


def connected(spark: SparkSession, role: str, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """tables_for(role), after trying what the role can do: each of its tables must answer, and each other one be refused."""
    own = tables_for(role, tables)
    probe = lambda name: run(spark, f"SELECT 1 AS one FROM {name} LIMIT 1", own)
    for name in tables:
        if name in own:
            probe(name).collect()
            continue
        try:
            probe(name)
        except Refused:
            continue
        raise Refused(f"role {role!r} reaches {name}, which isn't its own")
    return own
