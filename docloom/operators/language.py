"""Query understanding without a network: term rules, intents, and the guarded SQL action."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TermRule:
    """Replaces source by target: everywhere (exact) or only as a whole word."""

    source: str
    target: str
    whole_word: bool = False
    priority: int | None = None
    enabled: bool = True
    deleted: bool = False


def map_terms(text: Column, rules: list[TermRule]) -> Column:
    """Applies the rules in ascending priority (none: 100), each to what the ones before left."""
    live = [r for r in rules if r.enabled and not r.deleted and r.source.strip() and r.target.strip()]
    for r in sorted(live, key=lambda r: 100 if r.priority is None else r.priority):
        if r.whole_word:
            text = F.regexp_replace(text, rf"(?<![A-Za-z0-9_]){re.escape(r.source)}(?![A-Za-z0-9_])", r.target.replace("\\", "\\\\").replace("$", "\\$"))
        else:
            text = F.replace(text, F.lit(r.source), F.lit(r.target))
    return text


# Intents, and words that tell them in the offline classifier.
INTENTS = ["KNOWLEDGE_QA", "CHIT_CHAT", "PRECISE_SEARCH", "SUMMARY", "UNKNOWN"]
INTENT_SIGNS = {"SUMMARY": r"(?i)summar|总结|概括", "PRECISE_SEARCH": r"(?i)\b(find|search|where is)\b|查找|搜索", "CHIT_CHAT": r"(?i)^\s*(hi|hello|thanks|thank you)\b|你好|谢谢"}


def intent(text: Column) -> Column:
    """The first sign that matches; blank is UNKNOWN, all else KNOWLEDGE_QA."""
    out = F.when(text.isNull() | ~text.rlike(r"\S"), "UNKNOWN")
    for name, sign in INTENT_SIGNS.items():
        out = out.when(text.rlike(sign), name)
    return out.otherwise("KNOWLEDGE_QA")


def is_knowledge_qa(intent_: Column) -> Column:
    """As needs_retrieval, and what could not be told as well."""
    return needs_retrieval(intent_) | (intent_ == "UNKNOWN")


def needs_retrieval(intent_: Column) -> Column:
    return intent_.isin("KNOWLEDGE_QA", "PRECISE_SEARCH", "SUMMARY")


class RejectedSql(ValueError):
    """A statement that the guard does not let through."""


# What a guarded statement may consist of. Kinds of plan nodes and of expressions as Spark's parser makes them, and names of functions.
PLAN_NODES = frozenset(
    """Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Sample Sort SubqueryAlias
    Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition""".split()
)
EXPRESSIONS = frozenset(
    """Add AggregateExpression Alias And AnyValue AttributeReference BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Concat Cube CurrentRow$ Divide EqualNullSafe EqualTo Exists
    GreaterThan GreaterThanOrEqual GroupingSets ILike In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal
    MultiAlias Multiply Not NotLikeAll NotLikeAny Or Overlay RLike Remainder Rollup ScalarSubquery SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimLeft StringTrimRight Substring Subtract
    TimestampAdd TimestampDiff UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator
    UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar UnresolvedSubqueryColumnAliases UnresolvedWindowExpression UnspecifiedFrame$ WindowExpression WindowSpecDefinition WindowSpecReference""".split()
)
FUNCTIONS = frozenset(
    """abs aggregate any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_position array_size array_sort arrays_zip ascii avg
    between bool_and bool_or bround cardinality cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr count count_if covar_pop covar_samp cume_dist current_date
    current_timestamp date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank element_at endswith every exists exp explode explode_outer
    extract filter find_in_set first first_value flatten floor forall from_unixtime get_json_object greatest grouping grouping_id hour if ifnull initcap instr isnan isnotnull isnull kurtosis lag last last_day
    last_value lcase lead least left length levenshtein listagg ln locate log log10 log2 lower lpad ltrim make_date map map_keys map_values max max_by mean median min min_by minute mod mode month months_between
    named_struct next_day now nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx percentile_cont percentile_disc pmod posexplode position pow power quarter rank regexp_count regexp_extract
    regexp_extract_all regexp_like regexp_replace regr_slope repeat replace reverse right round row_number rpad rtrim second sequence sign signum size skewness slice some sort_array split split_part sqrt
    startswith std stddev stddev_pop stddev_samp string_agg struct substr substring substring_index sum timestamp to_date to_timestamp transform translate trim trunc try_add try_divide try_to_timestamp ucase
    unix_timestamp upper var_pop var_samp variance weekday weekofyear width_bucket year zip_with""".split()
)


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _checked(expression) -> None:
    """Raises unless an expression and all below it are of known kinds and call known functions."""
    kind = _kind(expression)
    if kind not in EXPRESSIONS:
        raise RejectedSql(f"not allowed in a query: {kind}")
    if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
        name = ".".join(map(str, _each(expression.nameParts()))) if kind == "UnresolvedFunction" else expression.name().unquotedString()
        if name.lower() not in FUNCTIONS:
            raise RejectedSql(f"not a function for queries: {name}")
    for inner in _each(expression.children()):
        _checked(inner)


def tables_read(spark: SparkSession, statement: str) -> set[str]:
    """The tables that a pure query names, by Spark's parser and before anything runs. CTE names count only where their WITH holds.

    Only nodes, expressions and functions of the lists pass: a name that is made by an expression, a command, a
    table function or a call out of the engine is none of them, however it is written.
    """
    found: set[str] = set()

    def walk(plan, scope: frozenset[str]) -> None:
        kind = _kind(plan)
        if kind not in PLAN_NODES:
            raise RejectedSql(f"only queries, not {kind}")
        if kind == "UnresolvedRelation":
            parts = [str(x).lower() for x in _each(plan.multipartIdentifier())]
            if len(parts) > 1 or parts[0] not in scope:
                found.add(".".join(parts))
        if kind == "UnresolvedWith":
            for relation in _each(plan.cteRelations()):
                name = str(relation._1()).lower()
                walk(relation._2(), scope | {name} if plan.allowRecursion() else scope)
                scope = scope | {name}
        for expression in _each(plan.expressions()):
            _checked(expression)
        for inner in [*_each(plan.children()), *_each(plan.subqueries())]:
            walk(inner, scope)

    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement), frozenset())
    return found


def relations_resolved(df: DataFrame) -> set[str]:
    """The views and tables that the analysed plan of a query stands on; what stands on none of them and is no constant is told by its kind."""
    found: set[str] = set()

    def walk(plan) -> None:
        kind = _kind(plan)
        if kind == "View":
            found.add(str(plan.desc().identifier().table()).lower())
            return
        inner = [*_each(plan.children()), *_each(plan.subqueries())]
        if not inner and kind not in ("OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef"):
            known = kind == "LogicalRelation" and plan.catalogTable().isDefined()
            found.add(str(plan.catalogTable().get().identifier().table()).lower() if known else f"<{kind}>")
        for p in inner:
            walk(p)

    walk(df._jdf.queryExecution().analyzed())
    return found


def guarded_sql(spark: SparkSession, statement: str, tables: set[str] | None = None, max_rows: int = 100) -> DataFrame:
    """Runs one read-only SELECT or WITH: its parsed plan consists of what the lists allow, and it names and stands on ``tables`` only, where they are given. Nothing runs before both are checked."""
    bare = statement.strip()
    if re.search(r";|--|/\*", bare):
        raise RejectedSql("one statement without comments")
    if not re.match(r"(?i)(select|with)\b", bare) or re.search(r"(?i)\binto\s+(outfile|dumpfile)\b", bare):
        raise RejectedSql("only SELECT and WITH")
    allowed, named = None if tables is None else {t.lower() for t in tables}, tables_read(spark, bare)
    if allowed is not None and (extra := named - allowed):
        raise RejectedSql(f"not allowed: {', '.join(sorted(extra))}")
    df = spark.sql(bare)
    if allowed is not None and (extra := relations_resolved(df) - {t.split(".")[-1] for t in allowed}):
        raise RejectedSql(f"not allowed: {', '.join(sorted(extra))}")
    return df.limit(max_rows)
