"""What ad-hoc SQL may contain: an allow-list over the plan that Spark's own parser gives.

Nothing is analysed or run before the check, and no setting of the session is touched. Functions
outside the list are refused, with them all that call Java methods, read files or reach other systems;
so are relations other than registered views, names of several parts (paths among them),
table-valued functions, commands and everything else that is not listed. A function that the
session itself has registered under a listed name is taken for the listed one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

RELATIONS = set(
    """Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LocalLimit LocalRelation Offset
    OneRowRelation Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition""".split()
)
EXPRESSIONS = set(
    """Add Alias And AttributeReference CaseWhen Cast Concat Cube CurrentRow Divide EqualNullSafe EqualTo Exists GreaterThan
    GreaterThanOrEqual GroupingSets If ILike In InSubquery IntegralDivide IsNotNull IsNull LessThan LessThanOrEqual
    Like LikeAll LikeAny ListQuery Literal Multiply MultiAlias NamedExpression Not Or RLike Remainder Rollup ScalarSubquery
    SortOrder SpecifiedWindowFrame Subtract UnaryMinus UnaryPositive UnboundedFollowing UnboundedPreceding
    UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator
    UnresolvedStar UnresolvedWindowExpression UnspecifiedFrame WindowExpression WindowSpecDefinition WindowSpecReference""".split()
)
FUNCTIONS = set(
    """abs any any_value approx_count_distinct array array_contains array_distinct array_max array_min
    array_sort avg between bool_and bool_or bround cardinality ceil ceiling char_length coalesce collect_list
    collect_set concat concat_ws contains corr count count_if cume_dist current_date date date_add date_diff
    date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank div element_at
    endswith every exp explode explode_outer first first_value floor get greatest grouping grouping_id hour if ifnull
    initcap instr isnan isnotnull isnull lag last last_day last_value lead least left length ln log
    log10 log2 lower lpad ltrim map_keys map_values max max_by mean median min min_by minute mod month months_between
    named_struct nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx pmod
    posexplode position pow power quarter rank regexp_extract regexp_like regexp_replace replace right round row_number
    rpad rtrim second sign signum size sort_array split split_part sqrt startswith std stddev stddev_pop
    stddev_samp string struct substr substring sum to_date to_timestamp translate trim trunc try_cast
    try_divide upper var_pop var_samp variance weekofyear year""".split()
)


def _fields(spark: SparkSession, plan) -> Iterator[tuple[str, object]]:
    """(class name, node) of every tree node reachable through the fields of a parsed plan."""
    kind = spark._jvm.java.lang.Class.forName
    node, product, many = (
        kind(c) for c in ("org.apache.spark.sql.catalyst.trees.TreeNode", "scala.Product", "scala.collection.Iterable")
    )
    left = [plan]
    while left:
        value = left.pop()
        if not hasattr(value, "getClass"):  # text, numbers and nulls
            continue
        if node.isInstance(value):
            yield value.getClass().getName().rsplit(".", 1)[-1].rstrip("$"), value
        if many.isInstance(value):
            inner = value.iterator()
        elif product.isInstance(value):
            inner = value.productIterator()
        else:
            continue
        while inner.hasNext():
            left.append(inner.next())


def _parts(seq) -> list[str]:
    return [seq.apply(i) for i in range(seq.length())]


def check(spark: SparkSession, text: str) -> None:
    """ValueError unless the text is one query over registered views and listed functions."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as error:
        raise ValueError("only SELECT queries are allowed") from error
    read, own = set(), set()
    for name, node in _fields(spark, plan):
        if name not in RELATIONS and name not in EXPRESSIONS:
            raise ValueError(f"only SELECT queries are allowed, not {name}")
        if name == "UnresolvedFunction":
            parts = _parts(node.nameParts())
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                raise ValueError(f"function {'.'.join(parts)} is not allowed")
        elif name == "UnresolvedGenerator":
            if node.name().unquotedString().lower() not in FUNCTIONS:
                raise ValueError(f"function {node.name().unquotedString()} is not allowed")
        elif name == "UnresolvedRelation":
            parts = _parts(node.multipartIdentifier())
            if len(parts) != 1:
                raise ValueError(f"{'.'.join(parts)} is not a registered table")
            read.add(parts[0].lower())
        elif name == "UnresolvedWith":
            named = node.cteRelations()
            own |= {named.apply(i).productElement(0).lower() for i in range(named.length())}
    stored = {t.name.lower(): t.isTemporary for t in spark.catalog.listTables()}
    for table in read:
        # a name given by WITH must not stand for a stored table elsewhere in the text
        if not stored.get(table, table in own):
            raise ValueError(f"{table} is not a registered table")
