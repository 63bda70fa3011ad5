"""SQL texts of users over given tables: queries only, nothing that writes, sets or runs anything."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: The operators of which a parsed query consists. Any other one (commands, inserts, scripts, calls) is refused,
#: so that new kinds of statements are refused until they stand here.
READS = frozenset(
    (
        "Aggregate Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator "
        "Pivot Project Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases "
        "UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith Unpivot WithWindowDefinition"
    ).split()
)
#: Functions that run other code than Spark's, and the clause that names any function by a computed text.
CALLS = ("java_method", "reflect", "try_reflect", "identifier")


class NotReadOnly(ValueError):
    """The text is no query that only reads."""


def _items(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _operators(plan) -> Iterator:
    """The operators of a parsed plan: those below it, in its subqueries and in its WITH list."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += _items(node.children())
        waiting += _items(node.subqueries())
        if node.getClass().getSimpleName() == "UnresolvedWith":
            waiting += [named._2() for named in _items(node.cteRelations())]


def _functions(plan) -> set[str]:
    """Names of the functions that the plan's own expressions call, in small letters."""
    found, waiting = set(), [*_items(plan.expressions())]
    while waiting:
        e = waiting.pop()
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            found.add(str(e.nameParts().last()).lower())
        elif kind == "ExpressionWithUnresolvedIdentifier":
            found.add("identifier")
        waiting += _items(e.children())
    return found


def check_reads(spark: SparkSession, text: str) -> None:
    """Raise NotReadOnly unless text is one query that only reads; nothing is run. Text that is no SQL raises Spark's error."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    for node in _operators(plan):
        kind = node.getClass().getSimpleName()
        if kind not in READS:
            raise NotReadOnly(f"not a query: {kind}")
        if called := _functions(node) & set(CALLS):
            raise NotReadOnly(f"not allowed: {min(called)}")


def query(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The result of a text over tables, which it knows by their names; only queries that read are run.

    The tables are views of this session while the text is resolved; a view of the same name is put back afterwards.
    """
    check_reads(spark, text)
    before = {}
    for name, df in tables.items():
        if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary:
            before[name] = spark.table(name)
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(text)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)
