"""What a query text reads and calls, as Spark's own parser understands it.

The text is parsed, not run; the unresolved plan is walked with the names of the common table expressions that are in scope at
each place, so quotes, brackets, comments, ``TABLE name`` and nested queries need no rules of their own.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Steps that a query may have. Commands, file readers, names worked out at run time and all else are refused.
STEPS = frozenset("""Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Limit Offset Union Except Intersect Distinct
    Join LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedRelation UnresolvedInlineTable LocalRelation
    OneRowRelation WithWindowDefinition Window Pivot UnresolvedPivot Unpivot Generate Sample UnresolvedHint Expand
    UnresolvedTableValuedFunction UnresolvedTVFAliases""".split())
TABLE_FUNCTIONS = frozenset("""range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple
    variant_explode variant_explode_outer""".split())
#: Built-in functions that run code of the JVM or tell of files.
NEVER_CALLED = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length".split())


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Walk:
    def __init__(self, spark: SparkSession, frames: set[str]):
        self.jvm = spark._jvm
        self.state = spark._jsparkSession.sessionState()
        self.frames = frames
        loaded = self.jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass
        self.holds_plan = loaded("org.apache.spark.sql.catalyst.expressions.PlanExpression")
        self.builtin = self.jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self.identifier = self.jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self.issues: list[str] = []

    def plan(self, node, scope: frozenset[str]) -> None:
        kind = node.nodeName().lstrip("'")
        if kind not in STEPS:
            self.issues.append(f"Step not allowed: {kind}")
            return
        if kind == "UnresolvedWith":
            for entry in _items(node.cteRelations()):
                name = entry._1().lower()
                self.plan(entry._2(), scope | {name} if node.allowRecursion() else scope)
                scope |= {name}
        elif kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) > 1 or parts[0].lower() not in scope | self.frames:
                self.issues.append(f"Unknown table: {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            name = ".".join(_items(node.name()))
            if name.lower() not in TABLE_FUNCTIONS:
                self.issues.append(f"Function not allowed: {name}")
        elif kind == "WithWindowDefinition":
            for window in _items(node.windowDefinitions().values().toSeq()):
                self.expression(window, scope)
        for e in _items(node.expressions()):
            self.expression(e, scope)
        for child in _items(node.children()):
            self.plan(child, scope)

    def expression(self, node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self.function(_items(node.nameParts()))
        elif kind == "UnresolvedGenerator":
            self.function([node.name().funcName()])
        elif kind == "ExpressionWithUnresolvedIdentifier":
            self.issues.append("Name worked out at run time")
        if self.holds_plan.isInstance(node):
            self.plan(node.plan(), scope)
        for child in _items(node.children()):
            self.expression(child, scope)

    def function(self, parts: list[str]) -> None:
        name = parts[-1].lower()
        if len(parts) > 1 or name in NEVER_CALLED or not self.builtin.functionExists(self.identifier(name)):
            self.issues.append(f"Function not allowed: {'.'.join(parts)}")


def placeholders(text: str, tables: dict[str, DataFrame]) -> tuple[str, set[str]]:
    """``text`` with a fresh name for every frame in braces, and those names."""
    names = {k: f"frame_{uuid.uuid4().hex}" for k in tables}
    out = []
    for literal, field, spec, conversion in string.Formatter().parse(text):
        out.append(literal)
        if field is not None:
            if field not in names or spec or conversion:
                raise ValueError(f"Unknown table: {field}")
            out.append(names[field])
    return "".join(out), set(names.values())


def foreign(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> list[str]:
    """What ``text`` does beyond reading ``tables`` (named in braces) and calling built-in functions; empty if nothing.

    A text that Spark cannot parse raises its ``ParseException``.
    """
    named, frames = placeholders(text, tables) if tables else (text, set())
    walk = _Walk(spark, frames)
    walk.plan(walk.state.sqlParser().parsePlan(named), frozenset())
    return list(dict.fromkeys(walk.issues))
