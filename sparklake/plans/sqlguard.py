"""Read-only SQL: what a text may do is read off its parsed plan, before anything runs."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..errors import UnsafeSqlError

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]{0,62}$")
# How a statement may begin, the commands that only look, and what runs code of others.
FIRST = ("SELECT", "WITH", "DESCRIBE", "DESC", "EXPLAIN", "FROM", "VALUES", "TABLE", "(")
LOOKING = frozenset({"DescribeRelation", "DescribeQueryCommand", "DescribeColumn", "DescribeTableCommand"})
FOREIGN = frozenset({"reflect", "java_method", "try_reflect"})
SCRIPTS = frozenset({"ScriptTransformation"})
_LITERAL = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", re.S)


def identifier(name: str) -> str:
    if not IDENTIFIER.match(name):
        raise UnsafeSqlError(f"{name!r} is not an identifier", name=name)
    return name


def named(query: str) -> str:
    """$name as :name outside literals, quoted names and comments."""
    parts = _LITERAL.split(query)
    parts[::2] = [re.sub(r"\$([A-Za-z_]\w*)(?:::(\w+))?", lambda m: f"CAST(:{m[1]} AS {m[2]})" if m[2] else f":{m[1]}", p) for p in parts[::2]]
    return "".join(parts)


def _seq(jvm_seq) -> list:
    return [jvm_seq.apply(i) for i in range(jvm_seq.size())]


def check(spark: SparkSession, query: str) -> None:
    """UnsafeSqlError unless the text is one query, or describes or explains one.

    Every node is looked at, also those of CTEs and of subqueries in expressions, so a write inside a WITH is found.
    """
    bare = _LITERAL.sub(lambda m: " " if m[0].startswith(("--", "/*")) else m[0], query).strip()
    first = re.match(r"\(|\w+", bare)
    if not first or first[0].upper() not in FIRST:
        raise UnsafeSqlError("only queries are allowed", query=query)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        if "ParseException" in type(e).__name__ or "PARSE" in str(e):
            raise UnsafeSqlError(f"the text is not one statement of SQL: {str(e).splitlines()[0][:200]}", query=query) from e
        raise
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    statement = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    subquery = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    nodes, expressions = [(plan, True)], []
    while nodes:
        node, top = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ExplainCommand" and top:
            nodes.append((node.logicalPlan(), False))
            continue
        looking = kind in LOOKING and top
        if kind in SCRIPTS or (command.isInstance(node) or statement.isInstance(node)) and not looking:
            raise UnsafeSqlError(f"{kind} is not allowed", node=kind)
        if looking:
            continue
        nodes += [(c, False) for c in _seq(node.children())]
        nodes += [(c, False) for c in _seq(node.innerChildren()) if hasattr(c, "children") and "logical" in c.getClass().getName()]
        expressions += _seq(node.expressions())
        while expressions:
            e = expressions.pop()
            if e.getClass().getSimpleName() == "UnresolvedFunction":
                name = _seq(e.nameParts())[-1].lower()
                if name in FOREIGN:
                    raise UnsafeSqlError(f"the function {name} is not allowed", function=name)
            if subquery.isInstance(e):
                nodes.append((e.plan(), False))
            expressions += _seq(e.children())
