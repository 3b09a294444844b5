"""Which input columns an output column is made of, from Spark's analysed plan."""

from __future__ import annotations

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame

ATTRIBUTE = "org.apache.spark.sql.catalyst.expressions.AttributeReference"
ALIAS = "org.apache.spark.sql.catalyst.expressions.Alias"
SUBQUERY = "org.apache.spark.sql.catalyst.expressions.PlanExpression"
# Nodes whose output columns have no single origin.
MERGED = ("Union", "Intersect", "Except")

#: Names of input columns; None where the origin isn't known.
Origin = frozenset | None


def _each(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _all(origins) -> Origin:
    out: frozenset = frozenset()
    for x in origins:
        if x is None:
            return None
        out |= x
    return out


class _Walk:
    """Origins by expression id.  A node's children come first, so what it refers to is known."""

    def __init__(self, gateway):
        self.gateway, self.made, self.ctes = gateway, {}, {}

    def is_a(self, x, kind: str) -> bool:
        return is_instance_of(self.gateway, x, kind)

    def of(self, e) -> Origin:
        """Origins of what an expression is computed from; of a subquery, of the columns that it returns."""
        if self.is_a(e, ATTRIBUTE):
            return self.made.get(e.exprId().id())
        if self.is_a(e, SUBQUERY):
            self.plan(e.plan())
            return _all(self.made.get(a.exprId().id()) for a in _each(e.plan().output()))
        if e.getClass().getSimpleName() == "OuterReference":
            return self.of(e.e())
        return _all(self.of(c) for c in _each(e.children()))

    def aliases(self, e) -> None:
        if self.is_a(e, ALIAS):
            self.made[e.exprId().id()] = self.of(e.child())
        for c in _each(e.children()):
            self.aliases(c)

    def plan(self, node) -> None:
        kind, children = node.getClass().getSimpleName(), _each(node.children())
        for c in children:
            self.plan(c)
        if kind == "LateralJoin":
            self.plan(node.right().plan())
        made, output = self.made, _each(node.output())
        if kind == "CTERelationDef":
            self.ctes[node.id()] = [made.get(a.exprId().id()) for a in output]
        elif kind == "CTERelationRef":
            made.update({a.exprId().id(): o for a, o in zip(output, self.ctes.get(node.cteId()) or [None] * len(output), strict=True)})
        elif kind in MERGED:
            made.update({a.exprId().id(): None for a in output})
        elif not children:
            made.update({a.exprId().id(): frozenset([a.name()]) for a in output})
        elif kind == "Generate":
            origin = self.of(node.generator())
            made.update({a.exprId().id(): origin for a in _each(node.generatorOutput())})
        elif kind == "Expand":
            rows = [[self.of(e) for e in _each(p)] for p in _each(node.projections())]
            made.update({a.exprId().id(): _all(column) for a, column in zip(output, zip(*rows, strict=True), strict=True)})
        else:
            for e in _each(node.expressions()):
                self.aliases(e)
            # What the node makes in another way, a function over rows for one, has no origin here.
            for a in output:
                made.setdefault(a.exprId().id(), None)


def column_lineage(df: DataFrame) -> dict[str, list[str] | None]:
    """For each output column the input columns that it is computed from, sorted: none for constants and counts of rows.

    None where that isn't known: behind unions, which have no single origin, and behind functions over whole rows.  Generated rows come from
    the generator's arguments, keys of grouping sets from the columns grouped by, a subquery's value from the columns it returns.
    """
    walk = _Walk(df.sparkSession.sparkContext._gateway)
    plan = df._jdf.queryExecution().analyzed()
    walk.plan(plan)
    found = {a.name(): walk.made.get(a.exprId().id()) for a in _each(plan.output())}
    return {name: None if origin is None else sorted(origin) for name, origin in found.items()}
