"""SQL over named inputs."""

from __future__ import annotations

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..errors import TransformError
from . import dialect

COMMAND = "org.apache.spark.sql.catalyst.plans.logical.Command"
SUBQUERY = "org.apache.spark.sql.catalyst.expressions.PlanExpression"
EXPRESSION = "org.apache.spark.sql.catalyst.expressions.Expression"
# Nodes that change something, run other programs, or read what is no input.
REFUSED = ("Insert", "Merge", "Update", "Delete", "Overwrite", "ScriptTransformation", "PlanWithUnresolvedIdentifier", "UnresolvedExecuteImmediate", "ExecuteImmediate", "CompoundBody", "SingleStatement")
# Functions that call any method of the JVM, or read files by name.
CALLS = ("reflect", "java_method", "try_reflect", "read_files", "input_file_name")


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` and no views, on the same executors."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    for t in own.catalog.listTables():
        if t.isTemporary:
            own.catalog.dropTempView(t.name)
    return own


def _each(seq):
    return [seq.apply(k) for k in range(seq.size())]


def _refuse(spark: SparkSession, sql: str, inputs: set[str]) -> None:
    """TransformError if the parsed statement does anything but query ``inputs`` and what its own WITH clauses name, at any depth."""
    gateway = spark.sparkContext._gateway
    is_a = lambda x, kind: is_instance_of(gateway, x, kind)

    def expression(e, names: set[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction" and (called := _each(e.nameParts())[-1].lower()) in CALLS:
            raise TransformError(f"the function {called} isn't allowed")
        if kind in ("CallMethodViaReflection", "ExpressionWithUnresolvedIdentifier"):
            raise TransformError(f"{kind} isn't allowed")
        if is_a(e, SUBQUERY):
            node(e.plan(), names)
        for child in _each(e.children()):
            expression(child, names)

    def node(n, names: set[str]) -> None:
        kind = n.getClass().getSimpleName()
        if is_a(n, COMMAND) or kind.startswith(REFUSED):
            raise TransformError(f"only a query is allowed, not {kind}")
        if kind == "UnresolvedRelation":
            parts = _each(n.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in names:
                raise TransformError(f"{'.'.join(parts)} is no input")
        if kind == "UnresolvedTableValuedFunction" and _each(n.name())[-1].lower() in CALLS:
            raise TransformError("only a query is allowed")
        if kind == "UnresolvedWith":
            for relation in _each(n.cteRelations()):
                alias = relation._1().lower()
                node(relation._2(), names | ({alias} if n.allowRecursion() else set()))
                names = names | {alias}
        for e in _each(n.expressions()):
            expression(e, names)
        for child in _each(n.children()):
            node(child, names)

    node(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), {name.lower() for name in inputs})


def transform(inputs: dict[str, DataFrame], sql: str) -> DataFrame:
    """One query over ``inputs``, each a view of its name in a session of its own; double quotes enclose names.

    ``DISTINCT ON`` and ``* REPLACE`` are understood, and nulls sort as the largest values unless the query says otherwise (see ``dialect``).
    The caller's views, tables, files and settings are neither seen nor touched.  Anything but a query over the inputs raises TransformError:
    commands, writes, scripts, calls of JVM methods, and relations that neither ``inputs`` nor the statement's own WITH clauses name.
    """
    spark = next(iter(inputs.values())).sparkSession
    try:
        own = _own_session(spark)
        spark_sql = dialect.rewritten(sql or "")
        _refuse(own, spark_sql, set(inputs))
        for name, df in inputs.items():
            held = own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed())
            DataFrame(held, own).createOrReplaceTempView(name)
        df = own.sql(spark_sql)
        if (apart := dialect.counted_apart(spark_sql)) != spark_sql:
            df = own.sql(apart).toDF(*df.columns)  # by the names that the query gives
        if (plain := dialect.plain_columns(sql)) and set(columns := own.sql(plain).columns) == set(df.columns) and len(set(columns)) == len(columns):
            df = df.select(*[f"`{c}`" for c in columns])  # replaced columns stay in their places
        return df
    except (AnalysisException, ParseException, ValueError) as e:
        raise TransformError(str(e)) from e
