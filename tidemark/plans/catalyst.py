"""Catalyst's analyzed plans, read and rebuilt from Python. Classic sessions only; nothing else touches the JVM's plans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession

from .classify import Node


def items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def analyzed(df: DataFrame):
    return df._jdf.queryExecution().analyzed()


def frame(spark: SparkSession, plan) -> DataFrame:
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    return Classic(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def column(spark: SparkSession, expression) -> Column:
    from pyspark.sql.classic.column import Column as Classic

    return Classic(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def kind(node) -> str:
    return node.getClass().getSimpleName()


def seq(spark: SparkSession, values: list):
    return spark._jvm.PythonUtils.toSeq(values)


def with_children(spark: SparkSession, node, children: list):
    return node.withNewChildren(seq(spark, children).toIndexedSeq())


def expr_id(attribute) -> int:
    return attribute.exprId().id()


def to_node(expression, names: dict[int, str], shared: dict[int, Node] | None = None) -> Node:
    """An expression for the classifier; ``names`` gives table.column for attributes. Common expressions are put in place."""
    name, shared = kind(expression), shared or {}
    if name == "AttributeReference":
        return Node(name, column=names.get(expr_id(expression), ""), sql=expression.sql())
    if name == "CommonExpressionRef":
        return shared.get(expression.id().id(), Node("Unknown", deterministic=False))
    children = items(expression.children())
    if name == "With":
        shared = dict(shared)
        for d in children:
            if kind(d) == "CommonExpressionDef":
                shared[d.id().id()] = to_node(d.child(), names, shared)
        return to_node(children[0], names, shared)
    if name == "Between":
        return to_node(children[0], names, shared)
    return Node(name, tuple(to_node(c, names, shared) for c in children), deterministic=expression.deterministic(), sql=expression.sql(), expression=expression)


def conjuncts(condition) -> list:
    """The conditions that AND joins."""
    if kind(condition) == "And":
        return [x for c in items(condition.children()) for x in conjuncts(c)]
    return [condition]


def substituted(spark: SparkSession, expression, attribute, other):
    """``expression`` with ``other`` in place of an attribute."""
    if kind(expression) == "AttributeReference":
        return other if expr_id(expression) == expr_id(attribute) else expression
    children = items(expression.children())
    return with_children(spark, expression, [substituted(spark, c, attribute, other) for c in children]) if children else expression


def filtered(spark: SparkSession, conditions: list, plan):
    """``plan`` under a filter of all ``conditions``."""
    jvm = spark._jvm.org.apache.spark.sql.catalyst
    if not conditions:
        return plan
    whole = conditions[0]
    for c in conditions[1:]:
        whole = jvm.expressions.And(whole, c)
    return jvm.plans.logical.Filter(whole, plan)


def leaves(plan) -> Iterator:
    children = items(plan.children())
    if not children:
        yield plan
    for c in children:
        yield from leaves(c)


def snapshot(plan, most_files: int = 10_000) -> str | None:
    """Names what a plan reads: the plan, and each file with its length and time of change. None where that cannot be told, or of too many files."""
    out = [plan.canonicalized().toString(), str(plan.semanticHash())]
    for leaf in leaves(plan):
        if kind(leaf) == "LocalRelation":
            continue  # its data are in the plan's hash
        if kind(leaf) != "LogicalRelation" or kind(leaf.relation()) != "HadoopFsRelation" or kind(leaf.relation().location()) != "InMemoryFileIndex":
            return None
        files = leaf.relation().location().allFiles()
        if files.size() > most_files:
            return None
        out.append(files.mkString("\n"))
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def walk(expression) -> Iterator:
    yield expression
    for c in items(expression.children()):
        yield from walk(c)


def alias(spark: SparkSession, expression, attribute):
    """``expression`` under the identity of ``attribute``, so that plans above still find it."""
    jvm = spark._jvm
    nothing = jvm.scala.Option.empty()
    return jvm.org.apache.spark.sql.catalyst.expressions.Alias(expression, attribute.name(), attribute.exprId(), attribute.qualifier(), nothing, seq(spark, []).toList())


def project(spark: SparkSession, expressions: list, plan):
    return spark._jvm.org.apache.spark.sql.catalyst.plans.logical.Project(seq(spark, expressions).toList(), plan)
