"""The scalar rules as temporary SQL functions, written from their column expressions.

``register(spark)`` makes them callable in ``spark.sql``. A SQL function's body is inlined by the
optimizer, so a call is the same plan as the column expression, with no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from adledger.functions import extract, text

INFIX = {"+", "-", "*", "/", "%", "=", "<=>", "<", "<=", ">", ">=", "and", "or"}
POSTFIX = {"isNull": "IS NULL", "isNotNull": "IS NOT NULL"}
PREFIX = {"!": "NOT", "not": "NOT", "negative": "-"}

# name -> (parameters, result, the column expression over them)
RULES = {
    "norm_text": ({"x": "STRING"}, "STRING", text.norm_text),
    "district": ({"postcode": "STRING", "area": "STRING"}, "STRING", extract.district),
    "monthly_price": ({"x": "STRING"}, "INT", extract.monthly_price),
    "availability": ({"x": "STRING", "as_of": "DATE"}, "DATE", extract.availability),
    "addr_key": ({"postcode": "STRING", "area": "STRING"}, "STRING", extract.addr_key),
}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _text(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind in ("Literal", "UnresolvedNamedLambdaVariable", "UnresolvedAttribute"):
        return node.sql()
    if kind == "Cast":
        call = "TRY_CAST" if "Try" in str(node.evalMode()) else "CAST"
        return f"{call}({_text(node.child())} AS {node.dataType().sql()})"
    if kind == "CaseWhenOtherwise":
        arms = "".join(f" WHEN {_text(b._1())} THEN {_text(b._2())}" for b in _items(node.branches()))
        rest = f" ELSE {_text(node.otherwise().get())}" if node.otherwise().isDefined() else ""
        return f"CASE{arms}{rest} END"
    if kind == "LambdaFunction":
        names = ", ".join(map(_text, _items(node.arguments())))
        return f"{f'({names})' if ',' in names else names} -> {_text(node.function())}"
    if kind == "UnresolvedFunction":
        name, args = node.functionName(), [_text(a) for a in _items(node.arguments())]
        if name in INFIX and len(args) == 2:
            return f"({args[0]} {name} {args[1]})"
        if name in POSTFIX:
            return f"({args[0]} {POSTFIX[name]})"
        if name in PREFIX and len(args) == 1:
            return f"({PREFIX[name]} {args[0]})"
        return f"`{name}`({', '.join(args)})"
    raise NotImplementedError(f"a {kind} has no SQL text here")


def expression_text(column: Column) -> str:
    """SQL text of a column expression, which parses back to the same expression."""
    return _text(column._jc.node())


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session; returns their names."""
    for name, (params, result, rule) in RULES.items():
        body = expression_text(rule(*map(F.col, params)))
        told = ", ".join(f"{p} {t}" for p, t in params.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({told}) RETURNS {result} RETURN ({body})")
    return list(RULES)
