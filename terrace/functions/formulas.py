"""Formulas of pixel values as columns: ``+ - * / % ^``, ``~`` and ``-`` for the negative, functions, named constants.

Python reads the text (``ast``), so precedence is Python's, with ``^`` for powers.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSTANTS = {"pi": math.pi, "Pi": math.pi, "e": math.e, "E": math.e}
_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Mod: lambda a, b: F.when(b != 0, a % F.nullif(b, F.lit(0.0))),
    ast.Pow: lambda a, b: F.pow(a, b),
}
FUNCTIONS = {
    "pow": F.pow,
    "min": F.least,
    "max": F.greatest,
    "mod": _BINARY[ast.Mod],
    "hypot": F.hypot,
    "atan2": F.atan2,
    "abs": F.abs,
    "floor": lambda a: F.floor(a).cast("double"),
    "ceil": lambda a: F.ceil(a).cast("double"),
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "exp": F.exp,
    "ln": F.log,
    "log": F.log,
    "pow10": lambda a: F.pow(F.lit(10.0), a),
    "log10": F.log10,
    "cosh": F.cosh,
    "sinh": F.sinh,
    "tanh": F.tanh,
    "acosh": F.acosh,
    "asinh": F.asinh,
    "atanh": F.atanh,
}


def column(formula: str, values: Mapping[str, Column]) -> Column:
    """The formula over named columns; unknown names, functions and numbers of arguments raise ``ValueError``."""

    def of(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=int() | float() as number):
                return F.lit(float(number))
            case ast.Name(id=name) if name in values:
                return values[name]
            case ast.Name(id=name) if name in CONSTANTS:
                return F.lit(CONSTANTS[name])
            case ast.UnaryOp(op=ast.USub() | ast.Invert(), operand=operand):
                return -of(operand)
            case ast.UnaryOp(op=ast.UAdd(), operand=operand):
                return of(operand)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
                return _BINARY[type(op)](of(left), of(right))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
                try:
                    return FUNCTIONS[name](*map(of, args))
                except TypeError as error:
                    raise ValueError(f"{name} does not take {len(args)} arguments") from error
        raise ValueError(f"cannot read {ast.unparse(node)!r} in {formula!r}")

    try:
        tree = ast.parse(formula.strip().replace("^", "**"), mode="eval")
    except SyntaxError as error:
        raise ValueError(f"cannot read {formula!r}") from error
    return of(tree.body)
