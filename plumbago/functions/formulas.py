"""Formulas: an expression grammar, checked by one fold over a text's tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbago.functions import quality as Q
from plumbago.functions import text as T

TOKEN = r"[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[A-Za-z][A-Za-z0-9]*|\*\*|//|[^\s]"

#: Words that a formula can't have as names.
KEYWORDS = tuple(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)


def kinds(text: Column) -> Column:
    """The tokens of a text as kinds: n a number or name, s a sign that may stand before one, o another operator, brackets
    as they are, x what no formula holds: keywords, equals signs, single full stops, whole numbers with leading zeros."""

    def kind(t: Column) -> Column:
        return (
            F.when(t.isin(*KEYWORDS) | t.rlike("^0+[1-9][0-9]*$"), "x").when(t.rlike(r"^\.?[0-9A-Za-z]"), "n").when(t.isin("+", "-"), "s").when(t.isin("*", "/", "%", "^", "**", "//"), "o").when(t.isin("(", ")"), t).otherwise("x")
        )

    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), kind)


def is_expression(text: Column) -> Column:
    """Operands with operators between them, in balanced brackets; an operand right after another is a product.

    One fold in linear time: how many brackets are open, whether an operand has to come, whether all went well. Empty
    brackets, like empty and null texts, are no expression.
    """
    start = F.struct(F.lit(0).alias("open"), F.lit(True).alias("wants"), F.lit(True).alias("well"))

    def step(s: Column, k: Column) -> Column:
        wrong = (k == "x") | (s["wants"] & k.isin("o", ")")) | ((k == ")") & (s["open"] == 0))
        depth = s["open"] + F.when(k == "(", 1).when(k == ")", -1).otherwise(0)
        return F.struct(depth.alias("open"), k.isin("s", "o", "(").alias("wants"), (s["well"] & ~wrong).alias("well"))

    return F.aggregate(kinds(text), start, step, lambda s: s["well"] & ~s["wants"] & (s["open"] == 0))


def is_formula(text: Column) -> Column:
    """An expression of three characters or more in the characters of formulas; one with three letters in a row has to
    hold an operator too, so plain words are none. Only texts in these characters are folded."""
    t = T.stripped(text)
    plain_words = t.rlike("[a-zA-Z]{3,}") & ~t.rlike(r"[+\-=*/^]")
    return F.when(Q.is_formula_like(text) & (F.length(t) >= 3) & ~plain_words, is_expression(t)).otherwise(False)
