"""Pieces of SQL text for array expressions.

Nested array lambdas are written as SQL text: one text is parsed in one step, where the same
expression built column by column takes thousands of calls into the JVM.
"""

from __future__ import annotations


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once per row.

    A plain column may be inlined by the optimizer and then be evaluated once per use, or
    once per array element inside a lambda.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def upto(first: str | int, last: str) -> str:
    """``first..last`` ascending, empty if ``last`` is smaller than ``first``."""
    return f"if({last} >= {first}, sequence({first}, {last}), cast(array() as array<int>))"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_list(values) -> str:
    return ", ".join(text_literal(v) for v in values)
