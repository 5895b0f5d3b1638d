"""Array expressions for work that stays inside one row.

The helpers take and return SQL expression text. A long expression is parsed by
Spark in one step; built call by call from Python it takes seconds.
"""

from __future__ import annotations


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once.

    Inside a lambda Spark does not share common subexpressions, so a value used
    twice there would be computed twice.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def running(numbers: str, combine: str) -> str:
    """Inclusive prefixes of an int array, ``combine`` joining ``x`` and the part ``y`` to its left.

    Each round takes in the element ``2**k`` places to the left, so n numbers take
    log2(n) passes. A fold that appends to its own accumulator would copy the
    array at every step and need n**2 work for a text with n pieces.
    """
    taken = bind("get(sums, i - step)", "y", combine)
    add_left = f"transform(sums, (x, i) -> if(i >= step, {taken}, x))"
    return (
        f"aggregate(sequence(0, cast(ceil(log2(greatest(size({numbers}), 1))) as int)), {numbers}, "
        f"(sums, k) -> {bind('shiftleft(1, k)', 'step', add_left)})"
    )


def running_total(numbers: str) -> str:
    """Inclusive prefix sums of an int array."""
    return running(numbers, "x + y")
