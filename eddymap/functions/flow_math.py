"""Map-equation formulas as SQL expressions, and scalar forms for sums taken on the driver.

Each function takes and returns SQL text, for ``F.expr`` or ``selectExpr``; Spark compiles it into
the stage like any built-in expression.
"""

from __future__ import annotations

import math


def number(value: float) -> str:
    """A double literal."""
    return f"({float(value)!r}D)"


def log2(x: str) -> str:
    """Base-2 logarithm, 0 where it is undefined."""
    return f"(CASE WHEN ({x}) > 0 THEN log2({x}) ELSE 0D END)"


def plogp(x: str) -> str:
    """``x * log2(x)`` with its limit 0 at ``x <= 0``; Spark's own log2 gives NULL there."""
    return f"(CASE WHEN ({x}) > 0 THEN ({x}) * log2({x}) ELSE 0D END)"


def plogp_value(x: float) -> float:
    return x * math.log2(x) if x > 0 else 0.0


def exit_flow(n_nodes: int, tele: float, n: str, p: str, w: str) -> str:
    """Rate ``q`` at which a walker leaves a module of ``n`` nodes, frequency ``p``, link flow ``w``."""
    stays = f"{number(1.0 - tele)} * ({w})"
    if n_nodes <= 1:
        return f"({stays})"
    return f"({number(tele)} * ({n_nodes}L - ({n})) / {number(n_nodes - 1)} * ({p}) + {stays})"


def codelength_value(n_modules: int, q_sum: float, module_terms: float, prob_sum: float) -> float:
    """Code length from the module sums; one module alone needs only the node code book."""
    if n_modules == 1:
        return -prob_sum
    return plogp_value(q_sum) + module_terms - prob_sum


def module_term(p: str, q: str) -> str:
    """What one module adds to the code length."""
    return f"({plogp(f'{p} + {q}')} - 2 * {plogp(q)})"


def merge_delta(
    q_sum: float, codelength: float, prob_sum: float,
    p1: str, p2: str, q1: str, q2: str, q12: str,
) -> str:
    """Change of code length if two modules become one with exit rate ``q12``.

    If nothing leaves any module afterwards, everything has become one module.
    """
    rest = f"{number(q_sum)} + {q12} - {q1} - {q2}"
    change = (
        f"{plogp(rest)} - {number(plogp_value(q_sum))}"
        f" - 2 * {plogp(q12)} + 2 * {plogp(q1)} + 2 * {plogp(q2)}"
        f" + {plogp(f'{p1} + {p2} + {q12}')} - {plogp(f'{p1} + {q1}')} - {plogp(f'{p2} + {q2}')}"
    )
    return (
        f"(CASE WHEN {q12} > 0 AND {rest} > 0 THEN {change}"
        f" ELSE {number(-prob_sum - codelength)} END)"
    )
