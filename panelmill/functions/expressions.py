"""A small factor language: text -> checked tree -> Spark column. Nothing is evaluated by Python.

Grammar: a feature name, or op(arg, ...). Results are clipped to +-20 and null becomes 0.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = str | tuple

#: Operators with their number of arguments, and the limits of a tree.
OPERATORS = {"neg": 1, "abs": 1, "signed_sqrt": 1, "add": 2, "sub": 2, "mul": 2, "div": 2, "min": 2, "max": 2}
MOST_DEPTH, MOST_NODES, LIMIT, LEAST_DIVISOR = 5, 15, 20.0, 0.25


def parse(text: str) -> Tree:
    """The tree of an expression; ValueError for anything but names and known calls."""

    def walk(node: ast.AST) -> Tree:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            return (node.func.id, *map(walk, node.args))
        raise ValueError(f"not a factor expression: {text}")

    try:
        return walk(ast.parse(text.strip(), mode="eval").body)
    except SyntaxError as wrong:
        raise ValueError(f"not a factor expression: {text}") from wrong


def nodes(tree: Tree) -> int:
    return 1 if isinstance(tree, str) else 1 + sum(map(nodes, tree[1:]))


def depth(tree: Tree) -> int:
    return 1 if isinstance(tree, str) else 1 + max(map(depth, tree[1:]), default=0)


def names(tree: Tree) -> set[str]:
    return {tree} if isinstance(tree, str) else set().union(*map(names, tree[1:]))


def text(tree: Tree) -> str:
    return tree if isinstance(tree, str) else f"{tree[0]}({', '.join(map(text, tree[1:]))})"


def problems(tree: Tree, features: set[str]) -> list[str]:
    """What is wrong with a tree; empty if it may be used."""
    out = [f"unknown feature {n}" for n in sorted(names(tree) - features)]

    def walk(t: Tree) -> None:
        if not isinstance(t, str):
            if OPERATORS.get(t[0]) != len(t) - 1:
                out.append(f"bad call {t[0]}/{len(t) - 1}")
            for a in t[1:]:
                walk(a)

    walk(tree)
    if depth(tree) > MOST_DEPTH:
        out.append("too deep")
    if nodes(tree) > MOST_NODES:
        out.append("too long")
    return out


def column(tree: Tree, leaf=F.col) -> Column:
    """The Spark column of a tree; leaf gives the column of a feature."""
    if isinstance(tree, str):
        return leaf(tree)
    op, *args = tree[0], *[column(a, leaf) for a in tree[1:]]
    a, b = args[0], args[-1]
    safe = F.when(F.abs(b) < LEAST_DIVISOR, F.when(b < 0, -LEAST_DIVISOR).otherwise(LEAST_DIVISOR)).otherwise(b)
    made = {
        "neg": lambda: -a,
        "abs": lambda: F.abs(a),
        "signed_sqrt": lambda: F.signum(a) * F.sqrt(F.abs(a)),
        "add": lambda: a + b,
        "sub": lambda: a - b,
        "mul": lambda: a * b,
        "div": lambda: a / safe,
        "min": lambda: F.least(a, b),
        "max": lambda: F.greatest(a, b),
    }[op]()
    return F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.coalesce(F.nanvl(made, F.lit(0.0)), F.lit(0.0))))
