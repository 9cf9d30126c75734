"""Predicate trees compiled to columns.

A node is {"all": [...]}, {"any": [...]}, {"not": node} or a leaf {"feature", "op", "value"}; an empty node is
true. A leaf with a null operand is false, so its negation is true. A value that names a column is that column;
"true", "false" and numeric strings are read as such.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of features: fixed values.
ALIASES = {"volume": "bar_volume", "volume_1m": "bar_volume", "relative_volume_5m": "relative_volume_5", "volume_spike_ratio": "relative_volume_20", "candle_body_pct": "bar_body_ratio", "realized_vol_20": "realized_volatility_20"}
OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


def _operand(value, columns: list[str]) -> Column:
    if isinstance(value, str):
        if value in columns:
            return F.col(value)
        if value.lower() in ("true", "false"):
            return F.lit(float(value.lower() == "true"))
        return F.lit(float(value))
    return F.lit(float(value))


def leaf(node: dict, columns: list[str], aliases: dict[str, str] | None = None) -> Column:
    name = node["feature"] if node["feature"] in columns else (ALIASES if aliases is None else aliases).get(node["feature"], node["feature"])
    if node["op"] not in OPS:
        raise ValueError(f"unknown operator {node['op']}")
    if name not in columns:
        return F.lit(False)
    return F.coalesce(OPS[node["op"]](F.col(name).cast("double"), _operand(node["value"], columns)), F.lit(False))


def compile_node(node: dict | None, columns: list[str], aliases: dict[str, str] | None = None) -> Column:
    """The column that holds whether a row satisfies the tree."""
    if not node:
        return F.lit(True)
    out = F.lit(True)
    known = False
    for x in node.get("all", []):
        out, known = out & compile_node(x, columns, aliases), True
    if "any" in node:
        some = F.lit(False)
        for x in node["any"]:
            some = some | compile_node(x, columns, aliases)
        out, known = out & some, True
    if "not" in node:
        out, known = out & ~compile_node(node["not"], columns, aliases), True
    if "feature" in node:
        out, known = out & leaf(node, columns, aliases), True
    if not known:
        raise ValueError(f"not a predicate node: {sorted(node)}")
    return out


#: Operators that a specification may name; crossings are checked here and compiled by operators.research.crosses.
SPEC_OPS = {">", ">=", "<", "<=", "==", "crosses_above", "crosses_below"}
#: Text that looks like code, and names that look ahead, in a specification.
CODE, AHEAD = r"(?i)(import\s|lambda\b|__|eval\(|exec\(|;|=>|\bdef\b)", r"(?i)(future|lookahead|next_|_next|forward)"


def spec_errors(spec: dict, families: set[str], banned: set[str], most: int = 500) -> list[str]:
    """What is wrong with a strategy specification: keys, family, predicate nodes, code-like text, names that look ahead, the size of its grid."""
    import math
    import re

    out = [f"missing {k}" for k in ("name", "family", "symbol", "timeframe", "entry", "exit") if k not in spec]
    if spec.get("family") in banned:
        out.append(f"banned family {spec['family']}")
    elif "family" in spec and spec["family"] not in families:
        out.append(f"unknown family {spec['family']}")

    def walk(node, at):
        if not isinstance(node, dict):
            return out.append(f"{at}: not a node")
        if "feature" in node:
            if node.get("op") not in SPEC_OPS:
                out.append(f"{at}: operator {node.get('op')}")
            if "value" not in node:
                out.append(f"{at}: no value")
            if re.search(AHEAD, str(node["feature"])):
                out.append(f"{at}: {node['feature']} looks ahead")
        for k in ("all", "any"):
            for i, x in enumerate(node.get(k, [])):
                walk(x, f"{at}.{k}[{i}]")
        if "not" in node:
            walk(node["not"], f"{at}.not")
        if unknown := set(node) - {"feature", "op", "value", "all", "any", "not"}:
            out.append(f"{at}: unknown {sorted(unknown)}")

    def texts(x, at):
        if isinstance(x, str) and re.search(CODE, x):
            out.append(f"{at}: looks like code")
        for k, v in (x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()):
            texts(v, f"{at}.{k}")

    if "entry" in spec:
        walk(spec["entry"], "entry")
    texts(spec, "spec")
    grid = spec.get("parameters", {})
    if any(not isinstance(v, list) or not v for v in grid.values()):
        out.append("parameters must be lists with values")
    elif math.prod(len(v) for v in grid.values()) > most:
        out.append(f"more than {most} combinations")
    return out


def leaves(node: dict | None) -> list[dict]:
    """All leaves of a tree, in order."""
    if not node:
        return []
    out = [node] if "feature" in node else []
    for x in [*node.get("all", []), *node.get("any", []), *([node["not"]] if "not" in node else [])]:
        out += leaves(x)
    return out


def in_sessions(ts: str, ranges: str, zone: str = "America/New_York") -> Column:
    """Whether the local time of a UTC timestamp lies in one of the ranges "HH:MM-HH:MM,..." (ends included)."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts))
    minute = F.hour(local) * 60 + F.minute(local)
    out = F.lit(False)
    for part in ranges.split(","):
        a, b = (int(x[:2]) * 60 + int(x[3:]) for x in part.strip().split("-"))
        out = out | minute.between(a, b)
    return out
