"""Variants of a strategy specification: parameter grids, budgets, seeded combinations. All small, so they are made on the driver and become a table."""

from __future__ import annotations

import copy
import hashlib
import itertools
import json
import math
import random

from pyspark.sql import DataFrame, SparkSession


def stable_json(x) -> str:
    """JSON in one form: sorted keys, no spaces."""
    return json.dumps(x, sort_keys=True, separators=(",", ":"), default=str)


def stable_hash(x) -> str:
    return hashlib.sha256(stable_json(x).encode()).hexdigest()


def set_nested(target: dict, path: tuple, value) -> None:
    """Sets a value under nested keys, which are made where they are missing."""
    for k in path[:-1]:
        target = target.setdefault(k, {})
    target[path[-1]] = value


def get_nested(source: dict, path: tuple, other=None):
    for k in path:
        if not isinstance(source, dict) or k not in source:
            return other
        source = source[k]
    return source


def values(p: dict) -> list:
    """Listed values, or those from min to max (included) by step."""
    if "values" in p:
        return list(p["values"])
    out, k = [], 0
    while (v := p["min"] + k * p["step"]) <= p["max"] + 1e-12:
        out.append(int(v) if float(v).is_integer() else round(v, 10))
        k += 1
    return out


class BudgetError(ValueError):
    """A grid is larger than may be tried without leave."""


def variants(spec: dict, targets: dict[str, tuple], most: int = 500, budget: int = 500, limit: int = 5000, allow: bool = False) -> tuple[list[dict], dict]:
    """Specifications for the combinations of spec["parameters"], each set under its target path, and what is known of the grid.

    The first `most` combinations in order of names are made; those that give equal specifications count once.
    A grid beyond `limit` needs leave.
    """
    grid = {n: values(p) for n, p in sorted(spec.get("parameters", {}).items()) if n in targets}
    total = math.prod(map(len, grid.values()))
    if total > limit and not allow:
        raise BudgetError(f"{total} combinations, more than {limit}")
    out, seen, made = [], set(), 0
    for combination in itertools.islice(itertools.product(*grid.values()), most):
        made += 1
        raw = copy.deepcopy(spec)
        for n, v in zip(grid, combination):
            set_nested(raw, targets[n], v)
        raw["variant_parameters"] = dict(zip(grid, combination))
        digest = stable_hash({k: v for k, v in raw.items() if k not in ("name", "variant_parameters")})
        if digest not in seen:
            seen.add(digest)
            raw["name"] = f"{spec.get('name', 'spec')}_trial_{len(out):04d}"
            out.append(raw)
    return out, {"total": total, "unique": len(out), "duplicates": made - len(out), "budget_exceeded": total > budget, "hash": stable_hash(grid)}


def seeded_specs(features: list[str], quantiles: dict[str, tuple[float, float]], count: int, size: int, seed: int) -> list[dict]:
    """Specifications of `size` features each, drawn by a seed, with a threshold at one of a feature's two levels; equal draws come once."""
    r, out, seen = random.Random(seed), [], set()
    for _ in range(count * 20):
        leaves = [{"feature": f, "op": r.choice([">=", "<="]), "value": r.choice(quantiles[f])} for f in sorted(r.sample(features, size))]
        digest = stable_hash(leaves)
        if digest not in seen and len(out) < count:
            seen.add(digest)
            out.append({"name": f"seeded_{seed}_{len(out):03d}", "entry": {"all": leaves}})
    return out


def as_table(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """name, hash and JSON of specifications."""
    return spark.createDataFrame([(s.get("name"), stable_hash({k: v for k, v in s.items() if k != "name"}), stable_json(s)) for s in specs], "name string, hash string, spec string")
