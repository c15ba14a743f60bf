"""JSON compaction: depth clamped at the knee of key density, arrays cut, constant fields hoisted.

Key order and number text must survive, which VARIANT does not promise, so this is Arrow-batched Python.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

from .lazy import arrow

# The ellipsis, how much of an array stays, the knee, and the shortest embedded span.
MORE = "…"
HEAD, TAIL = 5, 1
KNEE = 0.30
EMBEDDED = re.compile(r"(\{[\s\S]{50,}\}|\[[\s\S]{50,}\])")


def clamp(x, left: int):
    """``x`` with what lies ``left`` levels down cut: three keys of an object, one mark for an array."""
    if isinstance(x, dict):
        return {k: clamp(v, left - 1) for k, v in x.items()} if left > 0 else dict.fromkeys(list(x)[:3], MORE)
    if isinstance(x, list):
        return [clamp(v, left - 1) for v in x] if left > 0 else [MORE] * bool(x)
    return x


def cut_arrays(x):
    if isinstance(x, dict):
        return {k: cut_arrays(v) for k, v in x.items()}
    if not isinstance(x, list):
        return x
    rest = len(x) - HEAD - TAIL
    done = [cut_arrays(v) for v in x]
    return done if rest <= 0 else [*done[:HEAD], f"{MORE} ({rest} more)", *done[-TAIL:]]


def hoist(x):
    """Fields that all objects of a list of more than two share are said once; their order is the first object's."""
    if isinstance(x, dict):
        return {k: hoist(v) for k, v in x.items()}
    if not isinstance(x, list) or len(x) < 3:
        return x
    same = {}
    if all(isinstance(v, dict) for v in x):
        said = [{k: json.dumps(v, default=str) for k, v in row.items()} for row in x]
        same = {k: v for k, v in x[0].items() if all(row.get(k, "null") == said[0][k] for row in said)}
    if not same:
        return [hoist(v) for v in x]
    return {"__constant_fields": same, "__items": [hoist({k: v for k, v in row.items() if k not in same}) for row in x]}


def densities(x) -> list[float]:
    """Distinct keys over keys at each depth that has objects, from the top."""
    found: dict[int, tuple[set, int]] = {}
    level, depth = [x], 0
    while level:
        objects = [v for v in level if isinstance(v, dict)]
        if objects:
            keys = [k for o in objects for k in o]
            found[depth] = set(keys), len(keys)
        level = [v for o in level if isinstance(o, (dict, list)) for v in (o.values() if isinstance(o, dict) else o)]
        depth += 1
    return [len(s) / max(n, 1) for s, n in found.values()]


def knee(curve: list[float]) -> int:
    top = max(curve, default=0)
    if len(curve) < 3 or top == 0:
        return len(curve)
    return next((i for i, d in enumerate(curve) if i and d / top < KNEE), len(curve))


def crush(text: str, most: int = 4) -> str:
    """Compact ASCII JSON of ``text``, or ``text`` if it is no JSON."""
    try:
        x = json.loads(text)
    except (ValueError, RecursionError):
        return text
    depth = min(most, max(1, knee(densities(x))))
    return json.dumps(hoist(cut_arrays(clamp(x, depth))), separators=(",", ":"), default=str)


def saved(before: str, after: str) -> int:
    return max(0, len(before) - len(after)) * 2 // 7


def crush_embedded(text: str, most: int = 4) -> tuple[str, int]:
    total = 0

    def one(m: re.Match) -> str:
        nonlocal total
        new = crush(m[0], most)
        total += saved(m[0], new)
        return new

    return EMBEDDED.sub(one, text), total


def crusher(most: int = 4):
    @arrow("struct<text:string,saved:bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        new = [None if t is None else crush(t, most) for t in texts]
        return pd.DataFrame({"text": new, "saved": [0 if t is None else saved(t, n) for t, n in zip(texts, new, strict=True)]})

    return run


def embedded_crusher(most: int = 4):
    @arrow("struct<text:string,saved:bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [(None, 0) if t is None else crush_embedded(t, most) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in done], "saved": [s for _, s in done]})

    return run


@arrow("struct<densities:array<double>,knee:int>")
def key_density(texts: pd.Series) -> pd.DataFrame:
    curves = []
    for t in texts:
        try:
            curves.append(densities(json.loads(t)) if t is not None else [])
        except (ValueError, RecursionError):
            curves.append([])
    return pd.DataFrame({"densities": curves, "knee": [knee(c) for c in curves]})
