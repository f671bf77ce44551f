"""Values inside JSON texts, met by names in any case and punctuation. JSON that can't be read counts as null."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHILDREN = "array<struct<name:string,type:string>>"


def _read(text: str | None) -> Any:
    try:
        return None if text is None else json.loads(text)
    except (ValueError, RecursionError):
        return None


def _text(value: Any) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False)


def _folded(name: str) -> str:
    return "".join(filter(str.isalnum, name.lower()))


def _key(held: dict, name: str) -> str | None:
    """The key ``name`` itself, else the first that differs in case and punctuation only."""
    return name if name in held else next((k for k in held if _folded(k) == _folded(name)), None)


def _followed(node: Any, parts: list[str]) -> Any:
    """The value at ``parts`` below ``node``; an array stands for its first object."""
    for part in parts:
        if isinstance(node, list):
            node = next((x for x in node if isinstance(x, dict)), None)
        key = _key(node, part) if isinstance(node, dict) else None
        if key is None:
            return None
        node = node[key]
    return node


def _found(node: Any, name: str, parts: list[str]) -> Any:
    """Depth first: the path from here, then a key of this object, then what it holds. A matching key ends the search below it."""
    value = _followed(node, parts) if len(parts) > 1 else None
    if value is not None:
        return value
    if isinstance(node, dict) and (key := _key(node, name)) is not None:
        return node[key]
    below = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
    return next((v for v in (_found(x, name, parts) for x in below) if v is not None), None)


def _leaves(node: Any, path: str) -> Iterator[tuple[str, Any]]:
    """Paths and values below an object, or below the first object of an array."""
    if isinstance(node, list):
        node = next((x for x in node if isinstance(x, dict)), None)
    for key, value in node.items() if isinstance(node, dict) else ():
        inner = list(_leaves(value, f"{path}/{key}")) if isinstance(value, dict | list) else []
        if inner:
            yield from inner
        elif not isinstance(value, dict):
            yield f"{path}/{key}", value


def _type(value: Any) -> str:
    # Names of types.
    names = {bool: "bool", int: "int", float: "decimal", list: "array", dict: "object"}
    return names.get(type(value), "string")


def _search(text: str | None, name: str | None) -> Any:
    return _found(_read(text), name, [p for p in name.split("/") if p]) if name else None


def _put(text: str | None, path: str | None, value: str | None) -> str:
    """``text`` with ``value`` (JSON, else plain text) at the dot path; what is no object on the way becomes one."""
    top = _read(text)
    top = here = top if isinstance(top, dict) else {}
    parts = [p for p in (path or "").replace("/", ".").split(".") if p]
    for part in parts[:-1]:
        if not isinstance(here.get(part), dict):
            here[part] = {}
        here = here[part]
    if parts:
        made = _read(value)
        here[parts[-1]] = value if made is None else made
    return json.dumps(top, ensure_ascii=False)


def _without(text: str | None, path: str | None) -> str | None:
    """``text`` without the exact dot path; as it was where the path is absent."""
    top = here = _read(text)
    parts = [p for p in (path or "").replace("/", ".").split(".") if p]
    for part in parts[:-1]:
        here = here.get(part) if isinstance(here, dict) else None
    if parts and isinstance(here, dict):
        here.pop(parts[-1], None)
    return _text(top)


def _children(text: str | None, name: str | None) -> list[dict]:
    return [{"name": path, "type": _type(value)} for path, value in _leaves(_search(text, name), name or "")]


def _pairs(helper: Callable, returns: str) -> Callable[..., Column]:
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([helper(*row) for row in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(each, returns)


def find_value(text: Column, name: Column) -> Column:
    """JSON of the value under ``name`` (a key, or keys with /), wherever it is; null without one."""
    return _pairs(lambda t, n: _text(_search(t, n)), "string")(text, name)


def set_value(text: Column, path: Column, value: Column) -> Column:
    """``text`` with ``value`` at the dot path ``path``."""

    def each(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([_put(*row) for row in zip(a, b, c, strict=True)], dtype=object)

    return F.pandas_udf(each, "string")(text, path, value)


def remove_value(text: Column, path: Column) -> Column:
    """``text`` without the value at the dot path ``path``."""
    return _pairs(_without, "string")(text, path)


def children(text: Column, name: Column) -> Column:
    """(name, type) of each leaf below the value of ``name``, named parent/child; none for plain values."""
    return _pairs(_children, CHILDREN)(text, name)


EXPANDED = "array<struct<type:string,children:array<struct<name:string,type:string>>>>"


def _expanded(text: str | None, names: list[str] | None) -> list[dict]:
    top = _read(text)
    found = [_found(top, n, [p for p in n.split("/") if p]) if n else None for n in (names if names is not None else [])]
    return [{"type": _type(v) if isinstance(v, dict | list) else None, "children": [{"name": p, "type": _type(x)} for p, x in _leaves(v, n or "")]} for n, v in zip(names if names is not None else [], found, strict=True)]


def expanded(text: Column, names: Column) -> Column:
    """For each of the array ``names`` the type of its value in the JSON ``text`` if that is an object or array, and its children."""
    return _pairs(_expanded, EXPANDED)(text, names)
