"""Parsers of the two configuration dialects; values are read, never executed.

Headers: ``name = value [value ...]`` lines with numbers (``D`` exponents
too), quoted strings and booleans, ``#`` comments, ``##`` comment blocks, a
backslash at the end of a continued line, ``vector`` tables, ended by the byte
2 and a line feed.

Parameter files: ``name = expression`` with strings, numbers, tuples and
arithmetic; ``$NAME$`` is an environment variable, ``@name@`` another parameter,
``@_name@`` an optional one, ``#include "file"`` another file.
"""

from __future__ import annotations

import ast
import math
import operator
import os
import re
from collections.abc import Callable
from pathlib import Path
from typing import Any

END = b"\x02\n"
ALIGN = 4096
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eEdD][+-]?\d+)?$")
_BOOLEANS = {"true": True, "false": False, "yes": True, "no": False}


def split_header(content: bytes) -> tuple[str, int]:
    """The text of a file's header and the position where its data begin (a multiple of 4096); no header: ("", 0)."""
    end = content.find(END)
    if end < 0:
        return "", 0
    start = end + len(END)
    return content[:end].decode("utf-8", "replace"), -(-start // ALIGN) * ALIGN


def _value(token: str) -> Any:
    if token[:1] == '"':
        return token[1:-1]
    if _NUMBER.match(token):
        plain = token.lower().replace("d", "e")
        return int(plain) if re.fullmatch(r"[+-]?\d+", plain) else float(plain)
    return _BOOLEANS.get(token.lower(), token)


def _uncommented(text: str) -> list[str]:
    lines, inside, held = [], False, ""
    for line in text.splitlines():
        if line.strip().startswith("##"):
            inside = not inside
            continue
        if inside:
            continue
        out, quoted = "", False
        for ch in line:
            quoted ^= ch == '"'
            if ch == "#" and not quoted:
                break
            out += ch
        held += out.rstrip()
        if held.endswith("\\"):
            held = held[:-1] + " "
            continue
        lines.append(held)
        held = ""
    return [*lines, held]


def parse_header(text: str, required: set[str] = frozenset(), known: set[str] | None = None) -> dict[str, Any]:
    """Values by name; several on a line make a list.  ``required`` must be there; with ``known``, other names are errors."""
    out: dict[str, Any] = {}
    columns: list[str] = []
    for line in _uncommented(text):
        tokens = re.findall(r'"[^"]*"|[^\s,]+', line)
        if not tokens:
            columns = []
            continue
        if tokens[0] == "vector":
            columns = [t for t in tokens[1:] if t != "="]
            for c in columns:
                out[c] = []
        elif "=" in line.split('"')[0]:
            name, _, rest = line.partition("=")
            name = name.strip()
            if known is not None and name not in known:
                raise KeyError(f"unknown name {name}")
            values = [_value(t) for t in re.findall(r'"[^"]*"|[^\s,]+', rest)]
            out[name] = values[0] if len(values) == 1 else values
            columns = []
        elif columns:
            for c, t in zip(columns, tokens, strict=True):
                out[c].append(_value(t))
        else:
            raise ValueError(f"cannot read {line!r}")
    if missing := required - out.keys():
        raise KeyError(f"missing {sorted(missing)}")
    return out


_OPERATORS: dict[type, Callable] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv}
_FUNCTIONS = {"sqrt": math.sqrt, "log": math.log, "log10": math.log10, "exp": math.exp, "abs": abs, "int": int, "float": float, "min": min, "max": max}


def evaluate(text: str) -> Any:
    """A literal, a tuple or arithmetic; anything else is an error."""

    def of(node: ast.AST) -> Any:
        if isinstance(node, ast.Expression):
            return of(node.body)
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Tuple | ast.List):
            return [of(n) for n in node.elts]
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            a, b = of(node.left), of(node.right)
            if isinstance(node.op, ast.Pow) and abs(b) > 1000:
                raise ValueError("exponent too large")
            return _OPERATORS[type(node.op)](a, b)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](of(node.operand))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and not node.keywords:
            return _FUNCTIONS[node.func.id](*map(of, node.args))
        raise ValueError(f"not allowed: {ast.dump(node)[:60]}")

    return of(ast.parse(text.strip(), mode="eval"))


def parse_parameters(text: str, folder: str | Path = ".", environment: dict[str, str] | None = None, defaults: dict[str, Any] | None = None) -> dict[str, Any]:
    """Parameters of a file with references resolved, in any order; ``defaults`` are overridden by the file."""
    env = os.environ if environment is None else environment
    raw: dict[str, str] = {}

    def load(body: str, where: Path, depth: int) -> None:
        if depth > 16:
            raise ValueError("includes too deep")
        for line in body.splitlines():
            if m := re.match(r'\s*#include\s+"([^"]+)"', line):
                path = where / re.sub(r"\$(\w+)\$", lambda v: env[v[1]], m[1])
                load(path.read_text(), path.parent, depth + 1)
        for line in _uncommented("\n".join(x for x in body.splitlines() if not x.lstrip().startswith("#include"))):
            if "=" in line:
                name, _, value = line.partition("=")
                raw[name.strip()] = value.strip()

    load(text, Path(folder), 0)
    done: dict[str, Any] = {k: v for k, v in (defaults or {}).items() if k not in raw}

    def resolve(name: str, chain: tuple[str, ...] = ()) -> Any:
        if name in chain:
            raise ValueError(f"{name} refers to itself")
        if name not in done:
            if name not in raw:
                raise KeyError(name)
            whole = re.fullmatch(r"@(_?)(\w+)@", raw[name])
            if whole and (whole[2] in raw or whole[2] in done):
                done[name] = resolve(whole[2], (*chain, name))
                return done[name]

            def put(m: re.Match) -> str:
                if m[1] and m[2] not in raw and m[2] not in done:
                    return ""
                return str(resolve(m[2], (*chain, name)))

            value = re.sub(r"@(_?)(\w+)@", put, raw[name])
            value = re.sub(r"\$(\w+)\$", lambda m: env[m[1]], value)
            try:
                done[name] = evaluate(value)
            except (ValueError, SyntaxError, TypeError):
                parts = value.split()
                try:
                    done[name] = [evaluate(p) for p in parts] if len(parts) > 1 else value.strip('"')
                except (ValueError, SyntaxError, TypeError):
                    done[name] = value.strip('"')
        return done[name]

    for name in raw:
        resolve(name)
    return done


def write_header(values: dict[str, Any]) -> bytes:
    """A header as bytes, padded so that data begin at a multiple of 4096."""

    def shown(v: Any) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, str):
            return f'"{v}"'
        if isinstance(v, list | tuple):
            return " ".join(map(shown, v))
        return repr(v)

    body = "".join(f"{k} = {shown(v)}\n" for k, v in values.items()).encode()
    pad = -(len(body) + 1 + len(END)) % ALIGN
    return body + b"\n" * (1 + pad) + END
