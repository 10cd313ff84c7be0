"""Commands and results out of the envelopes that tools put around them.

An envelope is JSON or a script that calls one tool, so it is parsed row by row in Arrow batches.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import functions as F

from tracewell.sources.ship import ship

_OPEN = re.compile(r"tools\.exec_command\s*\(\s*\{")
_TOKEN = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|[{},]|[^\"'`{},]+", re.S)
_FIELD = re.compile(r"\s*[\"']?([A-Za-z_][A-Za-z0-9_-]*)[\"']?\s*:\s*(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|-?[0-9]+|true|false|null)\s*", re.S)


def _object(raw: str):
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _wrapped_command(script: str) -> str | None:
    """The ``cmd`` field of a script's only tool call, if it is a plain string."""
    if re.findall(r"tools\.[A-Za-z0-9_]+", script) != ["tools.exec_command"] or not (start := _OPEN.search(script)):
        return None
    fields, depth, at = [""], 1, start.end()
    while depth and (token := _TOKEN.match(script, at)):
        part, at = token[0], token.end()
        depth += (part == "{") - (part == "}")
        if part == "," and depth == 1:
            fields.append("")
        elif depth:
            fields[-1] += part
    found = [m.groups() for f in fields if (m := _FIELD.fullmatch(f))]
    names = [name for name, _ in found]
    value = dict(found).get("cmd", "")
    if depth or len(set(names)) < len(names) or value[:1] not in ("'", '"'):
        return None
    try:
        return json.loads(value) if value[0] == '"' else ast.literal_eval(value)
    except (ValueError, SyntaxError):
        return None


def exec_command(kind: str | None, name: str | None, given: str | None) -> str | None:
    """The command of an exec call, from a mapping or a script that makes one call; null if in doubt."""
    if kind != "custom_tool_call" or name not in ("exec", "exec_command") or given is None:
        return None
    if (mapping := _object(given)) is not None:
        command = mapping.get("cmd")
        return command if isinstance(command, str) and command else None
    return _wrapped_command(given)


def _plain_result(value: dict):
    code, output = value.get("exit_code"), value.get("output")
    if isinstance(code, bool) or not isinstance(code, int) or not isinstance(output, str):
        return None
    return output, code, bool(value.get("truncated", False)) or value.get("original_token_count") is not None


def _runner_result(parts: list):
    """A list whose first text tells how the script ended, and whose other texts are the output."""
    texts = [p.get("text") if isinstance(p, dict) else None for p in parts]
    head = texts[0] if texts and isinstance(texts[0], str) else ""
    if head.startswith("Script completed"):
        code = 0
    elif head.startswith("Script failed"):
        code = int(m[1]) if (m := re.search(r"exit code\s+(-?\d+)", head, re.I)) else 1
    else:
        return None
    output = "".join(t for t in texts[1:] if isinstance(t, str))
    cut = any(s in output.lower() for s in ("truncated output", "output truncated")) or any(isinstance(p, dict) and p.get("original_token_count") is not None for p in parts)
    return output, code, cut


def exec_result(raw: str | None):
    """(output, exit code, truncated) of a structured result given as JSON text, or None."""
    if raw is None:
        return None
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    if isinstance(value, str):  # a string that holds an object
        value = _object(value)
    if isinstance(value, list):
        if len(value) == 1 and isinstance(value[0], dict):
            inner = value[0] if "exit_code" in value[0] else _object(value[0]["text"]) if isinstance(value[0].get("text"), str) else None
            if inner is not None and "exit_code" in inner:
                return _plain_result(inner)
        return _runner_result(value)
    return _plain_result(value) if isinstance(value, dict) else None


def tool_output(raw: str | None):
    """:func:`exec_result`, or the text as it stands with an unknown exit code."""
    if (found := exec_result(raw)) is not None:
        return *found, True
    try:
        value = json.loads(raw or "")
    except (ValueError, RecursionError):
        value = None
    if isinstance(value, (dict, list)):
        return json.dumps(value), None, False, False
    plain = value if isinstance(value, str) else raw or ""
    return plain, None, "truncated" in plain.lower(), False


def exec_command_udf():
    ship()

    @F.pandas_udf("string")
    def run(kind: pd.Series, name: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([exec_command(*row) for row in zip(kind, name, given)], dtype=object)

    return run


def tool_output_udf():
    ship()

    @F.pandas_udf("struct<output string, exit_code int, truncated boolean, structured boolean>")
    def run(raw: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([tool_output(r) for r in raw], columns=["output", "exit_code", "truncated", "structured"])
        return out.astype({"exit_code": "Int32"})

    return run
