"""Formatters of training and prompt text (P1-P10, S4-S6 projections)."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.text import captured, strip


# The wording of the formats below.


def proof(subject: Column, level: Column, problem: Column, solution: Column) -> Column:
    return F.concat(
        F.lit("# Subject: "), F.coalesce(subject, F.lit("Mathematics")), F.lit(" (Level "), F.coalesce(level, F.lit("Advanced")),
        F.lit(")\n\n## Mathematical Theorem / Problem Specification\n"), strip(F.coalesce(problem, F.lit(""))),
        F.lit("\n\n## Formal Step-by-Step Proof and Derivation\n"), strip(F.coalesce(solution, F.lit(""))), F.lit("\n"),
    )


def tool_dialogue(chat: Column) -> Column:
    """A function-calling chat as control-tagged text; null unless both markers and the first three captures are there."""
    user = captured(chat, r"(?s)USER:\s*(.*?)\s*ASSISTANT:")
    call = captured(chat, r"(?s)<functioncall>\s*(.*?)\s*(?:<\|endoftext\|>|FUNCTION RESPONSE:)")
    result = captured(chat, r"(?s)FUNCTION RESPONSE:\s*(.*?)\s*ASSISTANT:")
    answer = captured(chat, r"(?s)FUNCTION RESPONSE:.*?\s*ASSISTANT:\s*(.*?)(?:<\|endoftext\|>|\z)")
    text = F.concat(
        F.lit("<|bos|>User: "), user, F.lit("\n<|thought start|>I should invoke the requested tool with the parsed parameters.<|thought end|><|call tool|>\n"), call,
        F.lit("\n<|tool response|>\n"), result, F.lit("\n<|reflect|>Execution returned result without error. Formulating final answer to the user.\nFinal Response: "),
        F.coalesce(answer, F.lit("Execution succeeded.")), F.lit("<|eos|>"),
    )
    return F.when(chat.contains("<functioncall>") & chat.contains("FUNCTION RESPONSE:"), text)


@F.pandas_udf(StringType())
def pretty_json(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON with two spaces of indent; Spark's own pretty printer sets other spaces."""
    for series in parts:
        yield series.map(lambda s: None if s is None else json.dumps(json.loads(s), indent=2))


def _given(value: Column, *around: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(*around)).otherwise("")


def interaction(prompt: Column, thought: Column, tool: Column, args_json: Column, result_json: Column, reflection: Column, answer: Column) -> Column:
    call = pretty_json(F.concat(F.lit('{"tool": '), F.to_json(F.array(tool)).substr(F.lit(2), F.length(F.to_json(F.array(tool))) - 2), F.lit(', "parameters": '), args_json, F.lit("}")))
    return F.concat(
        F.lit("<|bos|>User: "), prompt, F.lit("\n<|thought start|>"), thought, F.lit("<|thought end|><|call tool|>\n"), call,
        F.lit("\n<|tool response|>\n"), pretty_json(result_json), F.lit("\n"),
        _given(reflection, F.lit("<|reflect|>"), reflection), _given(answer, F.lit("\nFinal Response: "), answer, F.lit("<|eos|>")),
    )


def turn(thought: Column, call: Column, response: Column, reflection: Column, content: Column) -> Column:
    return F.concat(
        _given(thought, F.lit("<|thought start|>"), thought, F.lit("<|thought end|>")), _given(call, F.lit("<|call tool|>"), call),
        _given(response, F.lit("<|tool response|>"), response), _given(reflection, F.lit("<|reflect|>"), reflection), _given(content, content),
    )


def chat_prompt(user: Column) -> Column:
    return F.concat(F.lit("<|bos|>User: "), user, F.lit("\n<|thought start|>"))


def tree(node: Any) -> Any:
    """A syntax tree as plain data."""
    if isinstance(node, ast.AST):
        return {"_type": type(node).__name__} | {name: tree(value) for name, value in ast.iter_fields(node)}
    if isinstance(node, list):
        return [tree(x) for x in node]
    if isinstance(node, bytes):
        return node.decode("utf-8", "replace")
    return node if node is None or isinstance(node, (str, int, float)) else str(node)


@F.udtf(returnType="node: int, parent: int, field: string, type: string")
class SyntaxTree:
    """The nodes of code's syntax tree as rows: number in pre-order, number of the parent, field that holds it, type.

    Code that does not parse is one row with the error's type, null is no row.
    """

    def eval(self, code: str):
        if code is None:
            return
        try:
            root = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            yield 0, None, None, type(e).__name__
            return
        number, waiting = 0, [(None, None, root)]
        while waiting:
            parent, field, node = waiting.pop()
            yield number, parent, field, type(node).__name__
            below = [(number, name, x) for name, value in ast.iter_fields(node) for x in (value if isinstance(value, list) else [value]) if isinstance(x, ast.AST)]
            waiting += reversed(below)
            number += 1


def code_pair_text(code: str) -> str:
    try:
        spec = json.dumps(tree(ast.parse(code)), indent=2)
    except Exception as e:  # whatever stops the parser is part of the text
        return f"# Source\n{code}\n# Parse Error: {e}"
    return f"# Python Source Code\n```python\n{code}\n```\n\n# Abstract Syntax Tree (AST) Specification\n```json\n{spec}\n```"


@F.pandas_udf(StringType())
def code_pair(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Code with its syntax tree as JSON."""
    for series in parts:
        yield series.map(lambda s: None if s is None else code_pair_text(s))


def code_of(output: Column, text: Column, most: int = 2000) -> Column:
    """A record's code, cut; null unless it defines something."""
    raw = F.coalesce(F.nullif(strip(output), F.lit("")), strip(text))
    return F.when(raw.contains("def ") | raw.contains("class "), F.substring(raw, 1, most))


def token_count(literal: Column) -> Column:
    """'10M' as 10000000; null for null, blank and anything else."""
    t = F.upper(F.trim(literal))
    number = F.regexp_extract(t, r"^([0-9]*\.?[0-9]+)[KMB]?$", 1)
    scale = F.when(t.endswith("B"), 1e9).when(t.endswith("M"), 1e6).when(t.endswith("K"), 1e3).otherwise(1.0)
    return F.when(number != "", (number.cast("double") * scale).cast("long"))


def highlighted(text: Column, marks: dict[str, str]) -> Column:
    """Control tags replaced by marks, replacement characters taken out."""
    out = F.replace(text, F.lit("�"), F.lit(""))
    for tag, mark in marks.items():
        out = F.replace(out, F.lit(tag), F.lit(mark))
    return out


def inside_after(text: Column, opening: str, closing: str) -> Column:
    """1 if a chunk leaves a region open, 0 if it leaves it closed, null if it says neither; carry on with last()."""
    opened, closed = F.locate(opening, text) > 0, F.locate(closing, text) > 0
    return F.when(closed, 0).when(opened, 1)
