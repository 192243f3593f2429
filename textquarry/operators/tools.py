"""Tool calls: schemas, JSON salvage, validation and the bounded repair loop."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("boolean", "integer", "number", "string")
# How a task and a rejected reply are put to the model.
TASK_PROMPT, RETRY_PROMPT = "{hint}\n\nTask: {task}", "\n\nYour previous reply was rejected: {feedback}\nTry again."
NO_OBJECT = "no JSON object found in the reply"


@dataclass(frozen=True)
class Parameter:
    name: str
    type: str
    description: str = ""
    required: bool = True
    enum: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"parameter {self.name}: {self.type!r} is no primitive type ({', '.join(TYPES)})")


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: tuple[Parameter, ...] = ()

    @classmethod
    def of(cls, raw: dict) -> Tool:
        made = [Parameter(p["name"], p["type"], p.get("description", ""), p.get("required", True), tuple(p["enum"]) if p.get("enum") else None) for p in raw.get("parameters", ())]
        return cls(raw["name"], raw.get("description", ""), tuple(made))

    def schema(self) -> dict:
        """The function schema that chat models take."""
        shape = {p.name: {k: v for k, v in (("type", p.type), ("description", p.description), ("enum", list(p.enum or ()))) if v} for p in self.parameters}
        body = {"type": "object", "properties": shape, "required": [p.name for p in self.parameters if p.required]}
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": body}}

    def prompt_hint(self) -> str:
        """The schema in words."""
        keys = [f"  {p.name}: {p.type}" + (f" one of {list(p.enum)}" if p.enum else "") + ("" if p.required else " (optional)") for p in self.parameters]
        return "\n".join([f"Call {self.name}. {self.description}", "Reply with JSON only, with keys:", *keys])


_BRACES = re.compile(r'\\.|["{}]', re.DOTALL)


def _ends(text: str, start: int) -> dict[int, int | None]:
    """Each brace outside of strings from `start` on that opens, with its closing one, in one walk."""
    found: dict[int, int | None] = {}
    open_, quoted = [], False
    for m in _BRACES.finditer(text, start):
        mark = m[0]
        if mark == '"':
            quoted = not quoted
        elif not quoted and mark == "{":
            open_.append(m.start())
            found[m.start()] = None
        elif not quoted and mark == "}" and open_:
            found[open_.pop()] = m.start()
            if not open_:
                break
        elif not quoted and len(mark) > 1 and mark[1] in '"{}':  # a backslash escapes in strings only
            return _slow_ends(text, start)
    return found


def _slow_ends(text: str, start: int) -> dict[int, int | None]:
    """The same where backslashes stand outside of strings."""
    found: dict[int, int | None] = {}
    open_, quoted, at = [], False, start
    while at < len(text):
        c = text[at]
        if quoted and c == "\\":
            at += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == "{":
            open_.append(at)
            found[at] = None
        elif not quoted and c == "}" and open_:
            found[open_.pop()] = at
            if not open_:
                break
        at += 1
    return found


def first_object(text: str | None) -> dict | None:
    """The first balanced {...} of a text that is JSON; what can't be read (too deep, too long a number) is passed over."""
    ends: dict[int, int | None] = {}
    at = text.find("{") if text else -1
    while at >= 0:
        if at not in ends:
            ends |= _ends(text, at)
        if (end := ends.get(at)) is not None:
            try:
                return json.loads(text[at : end + 1])
            except (ValueError, RecursionError):
                pass
        at = text.find("{", at + 1)
    return None


def salvage(reply: Column) -> Column:
    """The first JSON object of a reply as JSON text, or null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_object).map(lambda x: None if x is None else json.dumps(x, ensure_ascii=False))

    return run(reply)


def _fits(kind: str, value) -> bool:
    if kind == "boolean":
        return isinstance(value, bool)
    if kind == "string":
        return isinstance(value, str)
    return not isinstance(value, bool) and isinstance(value, int if kind == "integer" else (int, float))


# The wording of errors and hints, since they are parts of recorded prompts.
def problems(tool: Tool, arguments, null_is_absent: bool = True) -> list[str]:
    """What is wrong with a parsed call, in words that can be sent back."""
    if not isinstance(arguments, dict):
        return [f"expected a JSON object, got {type(arguments).__name__}"]
    by_name = {p.name: p for p in tool.parameters}
    ignored = {k for k, v in arguments.items() if null_is_absent and v is None and k in by_name and not by_name[k].required}
    given = {k: v for k, v in arguments.items() if k not in ignored}

    def about(p: Parameter) -> str | None:
        if p.name not in given:
            return f"missing required key `{p.name}`" if p.required else None
        value = given[p.name]
        if not _fits(p.type, value):
            got = "boolean" if isinstance(value, bool) and p.type in ("integer", "number") else f"{type(value).__name__} ({json.dumps(value, ensure_ascii=False)[:40]})"
            return f"`{p.name}` must be a {p.type}, got {got}"
        return f"`{p.name}` must be one of {list(p.enum)}, got {value!r}" if p.enum and value not in p.enum else None

    return [e for e in map(about, tool.parameters) if e] + [f"unknown key `{k}`" for k in given if k not in by_name]


def checked(tool: Tool, reply: Column, null_is_absent: bool = True) -> Column:
    """struct(parsed, ok, errors) of a reply: salvage and validation in one Arrow pass."""

    @F.pandas_udf("struct<parsed:string,ok:boolean,errors:array<string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = first_object(text)
            errors = [NO_OBJECT] if found is None else problems(tool, found, null_is_absent)
            rows.append((None if found is None else json.dumps(found, ensure_ascii=False), not errors, errors))
        return pd.DataFrame(rows, columns=["parsed", "ok", "errors"])

    return run(reply)


def feedback(errors: Column) -> Column:
    return F.array_join(errors, "; ")


def prompt(tool: Tool, task: Column, said: Column | None = None) -> Column:
    base = F.concat(F.lit(TASK_PROMPT.partition("{task}")[0].replace("{hint}", tool.prompt_hint())), task)
    if said is None:
        return base
    before, _, after = RETRY_PROMPT.partition("{feedback}")
    return F.concat(base, F.lit(before), said, F.lit(after))


def run_tasks(tool: Tool, tasks: DataFrame, answer, max_attempts: int = 3, null_is_absent: bool = True) -> DataFrame:
    """(task_id, attempt, raw, parsed, ok, errors): rounds of asking; only failures go on to the next.

    tasks: (task_id, task); answer: DataFrame(task_id, attempt, prompt) -> DataFrame with `raw` added. A round's
    rows are computed again where the next needs them, so replies must not vary: replay does not, and live
    ones are recorded first. Nothing is held on executors.
    """
    open_, out = tasks.select("task_id", "task", F.lit(None).cast("string").alias("said")), None
    for attempt in range(1, max_attempts + 1):
        asked = open_.withColumn("attempt", F.lit(attempt)).withColumn("prompt", prompt(tool, F.col("task"), F.col("said") if attempt > 1 else None))
        judged = answer(asked).withColumn("c", checked(tool, F.col("raw"), null_is_absent))
        rows = judged.select("task_id", "attempt", "raw", "c.parsed", "c.ok", "c.errors")
        out = rows if out is None else out.unionByName(rows)
        open_ = judged.filter(~F.col("c.ok")).select("task_id", "task", feedback(F.col("c.errors")).alias("said"))
    return out


def repair_summary(attempts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Shares of tasks right at first, at last and never, and the mean number of tries."""
    keys = by or []
    tasks = attempts.groupBy(*keys, "task_id").agg(F.max("attempt").alias("tries"), F.max("ok").alias("ok"))
    share = lambda c: F.coalesce(F.round(F.avg(c.cast("int")), 6), F.lit(0.0))
    return tasks.groupBy(*keys).agg(F.count("*").alias("n"), share(F.col("ok") & (F.col("tries") == 1)).alias("first_try"), share(F.col("ok")).alias("eventually"), share(~F.col("ok")).alias("never"), F.coalesce(F.round(F.avg("tries"), 6), F.lit(0.0)).alias("mean_tries"))
