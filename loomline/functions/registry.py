"""UD1 to UD5: a registry of named functions with declared parameters, over Spark's own function registry."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType, _parse_datatype_string

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}\Z")


class InvalidTool(ValueError):
    """A definition that fails validation; .problems lists why."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Tool:
    """UD1: a function of typed parameters. kind: scalar (Arrow-batched), aggregate (of pandas series) or table (a class with eval)."""

    name: str
    execute: Callable
    description: str = ""
    parameters: dict[str, str] = field(default_factory=dict)
    returns: str = "string"
    kind: str = "scalar"
    source: str = ""


def problems_of(tool: Tool) -> list[str]:
    """UD3: what is wrong with a definition."""
    out = []
    if not isinstance(tool.name, str) or not _NAME.match(tool.name):
        out.append(f"name {tool.name!r} is not an identifier")
    if not isinstance(tool.description, str) or not tool.description.strip():
        out.append("description is empty")
    if not callable(tool.execute):
        out.append("execute is not callable")
    if tool.kind not in ("scalar", "aggregate", "table"):
        out.append(f"kind {tool.kind!r} is unknown")
    for what in (*tool.parameters.items(), ("the result", tool.returns)):
        try:
            kind = _parse_datatype_string(what[1])
            assert isinstance(kind, DataType)
            if tool.kind == "table" and what[0] == "the result" and not isinstance(kind, StructType):
                out.append("a table function returns columns")
        except Exception:  # noqa: BLE001  whatever the parser raises, the type is bad
            out.append(f"type of {what[0]} can't be read: {what[1]!r}")
    return out


class Registry:
    """UD2: register, get, list, has, unregister, clear and load; the last registration of a name wins."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tools, self._loaded = spark, {}, {}

    def register(self, tool: Tool) -> None:
        if found := problems_of(tool):
            raise InvalidTool(found)
        if tool.kind == "table":
            self.spark.udtf.register(tool.name, F.udtf(tool.execute, returnType=tool.returns))
        elif tool.kind == "aggregate":
            self.spark.udf.register(tool.name, F.pandas_udf(tool.execute, tool.returns))
        else:
            self.spark.udf.register(tool.name, F.udf(tool.execute, tool.returns, useArrow=True))
        self.tools[tool.name] = tool

    def get(self, name: str) -> Tool | None:
        return self.tools.get(name)

    def has(self, name: str) -> bool:
        return name in self.tools

    def list(self) -> list[Tool]:
        return [self.tools[n] for n in sorted(self.tools)]

    def unregister(self, name: str) -> bool:
        if name not in self.tools:
            return False
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        del self.tools[name]
        return True

    def clear(self) -> None:
        for name in list(self.tools):
            self.unregister(name)
        self._loaded.clear()

    def load(self, *folders: str) -> dict[str, list]:
        """Registers the TOOLS of each module in the folders; a later folder's tools replace an earlier one's. Bad modules are reported, not fatal."""
        out: dict[str, list] = {"loaded": [], "failed": []}
        for folder in folders:
            for path in sorted(Path(folder).glob("*.py")):
                try:
                    spec = importlib.util.spec_from_file_location(f"tools_{path.stem}", path)
                    module = importlib.util.module_from_spec(spec)
                    spec.loader.exec_module(module)
                    for tool in module.TOOLS:
                        self.register(tool)
                        out["loaded"].append(tool.name)
                    self._loaded[str(path)] = path.stat().st_mtime
                except Exception as e:  # noqa: BLE001  a module of the user's may raise anything
                    out["failed"].append((str(path), str(e)))
        return out

    def stale(self) -> bool:
        """Whether a loaded module has changed or gone."""
        return any(not Path(p).exists() or Path(p).stat().st_mtime != t for p, t in self._loaded.items())

    def apply(self, df: DataFrame, name: str, *columns: str, into: str) -> DataFrame:
        return df.withColumn(into, F.call_function(name, *map(F.col, columns)))


__all__ = ["InvalidTool", "Registry", "Tool", "problems_of"]
