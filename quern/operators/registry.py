"""A catalog of operators: named functions of DataFrames with typed parameters, enabled, deferred, discovered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType, VariantType

#: JSON Schema types.
_TYPES: dict[str, DataType] = {"string": StringType(), "integer": LongType(), "number": DoubleType(), "boolean": BooleanType(), "object": VariantType()}


def schema_of(spec: dict) -> StructType:
    """Columns of a JSON Schema object: required ones aren't null; an unknown type is a string."""
    required = set(spec.get("required", ()))

    def kind(s: dict) -> DataType:
        if s.get("type") == "array":
            return ArrayType(kind(s.get("items", {})))
        if s.get("type") == "object" and s.get("properties"):
            return schema_of(s)
        return _TYPES.get(s.get("type"), StringType())

    return StructType([StructField(n, kind(s), n not in required) for n, s in spec.get("properties", {}).items()])


@dataclass
class Operator:
    name: str
    run: Callable[..., DataFrame]
    description: str = ""
    category: str = "read"
    parameters: dict = field(default_factory=dict)
    concurrent: bool = True
    deferred: bool = False


class Registry:
    """Operators by name, in order of registration."""

    def __init__(self):
        self.operators: dict[str, Operator] = {}
        self.disabled: set[str] = set()
        self.discovered: set[str] = set()

    def register(self, op: Operator) -> None:
        self.operators[op.name] = op

    def enable(self, name: str, on: bool = True) -> None:
        (self.disabled.discard if on else self.disabled.add)(name)

    def discover(self, name: str) -> None:
        self.discovered.add(name)

    def get(self, name: str) -> Operator | None:
        return self.operators.get(name)

    def call(self, name: str, *args, **kwargs) -> DataFrame:
        op = self.operators[name]
        if name in self.disabled:
            raise PermissionError(f"{name} is disabled")
        known = set(op.parameters.get("properties", kwargs))
        if unknown := set(kwargs) - known:
            raise TypeError(f"{name} has no parameter {', '.join(sorted(unknown))}")
        return op.run(*args, **kwargs)

    def visible(self) -> list[Operator]:
        """Enabled operators that aren't deferred or have been discovered."""
        return [o for n, o in self.operators.items() if n not in self.disabled and (not o.deferred or n in self.discovered)]

    def schemas(self, protocol: str) -> list[dict]:
        plain = protocol == "anthropic"
        return [{"name": o.name, "description": o.description, "input_schema": o.parameters} if plain else {"type": "function", "name": o.name, "description": o.description, "parameters": o.parameters} for o in self.visible()]

    def table(self, spark) -> DataFrame:
        rows = [(i, o.name, o.description, o.category, o.concurrent, o.deferred, n in self.disabled, n in self.discovered) for i, (n, o) in enumerate(self.operators.items())]
        return spark.createDataFrame(rows, "seq int, name string, description string, category string, concurrent boolean, deferred boolean, disabled boolean, discovered boolean")


def checked_output(df: DataFrame, column: str, schema: StructType) -> DataFrame:
    """The column's JSON parsed to the schema; a row that doesn't fit is an error."""
    return df.withColumn(column, F.from_json(column, schema, {"mode": "FAILFAST"}))
