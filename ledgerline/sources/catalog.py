"""Models from YAML, tables from Parquet or a session's catalog, results to files."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path as File

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..plans.model import Model, ModelError, build

#: The safe loader, in C where it is built.
LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
MODELS = File(__file__).resolve().parents[1] / "models"


def load_model(semantic: str | File, mapping: str | File, schema: dict[str, set[str]] | None = None) -> Model:
    """The model of two YAML files, checked against the tables' columns if they are given."""
    docs = [yaml.load(File(p).read_text(encoding="utf-8"), Loader=LOADER) for p in (semantic, mapping)]
    return build(*docs, schema)


def retail(schema: dict[str, set[str]] | None = None) -> Model:
    return load_model(MODELS / "retail.semantic.yaml", MODELS / "retail.mapping.yaml", schema)


def parquet(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    """Tables named like the Parquet files of a folder; each is opened once."""
    opened: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        return opened[name]

    return table


def views(spark: SparkSession) -> Callable[[str], DataFrame]:
    """Tables and views of the session."""
    return lambda name: spark.table(name)


def schema_of(model_tables: set[str], tables: Callable[[str], DataFrame]) -> dict[str, set[str]]:
    return {t: set(tables(t).columns) for t in model_tables}


def ddl_schema(text: str) -> dict[str, set[str]]:
    """Tables and columns of CREATE TABLE statements."""
    out: dict[str, set[str]] = {}
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?(\w+)[\"`\]]?\s*\(", bare, re.I):
        depth, start, parts = 1, m.end(), []
        for i in range(m.end(), len(bare)):
            c = bare[i]
            depth += (c == "(") - (c == ")")
            if depth == 0 or (c == "," and depth == 1):
                parts.append(bare[start:i].strip())
                start = i + 1
            if depth == 0:
                break
        else:
            raise ModelError(f"table {m[1]} isn't closed")
        skip = ("primary", "foreign", "unique", "constraint", "check", "key")
        out[m[1]] = {p.split()[0].strip('"`[]') for p in parts if p and p.split()[0].lower() not in skip}
    return out


def write_json(df: DataFrame, path: str, provenance: dict | None = None) -> None:
    """Rows as JSON lines; what they come from stands in a file beside them."""
    df.write.mode("overwrite").json(path)
    if provenance is not None:
        df.sparkSession.createDataFrame([(str(k), str(v)) for k, v in provenance.items()], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}.provenance")
