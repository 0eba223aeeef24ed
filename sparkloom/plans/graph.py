"""The property graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCATION = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType())])

NODE = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("kind", T.StringType(), False), T.StructField("language", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("symbol_kind", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("exported", T.BooleanType()), T.StructField("loc", LOCATION), T.StructField("owner_file", T.StringType()),
])

EDGE = T.StructType([
    T.StructField("src", T.StringType(), False), T.StructField("dst", T.StringType(), False), T.StructField("kind", T.StringType(), False),
    T.StructField("target_type", T.StringType()), T.StructField("type_only", T.BooleanType()), T.StructField("wildcard", T.BooleanType()),
    T.StructField("resolution", T.StringType()), T.StructField("loc", LOCATION), T.StructField("owner_file", T.StringType()),
])

KINDS = ("file", "symbol", "external")
EDGE_KINDS = ("import", "reference", "extends", "implements", "re-export")
LANGUAGES = ("ts", "js", "python", "rust", "c", "cpp", "objc")
SYMBOL_KINDS = ("function", "class", "variable", "interface", "type", "enum", "module", "struct", "trait", "protocol", "macro")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns in order; a column that df lacks is null."""
    return df.select(*[(df[f.name] if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class CodeGraph:
    """Nodes (schema NODE) and edges (schema EDGE). An edge is identified by (src, kind, dst): parallel edges of
    different kinds are kept, degrees count edges, neighbours and traversals count nodes."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> CodeGraph:
        return cls(conform(nodes, NODE), conform(edges, EDGE))

    def links(self) -> DataFrame:
        """Distinct (src, dst)."""
        return self.edges.select("src", "dst").distinct()
