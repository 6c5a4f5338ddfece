"""The event model for SQL: a table function for events and functions for verdicts and text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from saxframe.deploy import ship
from saxframe.functions.constants import ERRORS
from saxframe.operators.machine import Options, parse


class XmlEvents:
    """One row per event of a document: seq, event_type, name, text, attrs, depth, line, col."""

    def eval(self, content: bytes, namespaces: bool = False):
        for seq, (kind, name, text, attrs, depth, _, line, col, *_) in enumerate(parse(bytes(content or b""), Options(namespaces=bool(namespaces))).events):
            yield seq, kind, name, text, None if attrs is None else {a[0]: a[1] for a in attrs}, depth, line, col


def _codes(content: pd.Series) -> pd.Series:
    return content.map(lambda c: parse(bytes(c or b"")).code).astype("int32")


def _well(content: pd.Series) -> pd.Series:
    return _codes(content) == 0


def _said(content: pd.Series) -> pd.Series:
    return content.map(lambda c: "".join(e[2] for e in parse(bytes(c or b"")).events if e[0] == "character_data"))


def register(spark: SparkSession) -> None:
    """xml_events(content, namespaces) as a table function; xml_error(content), xml_is_well_formed(content), xml_text(content)."""
    ship(spark)
    spark.udtf.register("xml_events", F.udtf(XmlEvents, returnType="seq int, event_type string, name string, text string, attrs map<string, string>, depth int, line int, col int"))
    spark.udf.register("xml_error", F.pandas_udf(_codes, "int"))
    spark.udf.register("xml_is_well_formed", F.pandas_udf(_well, "boolean"))
    spark.udf.register("xml_text", F.pandas_udf(_said, "string"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW xml_errors AS SELECT posexplode(array({', '.join(repr(e) if chr(39) not in e else chr(34) + e + chr(34) for e in ERRORS)})) AS (error_code, error)")
