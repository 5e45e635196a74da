"""Stages that need an external model or engine, as pluggable steps with a fixed contract.

A stage gets (key, payload columns) and gives back its key, its output columns, ``status``
(success, warning or error) and ``error``.  A batch that fails gives an error row for each
of its rows and never stops the job; nothing is made up where a model is absent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as S


@dataclass(frozen=True)
class Stage:
    name: str
    key: str
    output: str  # DDL of the columns that fn adds
    fn: Callable[[pd.DataFrame], pd.DataFrame]  # key and output columns, in any order

    def apply(self, df: DataFrame) -> DataFrame:
        key, fn = self.key, self.fn
        added = S._parse_datatype_string(self.output)
        schema = S.StructType([df.schema[key], *added, S.StructField("status", S.StringType()), S.StructField("error", S.StringType())])
        names = added.names

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                try:
                    got = b[[key]].merge(fn(b), on=key, how="left", indicator=True)
                    missing = got["_merge"] == "left_only"
                    got["status"] = missing.map({True: "error", False: "success"})
                    got["error"] = missing.map({True: "no output", False: None})
                except Exception as e:  # noqa: BLE001
                    got = b[[key]].assign(**{n: None for n in names}, status="error", error=f"{type(e).__name__}: {e}"[:300])
                yield got[[key, *names, "status", "error"]]

        return df.mapInPandas(run, schema)


def absent(name: str, key: str, output: str) -> Stage:
    """A stage whose model is not installed: every row is an error that says so."""

    def fail(_):
        raise RuntimeError(f"{name} is not installed")

    return Stage(name, key, output, fail)


# The interfaces of the external steps.
RASTERISE = absent("pdf rasteriser", "sheet", "height int, width int, data binary")
DETECT = absent("layout detector", "page", "boxes array<struct<cls: string, conf: double, box: array<int>>>")
TRANSCRIBE = absent("notation recogniser", "stub", "abc string, raw_kern string, model_used string")
ENGRAVE = absent("engraver", "stub", "svg string")
READ_TEXT = absent("text recogniser", "page", "text string, tokens long, duration double")
ENHANCE = absent("super resolution", "stub", "height int, width int, data binary")
EXTERNAL = (RASTERISE, DETECT, TRANSCRIBE, ENGRAVE, READ_TEXT, ENHANCE)
