"""Clean-up of converted documents after the fact."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.unicode import sanitize, sanitize_text
from quire.plans.schema import SECTION


def sanitize_sections(df: DataFrame) -> DataFrame:
    """df (title, author, sections) with clean text; images' metadata stays as it is."""

    @F.arrow_udf(T.ArrayType(SECTION))
    def clean(column: pa.Array) -> pa.Array:
        rows = column.to_pylist()
        for own in rows:
            for s in own or ():
                for k in ("markdown", "title"):
                    s[k] = None if s[k] is None else sanitize_text(s[k])
                if s["kind"] != "image" and s["metadata"]:
                    s["metadata"] = [(k, None if v is None else sanitize_text(v)) for k, v in dict(s["metadata"]).items()]
        return pa.array(rows, column.type)

    return df.withColumns({"title": sanitize(F.col("title")), "author": sanitize(F.col("author")), "sections": clean("sections")})
