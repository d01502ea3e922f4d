"""One column list for a query and for its SQL check.

A list is a string of ``name[:form]`` tokens.  Forms: a number rounds to that many
digits, ``t`` writes a timestamp and ``d`` a date as text, ``i`` casts to a 64-bit
integer.  No form passes the column through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tokens(columns: str) -> list[tuple[str, str]]:
    return [tuple(token.partition(":")[::2]) for token in columns.split()]


def present(df: DataFrame, columns: str) -> DataFrame:
    def shape(name: str, form: str):
        c = F.col(name)
        if form == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif form == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif form == "i":
            c = c.cast("bigint")
        elif form:
            c = F.round(c, int(form))
        return c.alias(name)

    return df.select(*[shape(n, f) for n, f in _tokens(columns)])


def present_sql(body: str, columns: str) -> str:
    def shape(name: str, form: str) -> str:
        quoted = f'"{name}"'
        if form == "t":
            return f"strftime({quoted}, '%Y-%m-%d %H:%M:%S') AS {quoted}"
        if form == "d":
            return f"strftime({quoted}, '%Y-%m-%d') AS {quoted}"
        if form == "i":
            return f"CAST({quoted} AS BIGINT) AS {quoted}"
        if form:
            return f"(round(CAST({quoted} AS DOUBLE), {form}) + 0.0) AS {quoted}"
        return quoted

    return f"SELECT {', '.join(shape(n, f) for n, f in _tokens(columns))} FROM ({body}) AS result"
