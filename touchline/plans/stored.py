"""Base tables that can be written once and read back in place of a computation.

A function marked ``@stored`` answers from ``tables.stored`` when the table is
there and computes it from the events otherwise, so every query runs the same on
raw events and on prepared tables.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame

from touchline.sources.tables import EventTables

# name -> function; later tables build on earlier ones.
BASE_TABLES: dict = {}


def stored(function):
    name = function.__name__

    @wraps(function)
    def answer(t: EventTables) -> DataFrame:
        return t.stored[name] if name in t.stored else function(t)

    BASE_TABLES[name] = answer
    return answer
