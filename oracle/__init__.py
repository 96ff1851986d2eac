"""DuckDB statements the registered queries are compared with."""

from oracle.sql import STATEMENTS

__all__ = ["STATEMENTS"]
