"""Set-piece (corner kick) event analytics as lazy Spark DataFrame compositions."""

from touchline.sources.tables import EventTables

__all__ = ["EventTables"]
