"""The analytics queries."""
