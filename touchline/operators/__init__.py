"""Generic DataFrame operators the analytics are composed of."""
