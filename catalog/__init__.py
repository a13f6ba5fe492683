"""Operator queries over the driver's tables, with SQL to check them against."""
