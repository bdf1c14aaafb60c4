"""Queries of the library on the driver's tables, with the SQL they must agree with."""
