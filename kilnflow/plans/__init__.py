"""Registered queries over the driver's tables and the SQL that they are checked against."""
