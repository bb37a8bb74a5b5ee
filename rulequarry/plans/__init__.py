"""The rule queries over the driver's tables, each with the SQL that it must agree with."""
