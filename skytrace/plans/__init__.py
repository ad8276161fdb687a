"""Queries over the test tables, one per operator, with the same results in SQL where SQL can express them."""

from skytrace.plans import charts, flights, formats, records, relational, series, tracks

QUERIES = relational.QUERIES | series.QUERIES | tracks.QUERIES | charts.QUERIES | records.QUERIES | formats.QUERIES | flights.QUERIES
SQL = relational.SQL | series.SQL | tracks.SQL | charts.SQL | records.SQL | formats.SQL | flights.SQL
