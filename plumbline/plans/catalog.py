"""Every query of the library with the DuckDB SQL that gives the same rows."""

from . import fleet, history, shape, sync

QUERIES = sync.QUERIES | shape.QUERIES | history.QUERIES | fleet.QUERIES
ORACLE_SQL = sync.ORACLE_SQL | shape.ORACLE_SQL | history.ORACLE_SQL | fleet.ORACLE_SQL
