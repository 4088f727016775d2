"""lamina: a Spark-native column store with row positions, lazy predicates and versioned tables."""

from lamina.functions.spec import ColumnSpec, TableSpec
from lamina.operators.predicates import RowSet
from lamina.sources.store import Store
from lamina.sources.table import ColumnRef, Table

__all__ = ["ColumnRef", "ColumnSpec", "RowSet", "Store", "Table", "TableSpec"]
