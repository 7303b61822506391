"""A table language over DataFrames: select lists, groupings, equi-joins, top-k, CSV and rows."""

from quern.functions import aggregates, values
from quern.operators.select import S, Select
from quern.operators.table import Table, concatenate
from quern.session import build
from quern.sources.csv import double_field, export_csv, import_csv, instant_field, int_field, long_field, str_field
from quern.sources.rows import export_rows, import_rows

__all__ = [
    "S", "Select", "Table", "aggregates", "build", "concatenate", "double_field", "export_csv", "export_rows", "import_csv", "import_rows",
    "instant_field", "int_field", "long_field", "str_field", "values",
]
