"""Sources and sinks: driver tables, the fixture fact, period sheets, master/table writers."""

from riskloom.sources.fixture import complaint_fact
from riskloom.sources.tables import read_table, table_path

__all__ = ["complaint_fact", "read_table", "table_path"]
