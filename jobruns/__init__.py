"""Job-run analytics on PySpark: DataFrames in, DataFrames out.

Every time value is ``timestamp_ntz`` holding UTC wall-clock time, ``now`` is always an
argument, and no function reads or writes anything unless its name says so.
"""

from jobruns.sources.tables import Tables, read_tables

__all__ = ["Tables", "read_tables"]
