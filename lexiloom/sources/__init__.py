"""Reading and writing of records, tables and reports."""
