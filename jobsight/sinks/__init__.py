"""File sinks: CSV outputs, the document table, appends."""
