"""Sources and sinks: given tables, the derived subscriber table, artifacts."""
