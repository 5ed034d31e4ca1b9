"""Sources and sinks: text trees, tables, directory listings, exports."""
