"""Sources and sinks: driver tables, article streams, page ingest, graph-event sinks."""
