"""sources and sinks of the engine: count matrices, delimited tables, series records, catalogs, token shards."""
