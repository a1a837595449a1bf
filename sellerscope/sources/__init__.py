"""Sources and sinks: table loading, the listings fixture, folder catalog, writers."""
