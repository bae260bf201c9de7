"""Sources: landed tables, test-table projections, log/metric store responses, files."""
