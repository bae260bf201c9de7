"""Sinks: partitioned CSV/JSON/text writers and their readers."""
