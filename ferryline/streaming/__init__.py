"""The incremental load on arriving files."""
