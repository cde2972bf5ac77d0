"""Tables on disk, CSV ingest and sample data."""
