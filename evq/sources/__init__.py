"""Table specifications, typed ingestion, publishing and reading."""
