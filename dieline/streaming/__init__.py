"""Files that arrive while a query runs, and records of files that still grow: see ingest."""
