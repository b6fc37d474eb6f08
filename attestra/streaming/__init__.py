"""No streaming operator: rows are exchangeable, and temporal columns are refused at ingest."""
