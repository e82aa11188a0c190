"""Reading and writing: record tables, id chains, the feature store."""
