"""Sources: parquet tables, line files, histories, pages."""
