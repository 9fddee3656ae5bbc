"""Set-based jobs over ledger tables: lookups, audit, strategy, catalog, screening."""
