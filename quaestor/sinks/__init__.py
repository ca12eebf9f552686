"""Writers: CSV tables for spreadsheets, backups, catalogue shards."""
