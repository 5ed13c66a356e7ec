"""Reading and writing: tables, metric logs, source catalogues and packed shards."""
