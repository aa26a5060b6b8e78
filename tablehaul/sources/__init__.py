"""Where tables come from: parquet folders, JDBC, pinned snapshots, a keyset stream."""
