"""Where tables live: Parquet snapshots named by manifests, and read-only Parquet files."""
