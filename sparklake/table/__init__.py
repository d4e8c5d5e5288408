"""The event table: Parquet files under a log of snapshots."""
