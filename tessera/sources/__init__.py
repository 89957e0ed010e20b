"""Tables in and out: delimited files, Parquet stages, ordered result files."""
