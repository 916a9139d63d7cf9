"""Where tables come from: catalogue, Parquet folders, tab-separated extracts, the sample star schema."""
