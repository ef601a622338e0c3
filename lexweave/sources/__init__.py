"""Tables in and out: Parquet, text, CSV, JSON, segmented text, models and projector files."""
