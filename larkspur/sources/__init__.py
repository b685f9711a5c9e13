"""Ways in and out: files, pandas, dumps."""
