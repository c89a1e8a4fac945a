"""Ready-made pipelines over energy-system result tables (DataFrames in, DataFrame out)."""
