"""longview: scenario comparison over long-format tables, as lazy Spark DataFrames."""
