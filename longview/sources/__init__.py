"""Reading and writing: CSV trees, scenarios, catalogues, column mappings, sinks."""
