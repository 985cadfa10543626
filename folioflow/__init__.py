"""Document-layout analytics on Spark: characters, lines, blocks, cells, pages and documents as DataFrames."""
