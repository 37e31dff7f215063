"""Content chunking, deduplication, packet framing, restoration and routing over Spark DataFrames."""
