"""Search and analysis of time-aligned transcripts on Spark."""
