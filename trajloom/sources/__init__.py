"""Reading trajectory tables and writing training sets and metrics."""
