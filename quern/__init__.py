"""Web-corpus analytics on Spark."""
