"""tagspace."""
