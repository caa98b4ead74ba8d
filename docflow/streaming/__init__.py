"""docflow.streaming."""
