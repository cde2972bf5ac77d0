"""Pull-based reading of tables chunk by chunk."""
