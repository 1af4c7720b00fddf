"""DataFrame to DataFrame operators with explicit parameters."""
