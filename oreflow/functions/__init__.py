"""Column-level functions; everything here stays inside generated code."""
