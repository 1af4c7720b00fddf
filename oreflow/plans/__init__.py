"""Jobs composed of sources and operators."""
