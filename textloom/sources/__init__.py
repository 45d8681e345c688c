"""Parts of the engine: sources."""
