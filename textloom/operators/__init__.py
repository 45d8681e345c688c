"""Parts of the engine: operators."""
