"""Sources, sinks and shared-folder tables."""
