"""Sources, sinks and stored stages."""
