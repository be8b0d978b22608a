"""Sources, sinks and schemas."""
