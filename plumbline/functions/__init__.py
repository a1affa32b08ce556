"""Native column functions and their fixed tables."""
