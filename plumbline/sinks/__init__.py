"""Writers and report renderers."""
