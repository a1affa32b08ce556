"""Readers: inventories, truth tables, file listings, templates, logs."""
