"""Whole queries: the five verbs over files, and the registered queries over the driver tables."""
