"""Readers of call, consensus, region and alignment files."""
