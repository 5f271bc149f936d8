"""Operators: functions from DataFrames to DataFrames.

``calls`` frames have contig, position, strand, methylated, total, and where it matters
ratio, sample_id (the input's place in the argument list), condition and ordinal (the
row's place in its input).
"""
