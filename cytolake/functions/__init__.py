"""Column functions: arithmetic with the semantics of IEEE 754, statistics, alignments."""
