"""Row types, file markers and cutoffs."""

from __future__ import annotations

#: Fixed values of the file formats: first lines and column headers.
CALLS_PRAGMA = "###methylcf"
CONSENSUS_PRAGMA = "###cmethylcf"
POPULATION_PRAGMA = "##methylprf"
CALLS_HEADER = "#Contig\tPosition\tStrand\tMethylated\tTotal\tRatio"
POPULATION_HEADER = "#Contig\tPosition\tStrand\tRatio\tStandard Deviation"
SITE_HEADER = "Contig\tPosition\tStrand\tSample 1 Mean\tSample 2 Mean\tT Statistic\tP-value"
REGION_HEADER = "Id\tContig\tStart\tStop\tSample 1 Mean\tSample 2 Mean\tT Statistic\tP-value"
SUMMARY_HEADER = "Contig\tDepth\tMethylation Ratio"

#: File name by sequence context, and context by the letter of a methylation call.
CONTEXT_FILES = {
    "CpG": "CpG_context.tab",
    "CHG": "CHG_context.tab",
    "CHH": "CHH_context.tab",
    "CN_CHN": "CN_CHN_context.tab",
}
CONTEXT_LETTERS = {"H": "CHH", "X": "CHG", "Z": "CpG", "U": "CN_CHN"}

#: Depth from which a call counts for a population, and for a test; greatest p-value that is reported.
POPULATION_DEPTH = 5
TEST_DEPTH = 3
SIGNIFICANCE = 0.05

CALLS = "contig string, position int, strand string, methylated int, total int, ratio double"
CONSENSUS = "contig string, position int, strand string, ratio_mean double, ratio_variance double, sample_size int, total_depth int"
REGIONS = "id string, contig string, start int, stop int"
READS = "qname string, flag int, contig string, start int, cigar string, xm string, xg string, ordinal long"
