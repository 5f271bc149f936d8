"""The five verbs: sources, operators and sinks put together."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from ..operators import calls as C
from ..operators import differential as D
from ..operators import extract as X
from ..operators import sites as S
from ..schema import POPULATION_DEPTH
from ..sinks import write_calls, write_contexts, write_population, write_regions, write_sites, write_summary
from ..sources.alignments import open_alignments
from ..sources.files import read_calls, read_regions, read_samples
from ..sources.sites import alignable, call_files, contig_ranges, read_sites, region_ranges


def extract(spark: SparkSession, source: str, folder: str, controls: tuple[str, ...] = ()) -> None:
    """Alignments to four context files and summary.tab in ``folder``. Files of single reads need no search
    for mates, so their reads are not shuffled."""
    found = open_alignments(spark, source, controls)
    dictionary = found.dictionary
    # the search for mates reads the records several times, each time other columns, and they are decoded once for all
    reads = found.reads.persist(StorageLevel.DISK_ONLY) if found.paired else found.reads
    counts = X.extract(reads, found.paired).cache()  # two outputs read it
    try:
        write_contexts(counts, folder, dictionary)
        write_summary(X.extract_summary(counts, dictionary.frame(spark)), f"{folder}/summary.tab")
    finally:
        counts.unpersist()
        if found.paired:
            reads.unpersist()


def _aligned(spark: SparkSession, sources: list[str], unsorted: bool) -> bool:
    """Whether the inputs can be read side by side, so that no call is shuffled or sorted."""
    return not unsorted and bool(sources) and alignable(spark, sources)


def merge(spark: SparkSession, sources: list[str], target: str, unsorted: bool = False) -> None:
    """Counts of call files added up. Files in genome order that tasks can open are merged as streams, a piece of the
    genome each, and written as they come; compressed ones and, if told, ``unsorted`` ones go through a shuffle."""
    if _aligned(spark, sources, unsorted):
        files = call_files(spark, sources)
        write_calls(S.merge_sites(read_sites(spark, files)), target, files.dictionary, sorted_=True)
        return
    calls, dictionary = read_samples(spark, sources)
    write_calls(C.merge_calls(C.with_contigs(calls, dictionary.frame(spark))), target, dictionary)


def call(spark: SparkSession, source: str, target: str, error: float = 0.0, unsorted: bool = False) -> None:
    """Ratios corrected by the control contigs, which come first in a sorted file: these are read for the rate, and
    then the rest for its calls."""
    if _aligned(spark, [source], unsorted):
        files = call_files(spark, [source])
        held = set(files.dictionary.controls)
        wild = {c for c, _ in files.dictionary.contigs} - held
        rate = S.control_error_rate(read_sites(spark, files, ranges=contig_ranges(files, held)), error)
        called = S.consensus_sites(read_sites(spark, files, ranges=contig_ranges(files, wild)), rate)
        write_calls(called, target, files.dictionary, sorted_=True)
        return
    calls, dictionary = read_calls(spark, source)
    write_calls(C.consensus_call(calls, dictionary.frame(spark), error), target, dictionary)


def population_call(spark: SparkSession, sources: list[str], target: str, cutoff: int = POPULATION_DEPTH, unsorted: bool = False) -> None:
    if _aligned(spark, sources, unsorted):
        files = call_files(spark, sources)
        write_population(S.population_sites(read_sites(spark, files), cutoff), target, files.dictionary, sorted_=True)
        return
    calls, dictionary = read_samples(spark, sources)
    write_population(C.population_call(C.with_contigs(calls, dictionary.frame(spark)), cutoff), target, dictionary)


def diff(spark: SparkSession, sources: list[str], target: str, conditions: list[int], regions: str | None = None, unsorted: bool = False) -> None:
    """Significant sites, or, with a region file, all regions. Of sorted files only the bytes near regions are read."""
    if _aligned(spark, sources, unsorted):
        files = call_files(spark, sources, conditions)
        if regions is None:
            write_sites(S.differential_over_sites(read_sites(spark, files)), target, files.dictionary, sorted_=True)
            return
        asked = read_regions(spark, regions)
        known = S.site_calls(read_sites(spark, files, ranges=region_ranges(spark, files, asked)))
        write_regions(D.differential_regions(known, asked, files.dictionary.frame(spark)), target, files.dictionary)
        return
    calls, dictionary = read_samples(spark, sources, conditions)
    known = C.with_contigs(calls, dictionary.frame(spark))
    if regions is None:
        write_sites(D.differential_sites(known), target, dictionary)
    else:
        write_regions(D.differential_regions(known, read_regions(spark, regions), dictionary.frame(spark)), target, dictionary)
