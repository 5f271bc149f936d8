"""Per-cytosine counts from aligned reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alignments import blocks, context, is_methylated, operations, reference_length, strand
from ..functions.numeric import safe_div

UNMAPPED, PAIRED, MATE_UNMAPPED = 0x4, 0x1, 0x8
_READ = "struct<ordinal:bigint,flag:int,contig:string,start:int,cigar:string,xm:string,xg:string>"


#: Records in a block of the search for mates.
BLOCK = 8_192
#: Blocks in a group, and groups whose sums are carried on; together they hold some 10**13 records.
CARRY = 65_536


def pairs_up(flag: Column) -> Column:
    """A mapped read that is paired and has a mapped mate."""
    return (flag.bitwiseAND(PAIRED) != 0) & (flag.bitwiseAND(MATE_UNMAPPED) == 0) & (flag.bitwiseAND(UNMAPPED) == 0)


def has_pairs(reads: DataFrame) -> bool:
    """Whether any read can take a mate along. Ends at the first one; a file of single reads is scanned once for it."""
    return not reads.where(pairs_up(F.col("flag"))).limit(1).isEmpty()


def fragments(reads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(first, second): reads as single fragments, ``second`` null, or as pairs, the smaller start first.

    Pairing goes by adjacency in the file, as a scan would do it: a read that is paired and has a
    mapped mate takes the next record along if that has the same name; unmapped records that nothing
    takes are skipped. ``reads.ordinal`` numbers the records.

    In a stretch of records that could each take the next one along, every other one does, from its
    start on. So the number of the last record before that cannot is all that decides, and it is a running
    maximum. Records meet by blocks of their numbers, not by name, so no name is a hot key: each block sees
    the first record of the next one, and one number for each block is carried on."""
    record = F.struct("ordinal", "flag", "contig", "start", "cigar", "xm", "xg").cast(_READ)
    home = F.floor(F.col("ordinal") / F.lit(block)).cast("long")
    seen_by = F.when(F.col("ordinal") % block == 0, F.array(home, home - 1)).otherwise(F.array(home))
    placed = reads.select("ordinal", "qname", pairs_up(F.col("flag")).alias("_able"), record.alias("_read"), home.alias("_home"), F.explode(seen_by).alias("_block"))
    w = Window.partitionBy("_block").orderBy("ordinal")
    joins = F.col("_able") & (F.lead("qname").over(w) == F.col("qname")) & (F.lead("ordinal").over(w) == F.col("ordinal") + 1)
    ahead = placed.select("*", F.coalesce(joins, F.lit(False)).alias("_opens"), F.lead("_read").over(w).alias("_next"))
    stop = F.when(~F.col("_opens"), F.col("ordinal"))
    inside = ahead.withColumn("_stop", F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))).where("_block = _home")

    # the last record of earlier blocks that takes nothing along: one row for each block, in groups of blocks, and
    # one for each group; a window holds ``CARRY`` rows at most
    ends = ahead.where("_block = _home").groupBy("_block").agg(F.max(stop).alias("_last"), F.min("ordinal").alias("_least"))
    ends = ends.withColumn("_group", F.floor(F.col("_block") / CARRY))
    earlier = lambda key, top: Window.partitionBy(top).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own, over = earlier("_block", "_group"), earlier("_group", F.floor(F.col("_group") / CARRY))
    groups = ends.groupBy("_group").agg(F.max("_last").alias("_glast"), F.min("_least").alias("_gleast"))
    groups = groups.select("_group", F.max("_glast").over(over).alias("_glast"), F.min("_gleast").over(over).alias("_gleast"))
    blocks_ = ends.select("_block", "_group", "_least", F.max("_last").over(own).alias("_before"), F.min("_least").over(own).alias("_first"))
    carried = blocks_.join(groups, "_group").select(
        "_block", F.coalesce("_before", "_glast", F.least("_least", "_first", "_gleast") - 1).alias("_carried")
    )
    known = inside.join(carried, "_block").withColumn("_gap", F.col("ordinal") - F.coalesce("_stop", "_carried"))

    taken = (F.col("_gap") > 1) & (F.col("_gap") % 2 == 0)
    pair = F.col("_opens") & (F.col("_gap") % 2 == 1)
    swap = pair & (F.col("_read.start") > F.col("_next.start"))
    kept = known.where(~taken & (pair | (F.col("_read.flag").bitwiseAND(UNMAPPED) == 0)))
    made = F.struct(
        F.when(swap, F.col("_next")).otherwise(F.col("_read")).alias("first"),
        F.when(swap, F.col("_read")).when(pair, F.col("_next")).alias("second"),
    )
    return kept.select(F.inline(F.array(made)))  # made once, not again for each field that is read of it


def fragment_calls(frags: DataFrame) -> DataFrame:
    """(contig, position, strand, call): the calls of fragments. In a pair the first read gives contig and
    strand, and as many reference positions as the reads overlap are dropped from the second's start."""
    f, s = F.col("first"), F.col("second")
    ops = frags.select(
        f["contig"].alias("contig"), strand(f["xg"]).alias("strand"), f["start"].alias("s1"), f["xm"].alias("x1"), operations(f["cigar"]).alias("o1"),
        s["start"].alias("s2"), s["xm"].alias("x2"), F.when(s.isNotNull(), operations(s["cigar"])).alias("o2"),
    )
    overlap = F.greatest(F.lit(0), F.col("s1") + reference_length(F.col("o1")) - F.col("s2"))

    def parts(xm: str, ops: str, start: str, least: Column) -> Column:
        """An aligned stretch each: its calls, the position of the first, and the least position that counts."""
        made = F.transform(blocks(F.col(ops), F.col(start)), lambda b: F.struct(
            F.substr(F.col(xm), b["first"] + 1, b["last"] - b["first"] + 1).alias("calls"), b["position"].alias("position"), least.cast("int").alias("least")
        ))
        return F.when(F.col(xm).isNotNull() & F.col(ops).isNotNull(), made).otherwise(F.array().cast("array<struct<calls:string,position:int,least:int>>"))

    both = F.concat(parts("x1", "o1", "s1", F.col("s1")), parts("x2", "o2", "s2", F.col("s2") + overlap))
    each = ops.select("contig", "strand", F.inline(both))
    bases = each.select("contig", "strand", "position", "least", F.posexplode(F.split("calls", "")).alias("at", "call")).where("call not in ('.', '')")
    return bases.where("position + at >= least").select("contig", (F.col("position") + F.col("at")).alias("position"), "strand", "call")


def single_fragments(reads: DataFrame) -> DataFrame:
    """Every mapped read as a fragment of its own."""
    record = F.struct("ordinal", "flag", "contig", "start", "cigar", "xm", "xg").cast(_READ)
    return reads.where(F.col("flag").bitwiseAND(UNMAPPED) == 0).select(record.alias("first"), F.lit(None).cast(_READ).alias("second"))


def count_calls(calls: DataFrame) -> DataFrame:
    """(context, contig, position, strand, methylated, total), aggregated before and after the shuffle."""
    return (
        calls.select(context(F.col("call")).alias("context"), "contig", "position", "strand", is_methylated(F.col("call")).alias("m"))
        .groupBy("context", "contig", "position", "strand")
        .agg(F.sum("m").alias("methylated"), F.count("*").alias("total"))
    )


def extract(reads: DataFrame, paired: bool = True) -> DataFrame:
    """Counts by context and cytosine from reads; ``paired=False`` skips the search for mates."""
    return count_calls(fragment_calls(fragments(reads) if paired else single_fragments(reads)))


def extract_summary(counts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(contig, depth, methylation_ratio, contig_order): mean depth and share of methylated reads over the
    sites of all contexts, one row for each contig of the dictionary, NaN without sites, and one named All."""
    sums = counts.rollup("contig").agg(
        F.sum("total").alias("t"), F.sum("methylated").alias("m"), F.count("*").alias("n"), F.grouping("contig").alias("g")
    )
    total = F.struct(F.lit("All").alias("contig"), F.lit(None).cast("int").alias("contig_order"), F.lit(1).alias("g"))
    own = F.struct(F.col("contig"), F.col("contig_order"), F.lit(0).alias("g"))
    rows = dictionary.select(own.alias("r")).select("r.*").unionByName(
        dictionary.limit(1).select(total.alias("r")).select("r.*")
    )
    joined = rows.alias("d").join(sums.alias("s"), (F.col("d.g") == F.col("s.g")) & ((F.col("d.g") == 1) | (F.col("d.contig") == F.col("s.contig"))), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("d.contig", safe_div(zero("t"), zero("n")).alias("depth"), safe_div(zero("m"), zero("t")).alias("methylation_ratio"), "d.contig_order")
