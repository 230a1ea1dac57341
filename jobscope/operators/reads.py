"""Read-level operators of the sequencing workflows.

reads: qname, flag, rname, pos, last_pos (last aligned position) and any
other columns. Flag bits as in the SAM format.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.functions.jobs import umi_of
from jobscope.scale import HOT_ROWS, Running, grouped_scan, hot_from_counts, one_value, skew_join
from jobscope.session import as_written

# fixed values: SAM flag bits
PROPER, UNMAPPED, REVERSE, FIRST, SECOND, DUPLICATE = 0x2, 0x4, 0x10, 0x40, 0x80, 0x400


def has_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == bits


def flag_filter(df: DataFrame, require: int = 0, exclude: int = 0) -> DataFrame:
    """Keep rows with all required bits and none of the excluded ones."""
    flag = F.col("flag")
    return df.filter(has_bits(flag, require) & (flag.bitwiseAND(F.lit(exclude)) == 0))


def _numbered(n: int) -> list[str]:
    return [f"chr{i}" for i in range(1, n + 1)]


# fixed values: chromosomes kept per genome
GENOME_CHROMS = {
    "hg38": [*_numbered(22), "chrX", "chrY"],
    "hg19": [*_numbered(22), "chrX", "chrY"],
    "mm39": [*_numbered(19), "chrX", "chrY"],
    "mm10": [*_numbered(19), "chrX", "chrY"],
    "mm9": [*_numbered(19), "chrX", "chrY"],
    "dm6": ["2L", "2R", "3L", "3R", "4", "X", "Y"],
    "dm3": ["2L", "2R", "3L", "3R", "4", "X"],
    "pJBmix1": ["pJB"],
    "XL9_2": [
        "chr1L", "chr2L", "chr1S", "chr2S", "chr5L", "chr6L", "chr3L", "chr4L", "chr5S", "chr6S",
        "chr7L", "chr4S", "chr3S", "chr8L", "chr9_10L", "chr9_10S", "chr8S", "chr7S",
    ],
    "bosTau9": [*_numbered(29), "chrX"],
    "hg38Akata": [*_numbered(22), "chrX", "chrY", "LN824208.1"],
    "hg38hsv17": [*_numbered(22), "chrX", "chrY", "NC_001806.2"],
    "canFam4": [*_numbered(38), "chrX"],
}


def genome_table(spark) -> DataFrame:
    """(genome, rname) rows of the fixed list; fewer than 400."""
    rows = [(g, c) for g, cs in GENOME_CHROMS.items() for c in cs]
    return spark.createDataFrame(rows, "genome string, rname string")


def region_filter(reads: DataFrame, genomes: DataFrame) -> DataFrame:
    """Alignments on a listed chromosome of their genome; reads need ``genome``."""
    return reads.join(genomes, ["genome", "rname"], "left_semi")


def _mates(reads: DataFrame, hot_rows: int) -> tuple[DataFrame, list[str]]:
    """A row for the k-th first mate (_r1) and the k-th second mate (_r2) of each key; the columns besides the read name.

    A key is the sample (if there is one), the read name and, where the mate's
    place is known (``rnext``, ``mate_pos``), the two places of the pair. Both mates are numbered
    in one scan, by place within a key.
    """
    keys = [c for c in ("sample", "qname") if c in reads.columns]
    body = [c for c in reads.columns if c != "qname"]
    flag = F.col("flag")
    mates = F.array_compact(F.array(F.when(has_bits(flag, FIRST), 1), F.when(has_bits(flag, SECOND), 2)))
    columns = [*[F.col(c) for c in keys], F.col("rname").alias("_c"), F.col("pos").alias("_p"), F.col("flag").alias("_f"), F.struct(*body).alias("_row"), F.explode(mates).alias("_mate")]
    if {"rnext", "mate_pos"} <= set(reads.columns):
        own = F.struct(F.col("rname").alias("c"), F.col("pos").alias("p"))
        other = F.struct(F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext")).alias("c"), F.col("mate_pos").alias("p"))
        columns.append(F.when(has_bits(flag, FIRST), F.struct(own.alias("a"), other.alias("b"))).otherwise(F.struct(other.alias("a"), own.alias("b"))).alias("_places"))
        keys.append("_places")
    first = F.col("_mate") == 1
    numbered = grouped_scan(
        reads.select(*columns), keys, ["_c", "_p", "_f", "_row", "_mate"],
        {"_n1": Running("sum", first.cast("bigint")), "_n2": Running("sum", (~first).cast("bigint"))}, hot_rows,
    )
    # grouped by more than the keys it lies by already: no further shuffle without hot keys
    return numbered.groupBy(*keys, F.when(first, F.col("_n1")).otherwise(F.col("_n2")).alias("_k")).agg(
        F.max(F.when(first, F.col("_row"))).alias("_r1"), F.max(F.when(~first, F.col("_row"))).alias("_r2")
    ), body


def pair_mates(reads: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per pair with the first mate in r1_* and the second in r2_*.

    All pairs of a read name are kept: the k-th first mate of a key goes with
    the k-th second one, in order of place. What has no partner is in ``orphans``.
    """
    mates, body = _mates(reads, hot_rows)
    return mates.filter("_r1 is not null and _r2 is not null").select(
        "qname", *[F.col(f"_{r}.{c}").alias(f"{r}_{c}") for r in ("r1", "r2") for c in body]
    )


def orphans(reads: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mates without a partner, and records that are neither first nor second mate; columns as they came."""
    mates, body = _mates(reads, hot_rows)
    single = mates.filter("_r1 is null or _r2 is null").withColumn("_row", F.coalesce("_r1", "_r2"))
    alone = single.select("qname", *[F.col(f"_row.{c}").alias(c) for c in body]).select(*reads.columns)
    neither = reads.filter(~has_bits(F.col("flag"), FIRST) & ~has_bits(F.col("flag"), SECOND))
    return alone.unionByName(neither)


def _mapped(mate: str) -> Column:
    return ~has_bits(F.col(f"{mate}_flag"), UNMAPPED)


def _stranded_start(mate: str) -> Column:
    return F.when(has_bits(F.col(f"{mate}_flag"), REVERSE), F.col(f"{mate}_last_pos")).otherwise(F.col(f"{mate}_pos"))


COLLAPSE_KEY = ["rname", "start", "stop", "strand", "umi"]


def usable_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs mapped to one chromosome, with the columns of the collapse key."""
    return pairs.filter(_mapped("r1") & _mapped("r2") & (F.col("r1_rname") == F.col("r2_rname"))).withColumns(
        {
            "rname": F.col("r1_rname"),
            "start": _stranded_start("r1"),
            "stop": _stranded_start("r2"),
            "strand": F.when(has_bits(F.col("r1_flag"), REVERSE), "-").otherwise("+"),
            "umi": umi_of(F.col("qname")),
        }
    )


def barcode_collapse(pairs: DataFrame) -> DataFrame:
    """One pair per position, strand and UMI: the first by read name."""
    usable = usable_pairs(pairs)
    return (
        usable.groupBy(*COLLAPSE_KEY)
        .agg(F.min_by(F.struct(*pairs.columns), "qname").alias("_p"))
        .select(*COLLAPSE_KEY, "_p.*")
    )


def collapse_metrics(pairs: DataFrame) -> DataFrame:
    """Total and removed pairs per UMI."""
    return (
        usable_pairs(pairs)
        .groupBy(*COLLAPSE_KEY)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("umi")
        .agg(F.sum("_n").alias("total_count"), F.sum(F.col("_n") - 1).alias("removed_count"))
    )


def dropped_pairs(pairs: DataFrame) -> DataFrame:
    """Counters of pairs that never reach the collapse."""
    one, both = _mapped("r1") != _mapped("r2"), _mapped("r1") & _mapped("r2")
    return pairs.agg(
        F.count_if(one).alias("unmapped_mate"),
        F.count_if(both & (F.col("r1_rname") != F.col("r2_rname"))).alias("different_chroms"),
    )


def mapped_counts(reads: DataFrame, chrom_m: str = "chrM") -> DataFrame:
    """Mapped reads, pairs and mitochondrial reads per sample."""
    mapped = ~has_bits(F.col("flag"), UNMAPPED)
    return reads.groupBy("sample").agg(
        F.count_if(mapped).alias("mapped"),
        F.bround(F.count_if(mapped) / 2, 0).cast("bigint").alias("pairs"),
        F.count_if(F.col("rname") == chrom_m).alias("chr_m"),
    )


def _pct(a: Column, b: Column) -> Column:
    return F.round(a / F.when(b != 0, b) * 100, 2)


def sample_qc(counts: DataFrame, dedup: bool = True) -> DataFrame:
    """Quality table of samples.

    counts: sample, total, trim, spike, spike_dedup, ref, ref_dedup, tss, mean_insert.
    """
    c = F.col
    spike, ref = (c("spike_dedup"), c("ref_dedup")) if dedup else (c("spike"), c("ref"))
    cols = [
        c("sample"), c("trim"), _pct(c("trim"), c("total")).alias("trim_pct"),
        spike.alias("spike_n"), _pct(spike, c("trim")).alias("spike_pct"),
        ref.alias("ref_n"), _pct(ref, c("trim")).alias("ref_pct"),
        c("tss"), _pct(c("tss"), ref).alias("tss_pct"),
        F.round("mean_insert", 0).cast("bigint").alias("insert_size"),
    ]
    if dedup:
        cols += [
            F.round((1 - c("spike_dedup") / F.when(c("spike") != 0, c("spike"))) * 100, 2).alias("spike_dedup_pct"),
            F.round((1 - c("ref_dedup") / F.when(c("ref") != 0, c("ref"))) * 100, 2).alias("ref_dedup_pct"),
        ]
    return counts.select(*cols)


# fixed values: report headers
QC_HEADER = {
    "sample": "Sample", "trim": "Trim #", "trim_pct": "Trim %", "spike_n": "Spike #", "spike_pct": "Spike %",
    "ref_n": "Ref #", "ref_pct": "Ref %", "tss": "TSS #", "tss_pct": "TSS %", "insert_size": "Insert",
    "spike_dedup_pct": "Spike dedup %", "ref_dedup_pct": "Ref dedup %",
}


def merge_qc(stats: Sequence[DataFrame], header: bool = False) -> DataFrame:
    """Per-sample rows of several tables in one, under report names if asked."""
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.withColumnsRenamed(QC_HEADER) if header else out


def insert_size(pairs: DataFrame) -> DataFrame:
    """Insert sizes per sample: histogram rows with the sample's mean.

    Both come from the counts per size, not from the pairs again.
    """
    lo = F.least("r1_pos", "r2_pos")
    hi = F.greatest("r1_last_pos", "r2_last_pos")
    counts = (
        pairs.filter(has_bits(F.col("r1_flag"), PROPER))
        .groupBy("sample", (hi - lo + 1).alias("size"))
        .agg(F.count(F.lit(1)).alias("pairs"))
    )
    mean = counts.groupBy("sample").agg(
        (F.sum(F.col("size") * F.col("pairs")) / F.sum("pairs")).alias("mean_insert")
    )
    return counts.join(mean, ["sample"])


def sort_alignments(reads: DataFrame, by: str = "coordinate") -> DataFrame:
    """Globally sorted rows; names break ties so one position can span partitions."""
    keys = {
        "coordinate": ["rname", "pos", "qname", "flag"],
        "name": ["qname", "flag", "rname", "pos"],
        "bedgraph": ["chrom", "start_pos", "end_pos"],
        "id": ["id", "ordinal"],
    }[by]
    return reads.repartitionByRange(*keys).sortWithinPartitions(*keys)


def sorted_positions(rows: DataFrame) -> DataFrame:
    """Rows of a sorted frame with ``position``, their place from 1 in the whole order.

    The rows are written once, as a second sort might cut its partitions elsewhere; then only
    a count per partition is added up.
    """
    part = F.shiftright(F.col("_id"), 33)
    placed = as_written(rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", part), "sorted")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return placed.join(as_written(starts, "starts"), ["_part"]).withColumn("position", F.col("_start") + inside + 1).drop("_id", "_part", "_start")


def merge_alignments(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def fastq_head(records: DataFrame, n: int) -> DataFrame:
    """First n reads of each file (ordinal starts at 0)."""
    return records.filter(F.col("ordinal") < n)


def fastq_split(records: DataFrame, k: int = 2, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cut each file into k runs of equal length; mates stay in the same part.

    The length is the number of reads div k; what is left over forms one more
    part, as cutting a file by a fixed number of lines does.
    """
    sizes = as_written(records.groupBy("file").agg((F.max("ordinal") + 1).alias("_n")))
    hot = hot_from_counts(sizes, hot_rows)
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    return (
        skew_join(records, sizes, ["file"], spread=["ordinal"], hot=hot)
        .withColumn("part", F.floor(F.col("ordinal") / size).cast("bigint"))
        .drop("_n")
    )


# fixed values: inline barcodes at the 5' end of the first read
BARCODES = [
    ("A01", "ATTGCTTAGATCGGAAGAGCGTCGTGT"),
    ("B06", "ACAAGCCAGATCGGAAGAGCGTCGTGT"),
    ("C01", "AACTTGTAGATCGGAAGAGCGTCGTGT"),
    ("D8f", "AGGACCAAGATCGGAAGAGCGTCGTGT"),
    ("A03", "ANNNNGGTCATAGATCGGAAGAGCGTCGTGT"),
    ("G07", "ANNNNACAGGAAGATCGGAAGAGCGTCGTGT"),
    ("A04", "ANNNNAAGCTGAGATCGGAAGAGCGTCGTGT"),
    ("F05", "ANNNNGTATCCAGATCGGAAGAGCGTCGTGT"),
    ("NIL", "AGATCGGAAGAGCGTCGTGT"),
]


def barcode_demux(reads: DataFrame, barcodes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Barcode of each read: the longest barcode that is a prefix, N matching any base.

    barcodes: barcode, sequence. A barcode's shape is its length and its places of N. The distinct
    prefixes of the reads, as long as the longest barcode, are tried in every shape (few,
    however many barcodes or reads) and meet the barcodes in one join on (shape, masked prefix); what they find
    goes back to the reads by prefix, a frequent one spread over several tasks.
    """
    shape = F.regexp_replace("sequence", "[^N]", "-")
    order = F.struct((-F.char_length(shape)).alias("n"), F.regexp_count(shape, F.lit("N")).alias("m"), shape.alias("_shape"))
    shapes = one_value(barcodes, F.sort_array(F.collect_set(order)))
    longest = F.coalesce(one_value(barcodes, F.max(F.char_length("sequence"))), F.lit(0))
    named = reads.withColumn("_longest", longest).withColumn("_prefix", F.substr("seq", F.lit(1), F.col("_longest"))).drop("_longest")
    tried = named.select("_prefix").filter(F.col("_prefix").isNotNull()).distinct().withColumn("_shapes", shapes).select("_prefix", F.posexplode("_shapes").alias("_rank", "_one"))
    size = F.char_length("_one._shape")
    masked = F.array_join(
        F.zip_with(F.split(F.substr("_prefix", F.lit(1), size), ""), F.split("_one._shape", ""), lambda c, s: F.when(s == "N", s).otherwise(c)), ""
    )
    keys = barcodes.groupBy(shape.alias("_shape"), F.col("sequence").alias("_key")).agg(F.min("barcode").alias("barcode"))
    found = (
        tried.select("_prefix", "_rank", F.col("_one._shape").alias("_shape"), F.when(size == 0, F.lit("")).otherwise(masked).alias("_key"))
        .join(as_written(keys, "barcodes"), ["_shape", "_key"])
        .groupBy("_prefix").agg(F.min_by("barcode", "_rank").alias("_found"))
    )
    back = skew_join(named, as_written(found, "prefixes"), ["_prefix"], "left", hot_rows=hot_rows)
    return back.withColumn("barcode", F.coalesce("_found", F.lit("unassigned"))).select(*reads.columns, "barcode")
