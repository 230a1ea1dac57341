"""Explicit schemas of the inputs; nothing is inferred."""

from __future__ import annotations

LEDGER_FIELDS = [
    "job_id", "input_size", "mem_default", "min_default", "mem_alloc", "min_alloc",
    "mem_used", "min_used", "status", "user_name", "sacct_mem", "program", "ref",
    "flag", "core", "extra_mem", "extra_time", "ratio_mem", "ratio_time",
    "date_text", "epoch",
]
LEDGER_LONGS = [
    "job_id", "mem_default", "min_default", "mem_alloc", "min_alloc", "mem_used",
    "min_used", "sacct_mem", "core", "extra_mem", "extra_time", "epoch",
]
LEDGER_DOUBLES = ["ratio_mem", "ratio_time"]

# every ledger field arrives as text; types are applied with try_cast
LEDGER_TEXT = ", ".join(f"{f} string" for f in LEDGER_FIELDS)

ACCOUNTING_FIELDS = [
    "nodes", "user_name", "max_rss", "elapsed", "ncpus", "total_cpu", "time_limit", "tres",
]
ACCOUNTING_TEXT = ", ".join(f"{f} string" for f in ACCOUNTING_FIELDS)

BED6 = "chrom string, start_pos bigint, end_pos bigint, score double, l2fc double, strand string"
BEDGRAPH = "chrom string, start_pos bigint, end_pos bigint, value double"

SAMPLE_SHEET = "grp string, sample string, library string, lane string, path string, read1 string, read2 string"
PROSEQ_SHEET = (
    "sample_name string, name string, grp string, genome_ref string, genome_spike string, owner string,"
    " cell_type string, analysis_type string, tss_list string, out_dir string, file_r1 string, file_r2 string"
)
RNASEQ_MANIFEST = "read1 string, read2 string, sample string, condition string"

TASK_PROPERTIES = "rule string, groupid string, threads bigint, input array<string>"
