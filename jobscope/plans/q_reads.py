"""Reads, pairs and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.operators import intervals as iv, reads as rd
from jobscope.plans.registry import query, r6
from jobscope.plans.views import Tables
from jobscope.scale import Running, grouped_scan


def mates(t: Tables):
    """Two alignment rows per fragment, as read_sam gives them."""
    up = F.col("strand") == "+"

    def bits(first: bool):
        own, other = ("mapped", "mate_mapped") if first else ("mate_mapped", "mapped")
        flag = F.lit(1 + (rd.FIRST if first else rd.SECOND))
        flag = flag + F.when(F.col("mapped") & F.col("mate_mapped") & (F.col("rname") == F.col("mate_rname")), rd.PROPER).otherwise(0)
        flag = flag + F.when(F.col(own), 0).otherwise(rd.UNMAPPED) + F.when(F.col(other), 0).otherwise(8)
        return (flag + F.when(~up if first else up, rd.REVERSE).otherwise(0)).cast("int")

    one = F.struct(bits(True).alias("flag"), F.col("rname").alias("rname"), F.col("pos").alias("pos"), (F.col("pos") + 49).alias("last_pos"))
    two = F.struct(bits(False).alias("flag"), F.col("mate_rname").alias("rname"), F.col("mate_pos").alias("pos"), (F.col("mate_pos") + 49).alias("last_pos"))
    return t.reads.select("qname", "sample", F.explode(F.array(one, two)).alias("m")).select("qname", "sample", "m.*")


def pairs(t: Tables):
    return rd.pair_mates(mates(t)).withColumnRenamed("r1_sample", "sample").drop("r2_sample")


# the fragments as pairs in the other engine
PAIRS = """pr as (select qname, sample, rname, mate_rname, pos, mate_pos, strand, mapped, mate_mapped, split_part(qname, ':', 1) as umi,
      case when strand = '-' then pos + 49 else pos end as start, case when strand = '+' then mate_pos + 49 else mate_pos end as stop from reads),
    us as (select * from pr where mapped and mate_mapped and rname = mate_rname)"""


@query("""
    select qname, 'first' as mate, pos from reads where mapped
    union all select qname, 'second', mate_pos from reads where mate_mapped""")
def flag_filter(t):
    first = rd.flag_filter(mates(t), rd.FIRST, rd.UNMAPPED).select("qname", F.lit("first").alias("mate"), "pos")
    return first.unionByName(rd.flag_filter(mates(t), rd.SECOND, rd.UNMAPPED).select("qname", F.lit("second").alias("mate"), "pos"))


@query("""
    select qname, case when event_type = 'view' then 'mm9' else 'hg38' end as genome, mate_rname as rname from reads
    where mate_rname <> 'chrM'""")
def region_filter(t):
    rows = t.reads.select("qname", F.when(F.col("event_type") == "view", "mm9").otherwise("hg38").alias("genome"), F.col("mate_rname").alias("rname"))
    return rd.region_filter(rows, rd.genome_table(t.spark)).select("qname", "genome", "rname")


@query("select qname, rname as r1_rname, pos as r1_pos, mate_rname as r2_rname, mate_pos as r2_pos from reads")
def pair_mates(t):
    return pairs(t).select("qname", "r1_rname", "r1_pos", "r2_rname", "r2_pos")


@query("select sample, count(*) as n_orphans from reads where mapped <> mate_mapped group by sample")
def orphan_mates(t):
    mapped = rd.flag_filter(mates(t), exclude=rd.UNMAPPED)
    return rd.orphans(mapped).groupBy("sample").agg(F.count(F.lit(1)).alias("n_orphans"))


@query(f"with {PAIRS} select rname, start, stop, strand, umi, min(qname) as qname from us group by rname, start, stop, strand, umi")
def barcode_collapse(t):
    return rd.barcode_collapse(pairs(t)).select("rname", "start", "stop", "strand", "umi", "qname")


@query(f"""
    with {PAIRS} select umi, count(*) as total_count, count(*) - count(distinct (rname, start, stop, strand)) as removed_count from us group by umi""")
def collapse_metrics(t):
    return rd.collapse_metrics(pairs(t))


@query(f"""
    with {PAIRS} select count(*) filter (where mapped <> mate_mapped) as unmapped_mate,
     count(*) filter (where mapped and mate_mapped and rname <> mate_rname) as different_chroms from pr""")
def dropped_pairs(t):
    return rd.dropped_pairs(pairs(t))


ALL_MATES = """mt as (select sample, mapped as m, rname from reads union all select sample, mate_mapped, mate_rname from reads)"""


@query(f"""
    with {ALL_MATES} select sample, count(*) filter (where m) as mapped, cast(round_even(count(*) filter (where m) / 2.0, 0) as bigint) as pairs,
     count(*) filter (where rname = 'chrM') as chr_m from mt group by sample""")
def mapped_counts(t):
    return rd.mapped_counts(mates(t))


def _counts(t):
    """Counters of each sample as the quality table needs them."""
    used = rd.usable_pairs(pairs(t))
    kept = used.groupBy("sample", *rd.COLLAPSE_KEY).agg(F.count(F.lit(1)).alias("n"))
    spike = F.col("rname") == "chr5"
    per = kept.groupBy("sample").agg(
        F.sum(F.when(spike, F.col("n")).otherwise(0)).alias("spike"),
        F.count_if(spike).alias("spike_dedup"),
        F.sum(F.when(~spike, F.col("n")).otherwise(0)).alias("ref"),
        F.count_if(~spike).alias("ref_dedup"),
        F.count_if(~spike & (F.col("start") < 300)).alias("tss"),
    )
    total = t.reads.groupBy("sample").agg(F.count(F.lit(1)).alias("total"), F.count_if("mapped").alias("trim"))
    mean = rd.insert_size(pairs(t)).select("sample", "mean_insert").distinct()
    return per.join(total, ["sample"]).join(mean, ["sample"])


QC = f"""{PAIRS}, kept as (select sample, rname, start, stop, strand, umi, count(*) as n from us group by all),
    per as (select sample, sum(case when rname = 'chr5' then n else 0 end) as spike, count(*) filter (where rname = 'chr5') as spike_dedup,
      sum(case when rname <> 'chr5' then n else 0 end) as ref, count(*) filter (where rname <> 'chr5') as ref_dedup,
      count(*) filter (where rname <> 'chr5' and start < 300) as tss from kept group by sample),
    tot as (select sample, count(*) as total, count(*) filter (where mapped) as trim from reads group by sample),
    ins as (select sample, avg(mate_pos + 49 - pos + 1) as mean_insert from us group by sample),
    cn as (select * from per join tot using (sample) join ins using (sample))"""


@query(f"""
    with {QC} select sample, trim, round(trim / total * 100, 2) as trim_pct, spike_dedup as spike_n, round(spike_dedup / trim * 100, 2) as spike_pct,
     ref_dedup as ref_n, round(ref_dedup / trim * 100, 2) as ref_pct, tss, round(tss / ref_dedup * 100, 2) as tss_pct, cast(round(mean_insert) as bigint) as insert_size,
     round((1 - spike_dedup / nullif(spike, 0)) * 100, 2) as spike_dedup_pct, round((1 - ref_dedup / ref) * 100, 2) as ref_dedup_pct from cn""")
def sample_qc(t):
    return rd.sample_qc(_counts(t))


@query(f"""
    with {QC} select sample, trim, spike_dedup as spike_n, ref_dedup as ref_n, round((1 - ref_dedup / ref) * 100, 2) as ref_dedup_pct from cn
    union all select concat(sample, '_all'), trim, cast(spike as bigint), cast(ref as bigint), null from cn""")
def merge_qc(t):
    counts = _counts(t)
    plain = rd.sample_qc(counts.withColumn("sample", F.concat("sample", F.lit("_all"))), dedup=False)
    return rd.merge_qc([rd.sample_qc(counts), plain]).select("sample", "trim", "spike_n", "ref_n", "ref_dedup_pct")


@query(f"""
    with {PAIRS} select sample, mate_pos + 49 - pos + 1 as size, count(*) as n_pairs,
     round(sum(sum(mate_pos + 49 - pos + 1)) over (partition by sample) / sum(count(*)) over (partition by sample), 6) as mean_insert
    from us group by sample, size""")
def insert_size(t):
    return r6(rd.insert_size(pairs(t)).withColumnRenamed("pairs", "n_pairs"))


@query("""
    select qname, 1 as mate, rname, pos from reads union all select qname, 2, mate_rname, mate_pos from reads""")
def sort_alignments(t):
    return rd.sort_alignments(mates(t)).select(
        "qname", F.when(rd.has_bits(F.col("flag"), rd.FIRST), 1).otherwise(2).alias("mate"), "rname", "pos"
    )


@query("""
    with m as (select qname, 1 as mate, rname, pos, strand = '-' as down, mapped, mate_mapped, rname = mate_rname as same from reads
      union all select qname, 2, mate_rname, mate_pos, strand = '+', mate_mapped, mapped, rname = mate_rname from reads),
    f as (select *, 1 + 64 * mate + case when mapped and mate_mapped and same then 2 else 0 end + case when mapped then 0 else 4 end
      + case when mate_mapped then 0 else 8 end + case when down then 16 else 0 end as flag from m)
    select qname, mate, row_number() over (order by rname, pos, qname, flag) as position from f""")
def sorted_positions(t):
    return rd.sorted_positions(rd.sort_alignments(mates(t))).select(
        "qname", F.when(rd.has_bits(F.col("flag"), rd.FIRST), 1).otherwise(2).alias("mate"), "position"
    )


@query("select frag_id, sample from reads")
def merge_alignments(t):
    lanes = [t.reads.filter(F.col("event_type") == e) for e in ("click", "view", "purchase", "signup")]
    rest = t.reads.filter(~F.col("event_type").isin("click", "view", "purchase", "signup"))
    return rd.merge_alignments(*lanes, rest).select("frag_id", "sample")


ORDINAL = "o as (select concat('f', event_type) as file, event_id as id, row_number() over (partition by event_type order by event_id) - 1 as ordinal from events)"


def _ordinals(t):
    """Reads of one file per event type, numbered in the file."""
    e = t.events.select(F.concat(F.lit("f"), "event_type").alias("file"), F.col("event_id").alias("id"))
    return grouped_scan(e, ["file"], ["id"], {"ordinal": Running("count", before=True)})


@query(f"with {ORDINAL} select file, id, ordinal from o where ordinal < 500")
def fastq_head(t):
    return rd.fastq_head(_ordinals(t), 500)


@query(f"""
    with {ORDINAL} select file, id, ordinal, ordinal // greatest(1, (max(ordinal) over (partition by file) + 1) // 2) as part from o""")
def fastq_split(t):
    return rd.fastq_split(_ordinals(t))


def _demux_reads(t):
    codes = F.array(*[F.lit(s.replace("N", "G")) for _, s in rd.BARCODES], F.lit("TTTT"))
    k = F.col("event_id") % (len(rd.BARCODES) + 1)
    return t.events.select("event_id", F.concat(F.get(codes, k.cast("int")), F.lpad(F.col("user_id").cast("string"), 5, "C")).alias("seq"))


_CODES = ", ".join(f"'{b}'" for b, _ in rd.BARCODES)


@query(f"select event_id, coalesce(([{_CODES}])[event_id % {len(rd.BARCODES) + 1} + 1], 'unassigned') as barcode from events")
def barcode_demux(t):
    barcodes = t.spark.createDataFrame(rd.BARCODES, "barcode string, sequence string")
    return rd.barcode_demux(_demux_reads(t), barcodes).select("event_id", "barcode")


# ---- intervals ----


def _points(t, kinds=None):
    df = t.reads if kinds is None else t.reads.filter(F.col("event_type").isin(kinds))
    return df.select("frag_id", F.col("rname").alias("chrom"), "strand", "pos")


@query("""
    select frag_id, peak_id from reads r join peaks p on p.chrom = r.rname and p.strand = r.strand and r.pos < p.end_pos and r.pos + 50 > p.start_pos""")
def overlap_join(t):
    a = _points(t).select("frag_id", "chrom", "strand", F.col("pos").alias("start_pos"), (F.col("pos") + 50).alias("end_pos"))
    return iv.overlap_join(a, t.peaks, spread=["frag_id"]).select("frag_id", F.col("b_peak_id").alias("peak_id"))


@query("""
    select rname as chrom, strand, pos // 10 * 10 as start_pos, pos // 10 * 10 + 10 as end_pos, count(*) as n,
     round(count(*) * 1e6 / (select count(*) from reads), 6) as per_million from reads group by 1, 2, 3, 4""")
def binned_coverage(t):
    return r6(iv.binned_coverage(_points(t)))


@query("""
    with cov as (select rname as chrom, strand, pos, count(*) as v from reads group by 1, 2, 3),
    c as (select p.peak_id as site_id, case when p.strand = '-' then p.start_pos - c.pos else c.pos - p.start_pos end + 200 as off, v
      from peaks p join cov c on c.chrom = p.chrom and c.strand = p.strand)
    select site_id, cast(off // 5 as int) as bin, cast(sum(v) as bigint) as value from c where off >= 0 and off < 400 group by 1, 2""")
def anchor_matrix(t):
    cov = _points(t).groupBy("chrom", "strand", "pos").agg(F.count(F.lit(1)).alias("value"))
    sites = t.peaks.select(F.col("peak_id").alias("site_id"), "chrom", "strand", F.col("start_pos").alias("pos"))
    return iv.anchor_matrix(cov, sites, start=-200, width=5, bins=80)


@query("""
    with cov as (select rname as chrom, strand, pos, count(*) as v from reads group by 1, 2, 3),
    c as (select p.peak_id as site_id, case when p.strand = '-' then p.start_pos - c.pos else c.pos - p.start_pos end + 200 as off, v
      from peaks p join cov c on c.chrom = p.chrom and c.strand = p.strand)
    select site_id, cast(sum(v) filter (where off < 200) as bigint) as before, cast(sum(v) filter (where off >= 200) as bigint) as after
    from c where off >= 0 and off < 400 group by 1""")
def anchor_matrix_wide(t):
    cov = _points(t).groupBy("chrom", "strand", "pos").agg(F.count(F.lit(1)).alias("value"))
    sites = t.peaks.select(F.col("peak_id").alias("site_id"), "chrom", "strand", F.col("start_pos").alias("pos"))
    wide = iv.anchor_matrix(cov, sites, start=-200, width=200, bins=2, pivot=True)
    return wide.withColumnsRenamed({"0": "before", "1": "after"})


ENRICH = """ip as (select p.peak_id, count(*) as n from reads r join peaks p on p.chrom = r.rname and p.strand = r.strand and r.pos >= p.start_pos and r.pos < p.end_pos
      where event_type in ('click', 'view') group by 1),
    ct as (select p.peak_id, count(*) as n from reads r join peaks p on p.chrom = r.rname and p.strand = r.strand and r.pos >= p.start_pos and r.pos < p.end_pos
      where event_type = 'purchase' group by 1),
    tt as (select cast(count(*) filter (where event_type in ('click', 'view')) as double) as ti, cast(count(*) filter (where event_type = 'purchase') as double) as tc from reads),
    en as (select peak_id, coalesce(ip.n, 0) as a, coalesce(ct.n, 0) as c, ti, tc, ti - coalesce(ip.n, 0) as b, tc - coalesce(ct.n, 0) as d
      from peaks left join ip using (peak_id) left join ct using (peak_id), tt),
    er as (select peak_id, a as ip_reads, c as input_reads, case when a > 0 then log2((a / ti) / (greatest(c, 1) / tc)) end as l2fc,
      (ti + tc) * (a * d - b * c) * (a * d - b * c) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0) as chi2,
      case when a > c then 'enriched' else 'depleted' end as direction,
      case when a > 0 then a / ti * log2((a / ti) / (greatest(c, 1) / tc)) else 0 end as entropy from en)"""


def _enriched(t, pvalue=False):
    return iv.peak_enrichment(_points(t, ["click", "view"]), _points(t, ["purchase"]), t.peaks, pvalue=pvalue)


@query(f"with {ENRICH} select peak_id, ip_reads, input_reads, round(l2fc, 6) as l2fc, round(chi2, 6) as chi2, direction from er")
def peak_enrichment(t):
    return r6(_enriched(t).select("peak_id", "ip_reads", "input_reads", "l2fc", "chi2", "direction"))


@query(f"with {ENRICH} select peak_id from er where l2fc >= 1.2 and chi2 >= 1")
def strong_peaks(t):
    return iv.strong_peaks(_enriched(t), min_l2fc=1.2, min_chi2=1).select("peak_id")


@query("select peak_id from peaks where l2fc >= 3 and neg_log10_p >= 3")
def strong_peaks_by_p(t):
    return iv.strong_peaks(t.peaks).select("peak_id")


@query(f"with {ENRICH} select peak_id, round(entropy, 6) as entropy from er")
def peak_entropy(t):
    return r6(iv.peak_entropy(_enriched(t)).select("peak_id", "entropy"))


# erfc by the trapezoidal rule with the correction for its pole; the exact test as a sum over lists
@query(f"""
    with {ENRICH},
    g as (select er.peak_id, greatest(coalesce(chi2, 0), 0) / 2 as q, sqrt(greatest(coalesce(chi2, 0), 0) / 2) as z, er.chi2,
      case when least(a + b, c + d) * least(a + c, b + d) / (a + b + c + d) < 5 then 'F' else 'C' end as test, a, b, c, d,
      a + b + c + d as n, a + b as r, a + c as k from er join en on er.peak_id = en.peak_id),
    s as (select *, case when z > 0 then 0.5 * z / pi() * (1 / q + 2 * list_sum(list_transform(range(1, 40), lambda i: exp(-i * i * 0.25::double) / (i * i * 0.25::double + q)))) end as tail from g),
    ch as (select peak_id, chi2, test, case when z = 0 then 0 when z < 6 then greatest(0, -log10(tail * exp(-q) - 2 / (exp(4 * pi() * z) - 1)))
      else q / ln(10) - log10(tail) end as strength from s where test = 'C'),
    fi as (select *, list_transform(range(cast(greatest(0, r + k - n) as bigint), cast(least(r, k) as bigint) + 1), lambda i:
      lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1)
      - (case when i = 0 then 0 else lgamma(i + 1) end + lgamma(r - i + 1) + lgamma(k - i + 1) + lgamma(n - r - k + i + 1))) as lp from s where test = 'F'),
    fs as (select peak_id, chi2, test, greatest(0, -log10(list_sum(list_transform(list_filter(lp, lambda v: v <= lp[cast(a - greatest(0, r + k - n) as bigint) + 1] + 1e-7),
      lambda v: exp(v))))) as strength from fi),
    al as (select * from ch union all select * from fs)
    select peak_id, round(chi2, 6) as chi2, test, round(pow(10, -strength), 6) as p_value, round(least(strength, 400), 6) as neg_log10_p from al""")
def chi2_pvalue(t):
    return r6(_enriched(t, pvalue=True).select("peak_id", "chi2", "test", "p_value", "neg_log10_p"))


@query("""
    with b as (select peak_id, chrom, strand, start_pos + 3 as start_pos, end_pos + 3 as end_pos, l2fc * 0.8::double as l2fc, neg_log10_p + 1 as neg_log10_p from peaks)
    select a.peak_id, b.peak_id as other_id, greatest(a.start_pos, b.start_pos) as start_pos, least(a.end_pos, b.end_pos) as end_pos,
     round(sqrt(a.l2fc * b.l2fc), 6) as l2fc_mean, least(a.neg_log10_p, b.neg_log10_p) as neg_log10_p
    from peaks a join b on a.chrom = b.chrom and a.strand = b.strand and a.start_pos < b.end_pos and b.start_pos < a.end_pos where a.l2fc > 0 and b.l2fc > 0""")
def reproducible_peaks(t):
    other = t.peaks.withColumns(
        {
            "start_pos": F.col("start_pos") + 3, "end_pos": F.col("end_pos") + 3,
            "l2fc": F.col("l2fc") * 0.8, "neg_log10_p": F.col("neg_log10_p") + 1,
        }
    )
    both = iv.reproducible_peaks(t.peaks, other)
    return r6(both.select("peak_id", F.col("b_peak_id").alias("other_id"), "start_pos", "end_pos", "l2fc_mean", "neg_log10_p"))


@query("""
    with w as (select *, max(end_pos) over (partition by chrom, strand order by start_pos, end_pos, peak_id rows between unbounded preceding and 1 preceding) as reach from peaks),
    i as (select *, sum(case when reach is null or start_pos >= reach then 1 else 0 end) over (partition by chrom, strand order by start_pos, end_pos, peak_id rows unbounded preceding) as island from w)
    select chrom, strand, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) as peaks_n, round(max(l2fc), 6) as l2fc,
     arg_max(peak_id, l2fc * 1000000 - peak_id) as peak_id from i group by chrom, strand, island""")
def merge_intervals(t):
    return r6(iv.merge_intervals(t.peaks).withColumnRenamed("peaks", "peaks_n").drop("island"))
