"""Files, logs and sample sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobscope.operators import files as fl
from jobscope.plans.registry import query


@query("""
    select r.doc_id as job_id, case when r.doc_id % 7 = 0 then cast(0 as bigint) when r.doc_id % 7 = 1 then r.doc_id
      when b.doc_id is null then null else cast(r.n_chars + b.n_chars as bigint) end as input_size,
     r.doc_id % 7 > 1 and b.doc_id is null as missing_input
    from documents r left join documents b on b.doc_id = r.doc_id + 3""")
def input_size(t):
    d = t.documents.select("doc_id", "n_chars")
    path = lambda c: F.concat(F.lit("d/"), c.cast("string"))
    k = F.col("doc_id")
    inputs = F.when(k % 7 == 0, "none").when(k % 7 == 1, F.concat(F.lit(",jobSize:"), k.cast("string"))).otherwise(
        F.concat(F.lit(","), path(k), F.lit(" "), path(k + 3))
    )
    inventory = d.select(path(k).alias("path"), F.col("n_chars").alias("size_kib"))
    return fl.input_size(d.select(k.alias("job_id"), inputs.alias("inputs")), inventory)


@query("""
    select source as dir, concat('f', lpad(cast(doc_id as varchar), 8, '0')) as name, case lang when 'fr' then 'missing' else 'changed' end as change
    from documents where lang in ('fr', 'de')
    union all select concat(source, '/new'), concat('f', lpad(cast(doc_id as varchar), 8, '0')), 'extra' from documents where lang = 'fr'""")
def manifest_diff(t):
    name = F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    src = t.documents.select(F.col("source").alias("dir"), name.alias("name"), F.md5("text").alias("md5"), "lang")
    moved = src.withColumns(
        {
            "dir": F.when(F.col("lang") == "fr", F.concat("dir", F.lit("/new"))).otherwise(F.col("dir")),
            "md5": F.when(F.col("lang") == "de", F.lit("x")).otherwise(F.col("md5")),
        }
    )
    return fl.manifest_diff(src, moved)


FOLD = """sm as (select *, row_number() over (partition by dir order by name) as rn from inventory where size_kib <= 20000),
    fo as (select dir, name, size_kib, rn, cast(0 as bigint) as batch, cast(size_kib as bigint) as total from sm where rn = 1
      union all select s.dir, s.name, s.size_kib, s.rn, case when f.total > 20000 then f.batch + 1 else f.batch end,
       case when f.total > 20000 then s.size_kib else f.total + s.size_kib end from fo f join sm s on s.dir = f.dir and s.rn = f.rn + 1)"""


@query(f"""
    with {FOLD} select dir, name, batch from fo union all select dir, name, null from inventory where size_kib > 20000""")
def archive_batches(t):
    return fl.archive_batches(t.inventory, limit=20000).select("dir", "name", "batch")


@query(f"""
    with {FOLD} select dir, batch, concat(min(name), '-', max(name)) as archive, count(*) as files, cast(sum(size_kib) as bigint) as size_kib
    from fo group by dir, batch""")
def archive_list(t):
    return fl.archive_list(fl.archive_batches(t.inventory, limit=20000))


DIGEST = """z as (select file, max(line_no) as n, sum(strlen(line) + 1) as b from log_lines group by file)"""


@query(f"""
    with {DIGEST} select l.file, line_no, line, 'all' as part from log_lines l join z on l.file = z.file where b < 9000
    union all select l.file, line_no, line, 'head' from log_lines l join z on l.file = z.file where b >= 9000 and line_no <= 20
    union all select l.file, line_no, line, 'tail' from log_lines l join z on l.file = z.file where b >= 9000 and line_no > n - 20""")
def log_digest(t):
    return fl.log_digest(t.log_lines)


@query("select file, line_no, line from log_lines where regexp_matches(line, 'th[ae]n? [a-z]+sh')")
def pattern_scan(t):
    return fl.pattern_scan(t.log_lines, "th[ae]n? [a-z]+sh")


@query("""
    with r as (select *, row_number() over (partition by file order by line_no desc) as rn from trace),
    c as (select file, regexp_extract(line, '^[0-9]+ [0-9]+ ([a-z0-9_]+)', 1) as call, count(*) as n from r where rn <= 100 group by 1, 2),
    k as (select *, row_number() over (partition by file order by n desc, call desc) as rk from c where call <> 'openat')
    select file, call, n as lines from k where rk = 1""")
def dominant_call(t):
    return fl.dominant_call(t.trace)


@query(r"""
    with r as (select file, line, row_number() over (partition by file order by line_no desc) as rn from trace where contains(line, 'read(')),
    c as (select file, regexp_extract(line, 'read\(([0-9]+)', 1) as fd, count(*) as n from r where rn <= 50 group by 1, 2),
    k as (select *, row_number() over (partition by file order by n desc, fd desc) as rk from c where fd <> '')
    select file, fd, n as lines from k where rk = 1""")
def read_descriptor(t):
    return fl.read_descriptor(t.trace)


@query("select concat('mapping/', sample, '.dedup.Processed.out.bam') as bam, condition, sample as label from manifest where sample is not null")
def run_metadata(t):
    return fl.run_metadata(t.manifest)


@query("""
    with v as (select row_id, grp, concat_ws(',', case when contains(sample, ' ') then 'sample' end) as sp, concat(path, '/', read1) as p1,
      case when read2 <> '' then concat(path, '/', read2) end as p2 from sheet)
    select row_id, 'space_in_value' as rule, sp as detail from v where sp <> ''
    union all select row_id, 'missing_file', p1 from v where p1 not in (select path from inventory)
    union all select row_id, 'missing_file', p2 from v where p2 not in (select path from inventory)""")
def validate_sheet(t):
    return fl.validate_sheet(t.sheet, t.inventory)


@query("""
    with v as (select c_custkey as row_id, case when c_mktsegment = 'BUILDING' then 'RNA-seq' when c_mktsegment = 'MACHINERY' then 'Start-seq' else 'PRO-seq' end as kind,
      concat('f', cast(c_custkey as varchar)) as f1, concat('f', cast(c_custkey * 2 as varchar)) as f2 from customer)
    select row_id, 'analysis_type' as rule, kind as detail from v where kind = 'RNA-seq'
    union all select row_id, 'missing_file', f1 from v where row_id not in (select doc_id from documents)
    union all select row_id, 'missing_file', f2 from v where row_id * 2 not in (select doc_id from documents)""")
def validate_proseq(t):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    f = lambda c: F.concat(F.lit("f"), c.cast("string"))
    sheet = t.customer.select(
        k.alias("row_id"),
        F.when(seg == "BUILDING", "RNA-seq").when(seg == "MACHINERY", "Start-seq").otherwise("PRO-seq").alias("analysis_type"),
        f(k).alias("file_r1"), f(k * 2).alias("file_r2"), F.lit(None).cast("string").alias("tss_list"),
    )
    return fl.validate_sheet(sheet, t.documents.select(f(F.col("doc_id")).alias("path")), "proseq")


@query("""
    with v as (select row_id, string_split(read1, ',') as a, case when read2 = '' then [] else string_split(read2, ',') end as b from manifest where sample is not null),
    f as (select row_id, unnest(list_concat(a, b)) as p from v)
    select row_id, 'unequal_reads' as rule, concat(len(a), '/', len(b)) as detail from v where len(a) <> len(b)
    union all select row_id, 'missing_file', p from f where not contains(p, '/r1_')""")
def validate_rnaseq(t):
    firsts = t.manifest.select(F.explode(F.split("read1", ",")).alias("path")).filter(F.col("path").contains("/r1_"))
    return fl.validate_sheet(t.manifest, firsts, "rnaseq")
