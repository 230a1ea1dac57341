"""The library's tables as views over the given parquet tables.

One text serves both engines: ``{table}`` names a given table, ``@DIV@`` is
integer division and ``@STR@`` the text type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

SCRIPT = """
        select o.o_orderkey as script_id, cast(t.n as bigint) as line_no,
         case t.n when 1 then '#!/bin/sh'
          when 2 then case when o.o_custkey % 4 = 0 then '#loopStart:i' else '' end
          when 3 then case when o.o_custkey % 4 = 0 then 'for x in 1 2 3; do' else 'for i in 1 2 3; do' end
          when 4 then concat('    #@1,0,', case when o.o_orderkey % 13 = 0 then '' else 'map' end, ',genome:x,input,sbatch -p short -c 1')
          when 5 then '    for k in 1 2; do echo one; done'
          when 6 then '  '
          when 7 then '    for j in 1 2; do'
          when 8 then concat('        #@2,1,count.NoCheckpoint,,in', case when o.o_orderkey % 17 = 0 then ',srun -p short' else '' end)
          when 9 then '        echo two'
          when 10 then ''
          when 11 then '    done'
          when 12 then concat('    #@', case when o.o_orderkey % 19 = 0 then '2' else '3' end, ',2,', o.o_orderpriority, ',,sam')
          when 13 then ''
          when 14 then 'done'
          when 15 then 'done # one too many'
          else concat('#@4,3.1,merge,,all,sbatch', case when o.o_orderkey % 23 = 0 then ' -a 1-4' else ' -t 50:0' end) end as text"""

VIEWS = {
    "ledger": """
        select o.o_orderkey as job_id,
         case when o.o_orderkey % 10 = 0 then cast(0 as bigint)
              else cast(floor(o.o_totalprice / 1000) as bigint) * 100 end as input_size,
         cast(4096 as bigint) as mem_default, cast(120 as bigint) as min_default,
         case when o.o_custkey % 2 = 0 then cast(4096 as bigint) else coalesce(l.q, 0) * 30 end as mem_alloc,
         case when o.o_custkey % 2 = 0 then cast(120 as bigint) else coalesce(l.n, 0) * 40 end as min_alloc,
         coalesce(l.q, 0) * 20 as mem_used, coalesce(l.n, 0) * 15 as min_used,
         case when o.o_orderstatus = 'F' then 'COMPLETED'
              when o.o_orderstatus = 'O' then case o.o_orderkey % 3 when 0 then 'OOM' when 1 then 'OOT' else 'OOMOOT' end
              else case o.o_orderkey % 3 when 0 then 'Fail' when 1 then 'Canceled' else 'Unknown' end end as status,
         concat('u', cast(o.o_custkey % 50 as @STR@)) as user_name,
         o.o_orderpriority as program, concat('ref', cast(o.o_custkey % 3 as @STR@)) as ref,
         concat(cast(o.o_orderkey % 7 as @STR@), '.0.', cast(o.o_orderkey as @STR@)) as flag,
         cast(1 + o.o_custkey % 4 as bigint) as core, cast(500 as bigint) as extra_mem,
         concat('n', cast(o.o_custkey % 20 as @STR@)) as node,
         cast(o.o_orderdate as timestamp) as finish_ts
        from {orders} o left join (select l_orderkey, cast(sum(l_quantity) as bigint) as q, count(*) as n
                                   from {lineitem} group by l_orderkey) l on o.o_orderkey = l.l_orderkey""",
    "extra": """
        select o_orderpriority as program, concat('ref', cast(o_custkey % 3 as @STR@)) as ref,
         cast(floor(o_totalprice / 2000) as bigint) as extra_mb, cast(4096 as bigint) as total_mb, o_orderkey as job_id
        from {orders} where o_orderstatus = 'O' and o_orderpriority <> '1-URGENT'""",
    "requests": """
        select o_orderkey as job_id,
         case o_orderkey % 4 when 0 then '4G' when 1 then '4g' when 2 then '4096M' else '2GB' end as mem_text,
         case o_orderkey % 5 when 0 then '50' when 1 then '50:0' when 2 then '2:0:0' when 3 then '1-02:30' else '10-00:00:00' end as time_text,
         case o_custkey % 3 when 0 then 'short' when 1 then 'highmem' else null end as partition_name,
         o_orderpriority as program, concat('ref', cast(o_custkey % 3 as @STR@)) as ref,
         case when o_orderkey % 11 = 0 then cast(null as bigint) when o_orderkey % 10 = 0 then cast(0 as bigint)
              else cast(floor(o_totalprice / 900) as bigint) * 100 end as input_size,
         cast(4096 as bigint) as mem_default, cast(120 as bigint) as min_default
        from {orders}""",
    "acct_jobs": """
        select o_orderkey as job_id, concat('u', cast(o_custkey % 50 as @STR@)) as user_name,
         cast(1 + o_custkey % 2 as bigint) as nodes, cast(8 + floor(o_totalprice / 10000) as double) as req_gb,
         concat(lpad(cast(o_custkey % 24 as @STR@), 2, '0'), ':', lpad(cast(o_orderkey % 60 as @STR@), 2, '0'), ':00') as elapsed,
         cast(1 + o_custkey % 8 as bigint) as ncpus,
         concat(cast(o_custkey % 3 as @STR@), '-', lpad(cast(o_custkey % 24 as @STR@), 2, '0'), ':', lpad(cast(o_orderkey % 60 as @STR@), 2, '0'), ':30') as total_cpu,
         concat(cast(1 + o_custkey % 5 as @STR@), '-00:00:00') as time_limit,
         cast(o_orderdate as timestamp) as finish_ts,
         o_custkey % 24 as eh, o_orderkey % 60 as em, o_custkey % 3 as cd, 1 + o_custkey % 5 as ld
        from {orders}""",
    "acct_steps": """
        select l_orderkey as job_id, cast(l_linenumber as bigint) as step_no, l_quantity as max_rss_gb,
         concat(lpad(cast(l_partkey % 24 as @STR@), 2, '0'), ':', lpad(cast(l_suppkey % 60 as @STR@), 2, '0'), ':',
                lpad(cast(l_linenumber * 7 % 60 as @STR@), 2, '0')) as elapsed,
         l_partkey % 24 as eh, l_suppkey % 60 as em, l_linenumber * 7 % 60 as es
        from {lineitem}""",
    "samples": """
        select user_id as job_id, event_id as seq, cast(ts as timestamp) as ts, cast(floor(value * 10) as bigint) as mem_mb,
         cast(floor(value) as bigint) as cpu_pct, (event_id % 97 = 0) as is_marker from {events}""",
    "sample_jobs": """
        select c_custkey as job_id, cast(200 + (c_custkey % 40) * 120 as bigint) as reserved_mb,
         cast(timestamp '2024-01-01 00:00:00' as timestamp) as start_ts,
         cast(200 + (c_custkey % 40) * 120 as bigint) as total_mem, cast(60 * (1 + c_custkey % 700) as bigint) as total_min,
         cast(floor(c_acctbal) as bigint) as acct_mem,
         cast(timestamp '2024-02-01 00:00:30' as timestamp) as finish_ts
        from {customer}""",
    "graph": """
        select o_orderkey as job_id,
         case when o_orderkey = 0 then 'null' when o_orderkey < 10 then '0'
              else concat(cast(o_orderkey @DIV@ 10 as @STR@), ':', cast(o_orderkey @DIV@ 10 - 1 as @STR@)) end as depend_on,
         concat(cast(o_orderkey % 7 as @STR@), '.0.', cast(o_orderkey as @STR@)) as flag, o_orderstatus as st
        from {orders}""",
    "markers": """
        select concat(cast(o_orderkey % 7 as @STR@), '.0.', cast(o_orderkey as @STR@)) as flag, 'success' as kind
        from {orders} where o_orderstatus = 'F'
        union all
        select concat(cast(o_orderkey % 7 as @STR@), '.0.', cast(o_orderkey as @STR@)), 'failed'
        from {orders} where o_orderstatus = 'P' and o_orderkey % 50 = 0
        union all
        select concat(cast(o_orderkey % 7 as @STR@), '.0.', cast(o_orderkey as @STR@)), 'requeued'
        from {orders} where o_orderkey % 9 = 0""",
    "queue": """
        select o_orderkey as job_id, case when o_orderkey % 2 = 0 then 'R' else 'PD' end as code
        from {orders} where o_orderstatus = 'O'""",
    "reads": """
        select event_id as frag_id,
         concat(translate(lpad(cast(user_id % 64 as @STR@), 4, '0'), '0123456789', 'ACGTACGTAC'), ':', cast(event_id as @STR@)) as qname,
         concat('chr', cast(user_id % 5 + 1 as @STR@)) as rname,
         case when event_id % 50 = 0 then 'chrM' else concat('chr', cast(user_id % 5 + 1 as @STR@)) end as mate_rname,
         (event_id % 97) * 10 as pos, (event_id % 97) * 10 + 50 + user_id % 3 as mate_pos,
         case when event_id % 2 = 0 then '+' else '-' end as strand,
         event_type <> 'error' as mapped, event_type <> 'signup' as mate_mapped,
         concat('s', cast(user_id % 7 as @STR@)) as sample, event_type
        from {events}""",
    "peaks": """
        select p_partkey as peak_id, concat('chr', cast(p_partkey % 5 + 1 as @STR@)) as chrom,
         (p_partkey % 97) * 10 as start_pos, (p_partkey % 97) * 10 + p_size as end_pos,
         case when p_partkey % 2 = 0 then '+' else '-' end as strand,
         cast((p_partkey % 50) / 10.0 - 1 as double) as l2fc, cast((p_partkey % 13) / 2.0 as double) as neg_log10_p
        from {part}""",
    "inventory": """
        select source as dir, concat('f', lpad(cast(doc_id as @STR@), 8, '0')) as name,
         concat(source, '/', 'f', lpad(cast(doc_id as @STR@), 8, '0')) as path, n_chars as size_kib, md5(text) as md5
        from {documents}""",
    "policy": """
        select * from (values ('short', 1, 'general', cast(249000 as bigint), cast(720 as bigint)),
         ('medium', 2, 'general', 249000, 7200), ('long', 3, 'general', 249000, 43200),
         ('priority', 11, 'special', 249000, 43200), ('highmem', 12, 'special', 999000, 43200),
         ('interactive', 13, 'special', 249000, 720), ('gpu', 14, 'special', 249000, 43200),
         ('gpu_quad', 15, 'special', 249000, null)) as t(name, ordinal, kind, mem_limit_mb, time_limit_min)""",
    "trace": """
        select concat('p', cast(user_id as @STR@)) as file, event_id as line_no,
         concat(cast(user_id as @STR@), ' ', cast(event_id as @STR@), ' ',
          case event_type when 'click' then 'read' when 'view' then 'futex' when 'purchase' then 'openat'
               when 'error' then 'epoll_wait' else 'wait4' end, '(', cast(event_id % 9 as @STR@), ', ...) = 0') as line
        from {events}""",
    "log_lines": {
        "spark": "select concat('d', cast(doc_id as string)) as file, cast(pos + 1 as bigint) as line_no, line"
        " from {documents} lateral view posexplode(split(text, '\\n')) as pos, line",
        "duck": "select concat('d', cast(doc_id as varchar)) as file, cast(i as bigint) as line_no, l[i] as line"
        " from (select doc_id, string_split(text, chr(10)) l from {documents}), unnest(range(1, len(l) + 1)) t(i)",
    },
    # one annotated script per order: a loop, a loop inside it, a gather step
    "script_lines": {
        "spark": SCRIPT + " from {orders} o lateral view explode(sequence(1, 16)) t as n",
        "duck": SCRIPT + " from {orders} o, unnest(range(1, 17)) t(n)",
    },
    "procs": """
        select event_id @DIV@ 500 as job_id, cast(0 as bigint) as tick, event_id as pid,
         case when event_id % 500 = 0 then cast(-1 as bigint)
              else (event_id @DIV@ 500) * 500 + (event_id % 500 - 1) @DIV@ 3 end as ppid,
         cast(floor(value * 100) as bigint) as rss_kb, cast(floor(value) as double) as cpu_pct,
         event_id % 500 = 0 as is_root, (event_id % 500 <> 0 and event_id % 41 = 7) as is_monitor
        from {events}""",
    "manifest": """
        select c_custkey as row_id, concat('d', cast(c_custkey % 9 as @STR@), '/r1_', cast(c_custkey as @STR@), '.fq',
          case when c_custkey % 6 = 0 then concat(',d/x', cast(c_custkey as @STR@), '.fq') else '' end) as read1,
         case when c_custkey % 8 = 0 then '' else concat('d', cast(c_custkey % 9 as @STR@), '/r2_', cast(c_custkey as @STR@), '.fq') end as read2,
         case when c_custkey % 10 = 0 then null else c_name end as sample, c_mktsegment as condition
        from {customer}""",
    "sheet": """
        select s_suppkey as row_id, cast(s_nationkey as @STR@) as grp,
         case when s_suppkey % 9 = 0 then concat(s_name, ' b') else s_name end as sample,
         concat('lib', cast(s_suppkey % 4 as @STR@)) as library, concat('L', cast(s_suppkey % 3 as @STR@)) as lane,
         case when s_suppkey % 2 = 0 then 'web' else 'code' end as path,
         concat('f', lpad(cast(s_suppkey as @STR@), 8, '0')) as read1,
         case when s_suppkey % 5 = 0 then '' else concat('f', lpad(cast(s_suppkey + 1 as @STR@), 8, '0')) end as read2
        from {supplier}""",
}


def _fill(text: str, spark: bool) -> str:
    text = text.replace("@DIV@", "div" if spark else "//").replace("@STR@", "string" if spark else "varchar")
    return text if spark else re.sub(r"\{(\w+)\}", r"\1", text)


def _text(name: str, spark: bool) -> str:
    v = VIEWS[name]
    if isinstance(v, dict):
        v = v["spark" if spark else "duck"]
    return _fill(v, spark)


class Tables:
    """Given tables and views as attributes: ``t.orders``, ``t.ledger``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        text = _text(name, True)
        return self.spark.sql(text, **{b: getattr(self, b) for b in set(re.findall(r"\{(\w+)\}", text))})


def duck(sql: str) -> str:
    """SQL for the other engine: the views it names go in front as common tables."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(f"{v} as ({_text(v, False)})" for v in used)
    body = sql.strip()
    if not ctes:
        return _fill(body, False)
    if body.lower().startswith("with "):
        return _fill(f"with recursive {ctes}, {body[5:]}", False)
    return _fill(f"with recursive {ctes} {body}", False)
