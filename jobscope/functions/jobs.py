"""Job identity and state as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobscope.schemas import TASK_PROPERTIES

# fixed value: commands whose first argument names the program
INTERPRETERS = ["sh", "perl", "bash", "python", "python3", "matlab", "Rscript"]


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def _last_path_part(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def job_status(success: Column, state: Column, log_tail: Column) -> Column:
    """Final status from the success marker, the accounting text and the log tail."""
    state = F.coalesce(state, F.lit(""))
    srun = F.filter(F.split(F.coalesce(log_tail, F.lit("")), "\n"), lambda l: l.startswith("srun"))
    killed = F.exists(
        srun, lambda l: l.contains("task 0: Out Of Memory") | l.contains("Cannot allocate memory")
    )
    timeout, memory = state.contains("TIMEOUT"), state.contains("OUT_OF_ME")
    return (
        F.when(success, "COMPLETED")
        .when(timeout & memory, "OOMOOT")
        .when(timeout, "OOT")
        .when(memory, "OOM")
        .when(state.contains("FAILED"), "Fail")
        .when(state.contains("CANCEL"), "Canceled")
        .when(killed, "OOM")
        .otherwise("Unknown")
    )


def state_code(state: Column) -> Column:
    """2 finished, 1 failed, 0 still running, pending or not known yet."""
    s = F.lower(F.coalesce(state, F.lit("")))
    return (
        F.when(s.contains("completed"), 2)
        .when(s.rlike("failed|cancelled|timeout|out_of_memory"), 1)
        .otherwise(0)
    )


def program_of(explicit: Column, cmd: Column, script: Column) -> Column:
    """Program name: given, else from the wrapped command, else the script's name."""
    words = F.split(F.trim(cmd), "\\s+")
    first = F.get(words, F.lit(0))
    word = F.when(first.isin(INTERPRETERS), F.get(words, F.lit(1))).otherwise(first)
    return F.when(~_blank(explicit), explicit).otherwise(
        F.when(~_blank(cmd), _last_path_part(word)).otherwise(_last_path_part(script))
    )


def job_flag(explicit: Column, program: Column, inputs: Column, *identity: Column) -> Column:
    """Job flag; without inputs the suffix is a hash of ``identity``."""
    suffix = F.when(~_blank(inputs), _last_path_part(inputs)).otherwise(
        F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in identity])), 1, 8)
    )
    flag = F.when(~_blank(explicit), explicit).otherwise(F.concat(program, F.lit("."), suffix))
    return F.replace(F.replace(F.replace(flag, F.lit("/"), F.lit("-")), F.lit(".."), F.lit(".")), F.lit(" "), F.lit(""))


def ref_key(ref: Column) -> Column:
    return F.coalesce(F.replace(ref, F.lit("/"), F.lit("-")), F.lit("none"))


def task_properties(text: Column) -> Column:
    """Workflow-manager JSON to struct(program, threads, inputs)."""
    p = F.from_json(text, TASK_PROPERTIES)
    return F.struct(
        F.coalesce(p["rule"], p["groupid"]).alias("program"),
        p["threads"].alias("threads"),
        F.array_join(p["input"], " ").alias("inputs"),
    )


def index_list(text: Column, n: Column) -> Column:
    """``0,2-4,8`` to the sorted distinct indices below n; bad parts are ignored.

    Ranges are clipped to 0..n-1 before they are expanded.
    """
    n = n.cast("int")
    parts = F.split(F.replace(text, F.lit(" "), F.lit("")), ",")

    def expand(p: Column) -> Column:
        # a bound too long for an integer is out of range anyway
        low = F.regexp_extract(p, "^([0-9]+)(-[0-9]+)?$", 1)
        high = F.regexp_extract(p, "^[0-9]+-([0-9]+)$", 1)
        lo = F.when(low != "", F.coalesce(low.try_cast("int"), n))
        hi = F.when(high != "", F.coalesce(high.try_cast("int"), n - 1)).otherwise(lo)
        top = F.least(hi, n - 1)
        return F.when(lo <= top, F.sequence(lo, F.greatest(lo, top))).otherwise(
            F.array().cast("array<int>")
        )

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))


def job_size(inputs: Column) -> Column:
    """Literal size of ``,jobSize:N`` inputs, else null."""
    return F.regexp_extract(inputs, "^,jobSize:([0-9]+)$", 1).try_cast("bigint")


def input_refs(inputs: Column) -> Column:
    """Input files as an array; null when the size is given literally."""
    refs = F.filter(F.split(inputs, "[, ]+"), lambda r: r != "")
    return F.when(job_size(inputs).isNull(), refs)


def step_of(flag: Column) -> Column:
    """Step id: first dot field of the flag."""
    return F.substring_index(flag, ".", 1)


def step_identity(flag: Column) -> Column:
    """Step and dependencies: first two dot fields of the flag."""
    return F.substring_index(flag, ".", 2)


def link_path(group: Column, sample: Column, library: Column, lane: Column, mate: int, read: Column) -> Column:
    """Normalised place of a read file in the sample folder tree."""
    suffix = F.when(read.endswith(".gz"), ".gz").when(read.endswith(".bz2"), ".bz2").otherwise("")
    return F.concat(
        F.lit("group"), group.try_cast("int").cast("string"), F.lit("/"), sample, F.lit("/"),
        library, F.lit("_"), lane, F.lit(f"_{mate}.fq"), suffix,
    )


def umi_of(qname: Column) -> Column:
    return F.substring_index(qname, ":", 1)


def umi_extract(seq1: Column, seq2: Column, length: int = 6) -> Column:
    """Dual UMI: the first bases of both mates."""
    return F.concat(F.substring(seq1, 1, length), F.substring(seq2, 1, length))
