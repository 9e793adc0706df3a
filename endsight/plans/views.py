"""Adapter views: the driver's star-schema tables seen as transcripts, reads and runs.

Each text is valid in Spark SQL and in DuckDB; ``{table}`` marks a base table.
Spark binds it to the parquet file, the oracle to the pre-registered view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CONTIG = """case when {key} % 24 = 22 then 'chrX' when {key} % 24 = 23 then 'NW_1.1'
            else concat('chr', cast({key} % 24 + 1 as string)) end"""

# The view definitions shared by the queries and their oracles.
VIEWS: dict[str, str] = {
    "v_tx": f"""
select concat('TX.', cast(o_orderkey as string)) as transcript_id,
       concat('G.', cast(o_custkey as string)) as gene_id,
       {_CONTIG.format(key="o_orderkey")} as chrom,
       case when o_orderkey % 7 = 0 then '.' when o_custkey % 2 = 1 then '+' else '-' end as strand,
       cast((o_orderkey % 5000) * 12 + 2000 as bigint) as tx_start,
       cast((o_orderkey % 5000) * 12 + 2200 + o_custkey % 300 as bigint) as tx_end,
       o_totalprice / 1000.0 as coverage
from {{orders}}""",
    "v_exon": """
select concat('TX.', cast(l_orderkey as string)) as transcript_id,
       cast((l_orderkey % 5000) * 12 + 2000 + l_linenumber * 60 as bigint) as exon_start,
       cast((l_orderkey % 5000) * 12 + 2000 + l_linenumber * 60
            + cast(round(l_quantity) as bigint) as bigint) as exon_end
from {lineitem}""",
    "v_ref_site": f"""
select s.site_type, t.chrom, t.strand,
       case when (s.site_type = 'TSS') = (t.strand = '+') then t.tx_start + 1 + t.j
            else t.tx_end + t.j end as position
from (select {_CONTIG.format(key="o_orderkey")} as chrom,
             case when o_custkey % 2 = 1 then '+' else '-' end as strand,
             cast((o_orderkey % 5000) * 12 + 2000 as bigint) as tx_start,
             cast((o_orderkey % 5000) * 12 + 2200 + o_custkey % 300 as bigint) as tx_end,
             cast(o_custkey % 140 - 70 as bigint) as j
      from {{orders}} where o_orderkey % 3 = 0) t
cross join (select 'TSS' as site_type union all select 'TES' as site_type) s""",
    "v_aln": f"""
select read_id, chrom, ref_start, ref_start + m1 + n + m2 as ref_end, mapq, is_reverse, ts,
       left_clip, right_clip, m1, n, m2,
       concat(case when left_clip > 0 then concat(cast(left_clip as string), 'S') else '' end,
              cast(m1 as string), 'M',
              case when n > 0 then concat(cast(n as string), 'N') else '' end,
              cast(m2 as string), 'M',
              case when right_clip > 0 then concat(cast(right_clip as string), 'S') else '' end) as cigar,
       substr('ACGTTGCAAGGATTTCCCAGGTGAGCCGCATAATGA', cast(1 + k % 12 as int), cast(left_clip as int)) as left_seq,
       substr('ACGTTGCAAGGATTTCCCAGGTGAGCCGCATAATGA', cast(1 + k % 17 as int), cast(right_clip as int)) as right_seq
from (select l_orderkey * 10 + l_linenumber as read_id, l_partkey as k,
             {_CONTIG.format(key="l_orderkey")} as chrom,
             cast((l_orderkey % 5000) * 12 + 1970 + l_partkey % 61 as bigint) as ref_start,
             cast(l_linenumber * 8 as int) as mapq,
             l_returnflag = 'R' as is_reverse,
             case when l_linestatus = 'O' then case when l_suppkey % 5 = 0 then '-' else '+' end end as ts,
             cast(round(l_discount * 100) as bigint) as left_clip,
             cast(round(l_tax * 100) as bigint) as right_clip,
             cast(10 + l_suppkey % 7 as bigint) as m1,
             cast(case when l_linenumber % 2 = 0 then 50 else 0 end as bigint) as n,
             cast(10 + round(l_quantity) as bigint) as m2
      from {{lineitem}}) b""",
    "v_tmap": """
select concat('TX.', cast(o_orderkey as string)) as qry_id,
       concat(case when o_custkey % 11 = 0 then 'NOVEL_TX_' else 'R.' end,
              cast(o_custkey % 400 as string)) as ref_id,
       case o_orderstatus when 'F' then '=' when 'O' then 'j' else 'x' end as class_code,
       o_totalprice / 1000.0 as cov, o_totalprice / 500.0 as tpm, o_totalprice / 700.0 as fpkm
from {orders}""",
    "v_score": """
select concat('TX.', cast(o_orderkey as string)) as transcript_id,
       cast((o_orderkey * 7919) % 1000 as double) / 1000.0 as pred_prob,
       cast((o_orderkey * 104729) % 1000 as double) / 1000.0 as p_site_rf,
       cast((o_orderkey * 1299709) % 1000 as double) / 1000.0 as p_site_xgb
from {orders}""",
    "v_assembly": """
select a.assembler_id, a.ord as assembly_ord, o.o_orderkey as file_ord,
       concat(a.assembler_id, '.', cast(o.o_orderkey as string)) as transcript_id,
       concat('chr', cast(o.o_orderkey % 22 + 1 as string)) as chrom,
       case when o.o_custkey % 2 = 1 then '+' else '-' end as strand,
       cast((o.o_orderkey % 5000) * 12 + 2000 + (o.o_custkey * a.ord) % 45 as bigint) as tss,
       cast((o.o_orderkey % 5000) * 12 + 2500 + (o.o_custkey * a.ord) % 75 as bigint) as tes
from {orders} o
cross join (select 'stringtie' as assembler_id, 0 as ord union all select 'isoquant', 1
            union all select 'scallop2', 2) a
where (o.o_orderkey + a.ord) % 4 <> 0""",
    "v_run": """
select concat('T', cast(s_suppkey as string)) as test_id,
       case s_suppkey % 4 when 0 then 'sr' when 1 then 'cdna' when 2 then 'drna' else 'pacbio' end as data_type,
       case s_nationkey % 3 when 0 then 'refseq' when 1 then 'gencode' else 'ensembl' end as train_annotation,
       case s_suppkey % 3 when 0 then 'gencode' when 1 then 'ensembl' else 'refseq' end as test_annotation,
       case s_suppkey % 2 when 0 then 'stringtie' else 'isoquant' end as assembler_id,
       case when s_suppkey % 13 = 0 then null
            else cast((s_suppkey * 37) % 100 as double) / 100.0 end as stage1_test_aupr_tss_rf,
       cast((s_suppkey * 53) % 100 as double) / 100.0 as stage1_test_aupr_tss_xgb,
       cast((s_suppkey * 29) % 97 as double) / 100.0 as stage1_test_aupr_tss_baseline
from {supplier}""",
}

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view over the base tables in ``sf_dir``."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in BASE_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_views(sql: str, *names: str) -> str:
    """Prefix oracle SQL with the named views as common table expressions."""
    bound = {t: t for t in BASE_TABLES}
    ctes = ",\n".join(f"{n} as ({VIEWS[n].format(**bound)})" for n in names)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
