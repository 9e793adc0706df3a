"""Queries on sites, contigs and labels."""

from __future__ import annotations

from endsight.operators import sites as S
from endsight.plans.catalog import query
from endsight.plans.views import view, with_views

# Oracle text shared by several queries: candidate sites of v_tx.
SITES_SQL = """
site as (
  select transcript_id, 'TSS' as site_type, chrom,
         case when s = '+' then tx_start + 1 else tx_end end as position, s as strand
  from (select *, unnest(case strand when '.' then ['+','-'] else [strand] end) as s from v_tx)
  union all
  select transcript_id, 'TES', chrom,
         case when s = '+' then tx_end else tx_start + 1 end, s
  from (select *, unnest(case strand when '.' then ['+','-'] else [strand] end) as s from v_tx)
)"""
LABELED_SQL = (
    SITES_SQL
    + """,
labeled as (
  select s.*, cast(exists (select 1 from v_ref_site r where r.site_type = s.site_type
      and r.chrom = s.chrom and r.strand = s.strand
      and r.position between s.position - 50 and s.position + 50) as int) as label
  from site s
)"""
)


def tx_sites(spark, sf_dir):
    return S.candidate_sites(view(spark, sf_dir, "v_tx"), start="tx_start", end="tx_end")


def labeled_sites(spark, sf_dir):
    return S.proximity_label(tx_sites(spark, sf_dir), view(spark, sf_dir, "v_ref_site"))


@query("prj_01_candidate_sites", with_views(f"with {SITES_SQL} select * from site", "v_tx"))
def prj_01(spark, sf_dir):
    return tx_sites(spark, sf_dir)


@query("jon_02_proximity_label", with_views(f"with {LABELED_SQL} select * from labeled", "v_tx", "v_ref_site"))
def jon_02(spark, sf_dir):
    return labeled_sites(spark, sf_dir)


@query(
    "agg_25_label_stats",
    with_views(
        f"""with {LABELED_SQL}
        select site_type, chrom, count(*) as total_candidates,
               count(*) filter (label = 1) as true_sites, count(*) filter (label = 0) as false_sites,
               round(100.0 * count(*) filter (label = 1) / count(*)::double, 2) as true_percentage,
               round(100.0 * count(*) filter (label = 0) / count(*)::double, 2) as false_percentage
        from labeled group by all""",
        "v_tx",
        "v_ref_site",
    ),
)
def agg_25(spark, sf_dir):
    return S.label_stats(labeled_sites(spark, sf_dir), ["site_type", "chrom"])
