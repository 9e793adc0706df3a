"""Queries on annotation lines, contigs, consensus and site sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from endsight.functions import attributes as A
from endsight.functions.contigs import autosome_number, in_train_split, normalize_chrom, strip_chrom
from endsight.operators import annotation as N
from endsight.operators import sites as S
from endsight.plans.catalog import query
from endsight.plans.catalog_sites import LABELED_SQL, SITES_SQL, labeled_sites, tx_sites
from endsight.plans.views import table, view, with_views
from endsight.sources.gtf import parse_gtf

# Oracle text and Spark source of annotation lines: v_tx and v_exon rendered as nine columns.
LINES = """
select cast(substr(transcript_id, 4) as bigint) * 100 as line_no,
       concat_ws(chr(9), chrom, 'asm', 'transcript', cast(tx_start as string), cast(tx_end as string), '.', strand, '.',
         concat('gene_id "', gene_id, '"; transcript_id "', transcript_id, '"; ',
                case cast(substr(transcript_id, 4) as bigint) % 3 when 0 then concat('cov "', cast(cast(floor(coverage) as bigint) as string), '.5";')
                     when 1 then concat('coverage "', cast(cast(floor(coverage) as bigint) as string), '.5"; note "a"') else 'note "b"' end)) as value
from v_tx
union all
select cast(substr(transcript_id, 4) as bigint) * 100 + 1 + cast((exon_start - 2000) % 97 as bigint), 
       concat_ws(chr(9), 'chr1', 'asm', 'exon', cast(exon_start as string), cast(exon_end as string), '.', '+', '.',
         concat('transcript_id "', transcript_id, '"; exon_number "1";')) as value
from v_exon"""
PARSED_SQL = f"""lines as ({LINES}),
p as materialized (select line_no, value, c[1] as chrom, c[3] as feature, c[4]::bigint as start, c[5]::bigint as "end", c[7] as strand, c[9] as attrs,
  nullif(regexp_extract(c[9], 'transcript_id\\s+"([^"]+)"', 1), '') as transcript_id, nullif(regexp_extract(c[9], 'gene_id\\s+"([^"]+)"', 1), '') as gene_id
  from (select *, string_split(value, chr(9)) as c from lines))"""


def gtf_lines(spark, sf_dir):
    return parse_gtf(
        spark.sql(
            LINES.replace("v_tx", "{v_tx}").replace("v_exon", "{v_exon}"),
            v_tx=view(spark, sf_dir, "v_tx"), v_exon=view(spark, sf_dir, "v_exon"),
        )
    )


def lines_sql(body: str, *more: str) -> str:
    return with_views(f"with {PARSED_SQL} {body}", "v_tx", "v_exon", *more)


@query("src_01_gtf_scan", lines_sql('select line_no, chrom, feature, start, "end", strand from p'))
def src_01(spark, sf_dir):
    return gtf_lines(spark, sf_dir).select("line_no", "chrom", "feature", "start", "end", "strand")


@query("src_02_gtf_attrs", lines_sql("select line_no, feature, transcript_id, gene_id from p"))
def src_02(spark, sf_dir):
    return gtf_lines(spark, sf_dir).select("line_no", "feature", "transcript_id", "gene_id")


@query(
    "src_03_attrs_to_map",
    lines_sql(
        """select line_no, feature, transcript_id, gene_id, nullif(regexp_extract(attrs, 'note "([^"]*)"', 1), '') as note,
             (len(string_split(trim(attrs), ';')) - (trim(attrs) like '%;')::int)::int as entries from p"""
    ),
)
def src_03(spark, sf_dir):
    m = gtf_lines(spark, sf_dir).withColumn("m", A.attributes_map(F.col("attrs")))
    return m.select(
        "line_no", "feature", F.try_element_at("m", F.lit("transcript_id")).alias("transcript_id"),
        F.try_element_at("m", F.lit("gene_id")).alias("gene_id"), F.try_element_at("m", F.lit("note")).alias("note"),
        F.size("m").alias("entries"),
    )


@query(
    "prj_11_cov_attr_parse",
    lines_sql(
        """select line_no, coalesce(nullif(regexp_extract(attrs, 'coverage "([^"]*)"', 1), '')::double,
             nullif(regexp_extract(attrs, ' cov "([^"]*)"', 1), '')::double, 0.0) as coverage from p where feature = 'transcript'"""
    ),
)
def prj_11(spark, sf_dir):
    tx = gtf_lines(spark, sf_dir).where("feature = 'transcript'")
    return tx.select("line_no", A.coverage_value(F.col("attrs")).alias("coverage"))


REPLACED_SQL = """case when attrs like '% cov "%' then regexp_replace(attrs, ' cov "[^"]*"', ' cov "' || {v} || '"')
  when attrs like '% coverage "%' then regexp_replace(attrs, ' coverage "[^"]*"', ' cov "' || {v} || '"')
  when attrs like '%;' then attrs || ' cov "' || {v} || '";' else attrs || '; cov "' || {v} || '";' end"""


@query(
    "prj_12_cov_attr_replace",
    lines_sql(f"select line_no, {REPLACED_SQL.format(v=chr(39) + '0.5' + chr(39))} as attrs from p where feature = 'transcript'"),
)
def prj_12(spark, sf_dir):
    tx = gtf_lines(spark, sf_dir).where("feature = 'transcript'")
    return tx.select("line_no", A.set_coverage(F.col("attrs"), F.lit(0.5)).alias("attrs"))


@query(
    "prj_13_attr_upsert",
    lines_sql(
        """select line_no, case when attrs like '%gene_id "%' then regexp_replace(attrs, 'gene_id\\s+"[^"]*"', 'gene_id "NEW"')
             when attrs like '%;' then attrs || ' gene_id "NEW";' else attrs || '; gene_id "NEW";' end as attrs from p"""
    ),
)
def prj_13(spark, sf_dir):
    lines = gtf_lines(spark, sf_dir)
    return lines.select("line_no", A.set_attribute(F.col("attrs"), "gene_id", F.lit("NEW")).alias("attrs"))


@query(
    "jon_12_gtf_filter_by_score",
    lines_sql(
        """select line_no, value from p where transcript_id in (select transcript_id from v_score where pred_prob >= 0.5)""",
        "v_score",
    ),
)
def jon_12(spark, sf_dir):
    kept = N.filter_by_score(gtf_lines(spark, sf_dir), view(spark, sf_dir, "v_score"), 0.5)
    return kept.select("line_no", "value")


@query(
    "jon_13_gtf_filter_chrom",
    lines_sql(
        """select line_no, value from p where transcript_id in (select transcript_id from p where feature = 'transcript'
             and strand <> '.' and chrom in ('chr11', 'chr12', 'chrX'))"""
    ),
)
def jon_13(spark, sf_dir):
    lines = gtf_lines(spark, sf_dir)
    contigs = lines.where("chrom in ('chr11', 'chr12', 'chrX')").select("chrom")
    return N.filter_by_contig(lines, contigs).select("line_no", "value")


@query(
    "jon_14_gtf_inject_score",
    lines_sql(
        f"""select line_no, case when feature = 'transcript' and s.score is not null
              then array_to_string(string_split(value, chr(9))[1:8], chr(9)) || chr(9) || {REPLACED_SQL.format(v='s.score::varchar')} else value end as value
            from p left join (select transcript_id, pred_prob as score from v_score where pred_prob >= 0.25) s using (transcript_id)""",
        "v_score",
    ),
)
def jon_14(spark, sf_dir):
    scores = view(spark, sf_dir, "v_score").where("pred_prob >= 0.25").selectExpr("transcript_id", "pred_prob as score")
    return N.inject_score(gtf_lines(spark, sf_dir), scores).select("line_no", "value")


# ---- contigs ----

CONTIG_SQL = """names as (select distinct c from (select chrom as c from v_tx union all select 'CHR' || substr(chrom, 4) from v_tx where chrom like 'chr%'
  union all select 'NC_00000' || (o_orderkey % 9 + 1)::varchar || '.11' from orders union all select (o_orderkey % 30)::varchar from orders
  union all select 'NT_' || (o_orderkey % 7)::varchar || '.1' from orders union all select 'KI' || (o_orderkey % 5)::varchar || '.1' from orders))"""
NUMBER_SQL = """num as (select c, case when regexp_matches(regexp_replace(c, '^(?i)chr', ''), '^(?i)(nt_|nw_|ki[0-9])') then null
  when try_cast(coalesce(nullif(regexp_extract(regexp_replace(c, '^(?i)chr', ''), '^NC_0*([0-9]+)', 1), ''), regexp_replace(c, '^(?i)chr', '')) as int) between 1 and 22
  then try_cast(coalesce(nullif(regexp_extract(regexp_replace(c, '^(?i)chr', ''), '^NC_0*([0-9]+)', 1), ''), regexp_replace(c, '^(?i)chr', '')) as int) end as n from names)"""


def contig_names(spark, sf_dir):
    tx = view(spark, sf_dir, "v_tx").select("chrom")
    orders = table(spark, sf_dir, "orders")
    parts = [
        tx.selectExpr("chrom as c"),
        tx.where("chrom like 'chr%'").selectExpr("concat('CHR', substr(chrom, 4)) as c"),
        orders.selectExpr("concat('NC_00000', string(o_orderkey % 9 + 1), '.11') as c"),
        orders.selectExpr("string(o_orderkey % 30) as c"),
        orders.selectExpr("concat('NT_', string(o_orderkey % 7), '.1') as c"),
        orders.selectExpr("concat('KI', string(o_orderkey % 5), '.1') as c"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


@query(
    "prj_02_normalize_chrom",
    with_views(f"with {CONTIG_SQL} select c, case when length(c) > 3 and lower(c[1:3]) = 'chr' then 'chr' || c[4:] else 'chr' || c end as chrom from names", "v_tx"),
)
def prj_02(spark, sf_dir):
    return contig_names(spark, sf_dir).select("c", normalize_chrom(F.col("c")).alias("chrom"))


@query("prj_03_strip_chrom", with_views(f"with {CONTIG_SQL} select c, regexp_replace(c, '^(?i)chr', '') as chrom from names", "v_tx"))
def prj_03(spark, sf_dir):
    return contig_names(spark, sf_dir).select("c", strip_chrom(F.col("c")).alias("chrom"))


@query("prj_04_autosome_number", with_views(f"with {CONTIG_SQL}, {NUMBER_SQL} select c, n from num", "v_tx"))
def prj_04(spark, sf_dir):
    return contig_names(spark, sf_dir).select("c", autosome_number(F.col("c")).alias("n"))


@query("prj_06_train_val_split", with_views(f"with {CONTIG_SQL}, {NUMBER_SQL} select c, coalesce(n between 1 and 10, false) as train from num", "v_tx"))
def prj_06(spark, sf_dir):
    return contig_names(spark, sf_dir).select("c", in_train_split(F.col("c"), (1, 10)).alias("train"))


@query("prj_07_validation_seqnames", with_views(f"with {CONTIG_SQL}, {NUMBER_SQL} select c as chrom from num where not coalesce(n between 1 and 10, false)", "v_tx"))
def prj_07(spark, sf_dir):
    names = contig_names(spark, sf_dir)
    return names.where(~in_train_split(F.col("c"), (1, 10))).select(F.col("c").alias("chrom")).orderBy("chrom")


@query("snk_13_split_lists", with_views(f"with {CONTIG_SQL}, {NUMBER_SQL} select case when coalesce(n between 1 and 10, false) then 'train' else 'validation' end as split, c as chrom from num", "v_tx"))
def snk_13(spark, sf_dir):
    split = F.when(in_train_split(F.col("c"), (1, 10)), "train").otherwise("validation")
    return contig_names(spark, sf_dir).select(split.alias("split"), F.col("c").alias("chrom")).orderBy("split", "chrom")


# ---- sites ----

COUNTS_SQL = f"""with {SITES_SQL}, counts as (select site_type, chrom, position, count(*) filter (strand = '+') as plus, count(*) filter (strand = '-') as minus
  from site join (select transcript_id, strand as ts from v_tx where strand <> '.') using (transcript_id) group by all)"""


def counts(spark, sf_dir):
    return S.site_counts(view(spark, sf_dir, "v_tx"), start="tx_start", end="tx_end")


@query("agg_02_tsstes_counts", with_views(f"{COUNTS_SQL} select * from counts", "v_tx"))
def agg_02(spark, sf_dir):
    return counts(spark, sf_dir)


@query("src_07_tsstes_scan", with_views(f"{COUNTS_SQL} select site_type, chrom, position, unnest(case when plus > minus then ['+'] when plus < minus then ['-'] else ['+', '-'] end) as strand from counts", "v_tx"))
def src_07(spark, sf_dir):
    return S.strand_by_majority(counts(spark, sf_dir))


@query("src_08_tsstes_ref_scan", with_views(f"{COUNTS_SQL} select site_type, chrom, position, case when plus > minus then '+' else '-' end as strand from counts", "v_tx"))
def src_08(spark, sf_dir):
    return S.strand_by_majority(counts(spark, sf_dir), tie="-")


@query("prj_14_site_id", with_views(f"with {SITES_SQL} select transcript_id, chrom || ':' || position || ':' || strand || ':' || site_type as site_id from site", "v_tx"))
def prj_14(spark, sf_dir):
    return tx_sites(spark, sf_dir).select("transcript_id", S.site_id().alias("site_id"))


@query("prj_16_is_novel", with_views("select qry_id, ref_id, ref_id like 'NOVEL\\_TX\\_%' escape '\\' as novel from v_tmap", "v_tmap"))
def prj_16(spark, sf_dir):
    return view(spark, sf_dir, "v_tmap").select("qry_id", "ref_id", S.is_novel(F.col("ref_id")).alias("novel"))


@query(
    "jon_03_nearest_reference",
    with_views(
        f"""with {SITES_SQL}, near as (
          select s.transcript_id, s.site_type, s.chrom, s.position, s.strand,
            (select max(r.position) from v_ref_site r where r.site_type = s.site_type and r.chrom = s.chrom and r.strand = s.strand and r.position <= s.position) as lo,
            (select min(r.position) from v_ref_site r where r.site_type = s.site_type and r.chrom = s.chrom and r.strand = s.strand and r.position >= s.position) as hi from site s)
        select transcript_id, site_type, chrom, position, strand,
          coalesce(case when hi is null or position - lo <= hi - position then lo else hi end, hi, 0) as closest_ref_position,
          coalesce(least(coalesce(position - lo, 1e15::bigint), coalesce(hi - position, 1e15::bigint)) <= 50, false)::int as label from near""",
        "v_tx", "v_ref_site",
    ),
)
def jon_03(spark, sf_dir):
    return S.nearest_reference(tx_sites(spark, sf_dir), view(spark, sf_dir, "v_ref_site"))


NOVEL_REF_SQL = """nref as (select *, case when position % 5 = 0 then 'NOVEL_TX_1' else 'R.1' end as transcript_id from v_ref_site)"""


@query(
    "jon_04_novel_label",
    with_views(
        f"""with {SITES_SQL}, {NOVEL_REF_SQL}
        select s.*, exists (select 1 from nref r where r.transcript_id = 'NOVEL_TX_1' and r.site_type = s.site_type and r.chrom = s.chrom
          and r.strand = s.strand and r.position between s.position - 50 and s.position + 50)::int as novel_label from site s""",
        "v_tx", "v_ref_site",
    ),
)
def jon_04(spark, sf_dir):
    ref = view(spark, sf_dir, "v_ref_site").selectExpr("*", "if(position % 5 = 0, 'NOVEL_TX_1', 'R.1') as transcript_id")
    return S.novel_label(tx_sites(spark, sf_dir), ref)


@query(
    "agg_25_label_rollup",
    with_views(
        f"""with {LABELED_SQL} select site_type, string_agg(distinct chrom, ', ' order by chrom) as assemblers, count(*) as total_candidates,
          count(*) filter (label = 1) as true_sites, count(*) filter (label = 0) as false_sites,
          round(100.0 * count(*) filter (label = 1) / count(*)::double, 2) as true_percentage,
          round(100.0 * count(*) filter (label = 0) / count(*)::double, 2) as false_percentage from labeled group by 1""",
        "v_tx", "v_ref_site",
    ),
)
def agg_25_rollup(spark, sf_dir):
    stats = S.label_stats(labeled_sites(spark, sf_dir), ["site_type", "chrom"])
    return S.label_stats_rollup(stats, ["site_type"], tool="chrom")


#: Assemblers compared with one another.
PAIRS = (("stringtie", "isoquant"), ("stringtie", "scallop2"), ("isoquant", "scallop2"))


def assembly_sites(spark, sf_dir, assembler):
    a = view(spark, sf_dir, "v_assembly").where(F.col("assembler_id") == assembler)
    return a.selectExpr("chrom", "strand", "stack(2, 'TSS', tss, 'TES', tes) as (site_type, position)")


def each_pair(spark, sf_dir, compare):
    """``compare`` of the sites of every two assemblers, with their names."""
    parts = [
        compare(assembly_sites(spark, sf_dir, a), assembly_sites(spark, sf_dir, b)).withColumns({"first": F.lit(a), "second": F.lit(b)})
        for a, b in PAIRS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ASM_SQL = f"""sa as (select distinct assembler_id, site_type, chrom, strand, position from (select assembler_id, 'TSS' as site_type, chrom, strand, tss as position from v_assembly
  union all select assembler_id, 'TES', chrom, strand, tes from v_assembly)), pairs(first, second) as (values {", ".join(map(str, PAIRS))}),
  a as (select p.first, p.second, site_type, chrom, strand, position from sa join pairs p on p.first = assembler_id), b as (select p.first, p.second, site_type, chrom, strand, position from sa join pairs p on p.second = assembler_id)"""
SAME_PLACE = "{0}.first = {1}.first and {0}.second = {1}.second and {0}.site_type = {1}.site_type and {0}.chrom = {1}.chrom and {0}.strand = {1}.strand"


def overlap_sql(symmetric: bool) -> str:
    near = "exists (select 1 from {1} where " + SAME_PLACE + " and {1}.position between {0}.position - 50 and {0}.position + 50)"
    equal = "exists (select 1 from {1} where " + SAME_PLACE + " and {1}.position = {0}.position)"
    return with_views(
        f"""with {ASM_SQL}, c as (
          select first, second, site_type, sum((not h)::int * (side = 1)::int)::bigint as only_first, sum((not h)::int * (side = 2)::int)::bigint as only_second, sum(h::int * (side = 1)::int)::bigint as shared
          from (select a.first, a.second, a.site_type, 1 as side, {near.format("a", "b")} as h from a
                union all select b.first, b.second, b.site_type, 2, {(near if symmetric else equal).format("b", "a")} from b) group by all)
        select first, second, site_type, only_first, only_second, shared as "both", round(only_first * 100.0 / (only_first + only_second + shared)::double, 6) as only_first_pct,
          round(only_second * 100.0 / (only_first + only_second + shared)::double, 6) as only_second_pct, round(shared * 100.0 / (only_first + only_second + shared)::double, 6) as both_pct,
          only_first + only_second + shared as total from c""",
        "v_assembly",
    )


@query("jon_16_site_set_overlap", overlap_sql(False))
def jon_16(spark, sf_dir):
    return each_pair(spark, sf_dir, S.set_overlap)


@query("jon_16_site_set_overlap_symmetric", overlap_sql(True))
def jon_16_symmetric(spark, sf_dir):
    return each_pair(spark, sf_dir, lambda a, b: S.set_overlap(a, b, symmetric=True))


# ---- consensus ----


CONSENSUS_SQL = """t as (select *, tss // 51 as cx, tes // 51 as cy from v_assembly where strand in ('+', '-')),
c as (select chrom, strand, cx, cy, count(*) as n, avg(tss) as mx, avg(tes) as my from t group by all),
p as (select a.chrom, a.strand, a.cx, a.cy, arg_max(b.cx, (b.n, -b.cx, -b.cy)) as gx, arg_max(b.cy, (b.n, -b.cx, -b.cy)) as gy
  from c a join c b on a.chrom = b.chrom and a.strand = b.strand and b.cx between a.cx - 1 and a.cx + 1 and b.cy between a.cy - 1 and a.cy + 1
    and (a.cx <> b.cx or a.cy <> b.cy) and abs(a.mx - b.mx) <= 50 and abs(a.my - b.my) <= 50
    and (b.n > a.n or (b.n = a.n and (b.cx < a.cx or (b.cx = a.cx and b.cy < a.cy)))) group by all),
m as (select c.chrom, c.strand, c.cx, c.cy, case when p.gx is null or q.gx is not null then c.cx else p.gx end as gx, case when p.gx is null or q.gx is not null then c.cy else p.gy end as gy
  from c left join p using (chrom, strand, cx, cy) left join p q on q.chrom = p.chrom and q.strand = p.strand and q.cx = p.gx and q.cy = p.gy),
g as (select t.chrom, t.strand, gx, gy, round_even(avg(tss), 0)::bigint as tss_center, round_even(avg(tes), 0)::bigint as tes_center, count(distinct assembler_id)::int as support_assemblers,
    string_agg(distinct assembler_id, ',' order by assembler_id) as assemblers, min((assembler_id, transcript_id)) as rep, min((assembly_ord, file_ord)) as created
  from t join m using (chrom, strand, cx, cy) group by t.chrom, t.strand, gx, gy)"""


@query(
    "agg_43_consensus_groups",
    with_views(
        f"with {CONSENSUS_SQL} select chrom, strand, tss_center, tes_center, support_assemblers, assemblers, rep[2] as transcript_id from g",
        "v_assembly",
    ),
)
def agg_43(spark, sf_dir):
    groups = N.consensus_groups(view(spark, sf_dir, "v_assembly"))
    return N.consensus_summary(groups).select(
        "chrom", "strand", "tss_center", "tes_center", "support_assemblers", "assemblers", "rep.transcript_id"
    )


def annotated_ends(spark, sf_dir):
    a = view(spark, sf_dir, "v_assembly").where("assembler_id = 'scallop2' and file_ord % 3 = 0")
    return a.select("chrom", "strand", "tss", "tes")


@query(
    "jon_11_annotation_anti",
    with_views(
        """select transcript_id, chrom, strand, tss as tss_center, tes as tes_center from v_assembly g where assembler_id <> 'scallop2' and not exists (
          select 1 from v_assembly a where a.assembler_id = 'scallop2' and a.file_ord % 3 = 0 and a.chrom = g.chrom and a.strand = g.strand
            and abs(a.tss - g.tss) <= 50 and abs(a.tes - g.tes) <= 50)""",
        "v_assembly",
    ),
)
def jon_11(spark, sf_dir):
    g = view(spark, sf_dir, "v_assembly").where("assembler_id <> 'scallop2'")
    named = g.selectExpr("transcript_id", "chrom", "strand", "tss as tss_center", "tes as tes_center")
    return N.annotation_match(named, annotated_ends(spark, sf_dir))


NOVEL_SQL = with_views(
    f"""with {CONSENSUS_SQL},
    k as (select *, chrom || '|' || strand || '|' || tss_center || '|' || tes_center as canonical_key, exists (select 1 from v_assembly a where a.assembler_id = 'scallop2'
      and a.file_ord % 3 = 0 and a.chrom = g.chrom and a.strand = g.strand and abs(a.tss - g.tss_center) <= 50 and abs(a.tes - g.tes_center) <= 50) as ann from g),
    f as (select *, min(case when support_assemblers >= 2 and not ann then created end) over (partition by canonical_key) as first_created from k),
    r as (select *, case when support_assemblers < 2 then 'support_below_min' when ann then 'annotation_match' when created <> first_created then 'duplicate_novel_key' end as reason,
      upper(substr(sha1(canonical_key), 1, 16)) as h from f)
    select reason, case when reason is null then 'NOVEL_GENE_' || h end as new_gene_id, case when reason is null then 'NOVEL_TX_' || h end as new_transcript_id, chrom, strand, tss_center, tes_center,
      support_assemblers, assemblers, rep[1] as representative_assembler, rep[2] as representative_transcript_id, canonical_key from r""",
    "v_assembly",
)


@query("agg_44_novel_select", NOVEL_SQL)
def agg_44(spark, sf_dir):
    groups = N.consensus_summary(N.consensus_groups(view(spark, sf_dir, "v_assembly")))
    return N.select_novel(groups, annotated_ends(spark, sf_dir)).drop("created")


@query(
    "prj_15_novel_ids",
    with_views(
        "select transcript_id, 'NOVEL_GENE_' || h as new_gene_id, 'NOVEL_TX_' || h as new_transcript_id from (select transcript_id, upper(substr(sha1(chrom || '|' || strand || '|' || tss || '|' || tes), 1, 16)) as h from v_assembly)",
        "v_assembly",
    ),
)
def prj_15(spark, sf_dir):
    gene, tx = N.novel_ids(N.novel_key(F.col("chrom"), F.col("strand"), F.col("tss"), F.col("tes")))
    return view(spark, sf_dir, "v_assembly").select("transcript_id", gene.alias("new_gene_id"), tx.alias("new_transcript_id"))


@query(
    "set_01_union_dedupe",
    with_views(
        """select chrom, strand, tss, assembler_id, tes from (select *, row_number() over (partition by chrom, strand, tss order by assembly_ord, assembler_id, tes) as rn
             from v_assembly) where rn = 1""",
        "v_assembly",
    ),
)
def set_01(spark, sf_dir):
    a = view(spark, sf_dir, "v_assembly")
    parts = [
        a.where(F.col("assembler_id") == name).select("chrom", "strand", "tss", "assembler_id", "tes")
        for name in ("stringtie", "isoquant", "scallop2")
    ]
    return N.union_first(parts, ["chrom", "strand", "tss"])


@query(
    "set_03_intersect_except",
    with_views(
        f"""with {ASM_SQL} select 'common' as kind, * from (select * from a intersect select * from b)
        union all select 'first_only', * from (select * from a except select * from b)""",
        "v_assembly",
    ),
)
def set_03(spark, sf_dir):
    def kinds(a, b):
        columns = ["site_type", "chrom", "strand", "position"]
        a, b = a.select(*columns), b.select(*columns)
        common = a.intersect(b).withColumn("kind", F.lit("common"))
        return common.unionByName(a.subtract(b).withColumn("kind", F.lit("first_only")))

    return each_pair(spark, sf_dir, kinds)


@query(
    "set_04_distinct_coordinates",
    with_views("select assembler_id, count(*) as rows, count(distinct (chrom, tss, strand)) as coordinates from v_assembly group by 1", "v_assembly"),
)
def set_04(spark, sf_dir):
    return view(spark, sf_dir, "v_assembly").groupBy("assembler_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct("chrom", "tss", "strand")).alias("coordinates")
    )


@query(
    "set_05_annotation_union",
    lines_sql("""select 0 as part, line_no, value from p where feature = 'transcript' union all select 1, line_no, value from p where feature = 'exon'"""),
)
def set_05(spark, sf_dir):
    lines = gtf_lines(spark, sf_dir)
    return N.union_annotation(lines.where("feature = 'transcript'"), lines.where("feature = 'exon'"))
