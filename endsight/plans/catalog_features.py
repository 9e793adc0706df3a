"""Queries on reads and site features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endsight.functions import reads as R
from endsight.functions import sequences as Q
from endsight.operators import features as X
from endsight.plans.catalog import ORACLES, query, r6
from endsight.plans.catalog_sites import SITES_SQL, tx_sites
from endsight.plans.views import table, view, with_views

CFG = X.FeatureConfig()


def alignments(spark, sf_dir) -> DataFrame:
    """v_aln with a full read sequence in place of the two clip columns."""
    aligned = F.repeat(F.lit("A"), (F.col("m1") + F.col("m2")).cast("int"))
    return view(spark, sf_dir, "v_aln").withColumn(
        "seq", F.concat("left_seq", aligned, "right_seq")
    )


# Oracle text: usable reads, distinct coordinates and overlapping pairs.
READS_SQL = """
rd as (select *, case when ts is null then (case when is_reverse then '-' else '+' end)
                      when ts = '+' then (case when is_reverse then '-' else '+' end)
                      else (case when is_reverse then '+' else '-' end) end as read_strand
       from v_aln where mapq >= 10)"""
PAIRS_SQL = f"""{SITES_SQL},
coord as (select distinct chrom, position, strand from site),
{READS_SQL},
pair as (
  select c.chrom, c.position, c.strand, r.ref_start, r.ref_end, r.read_strand, r.mapq,
         r.left_clip, r.right_clip, r.m1, r.n as intron,
         case when r.read_strand = '+' then r.ref_start else r.ref_end end as s,
         case when r.read_strand = '+' then r.ref_end else r.ref_start end as e,
         case when r.read_strand = '+' then r.left_clip else r.right_clip end as cs,
         case when r.read_strand = '+' then r.right_clip else r.left_clip end as ce
  from coord c join rd r on r.chrom = c.chrom
   and r.ref_end > greatest(0, c.position - 100) and r.ref_start < c.position + 100)"""


def rnd(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def per_site(columns: dict[str, str], extra: str = "", source: str = "pair") -> str:
    """Oracle SQL: aggregate pairs per coordinate, left join, default 0 (300 for splices)."""
    inner = ", ".join(f"{e} as {c}" for c, e in columns.items())
    outer = ", ".join(
        f"coalesce(a.{c}, {300 if c == 'nearest_splice_dist' else 0}) as {c}" for c in columns
    )
    return with_views(
        f"""with {PAIRS_SQL}{extra},
        agg as (select chrom, position, strand, {inner} from {source} group by chrom, position, strand)
        select c.chrom, c.position, c.strand, {outer}
        from coord c left join agg a using (chrom, position, strand)""",
        "v_tx",
        "v_aln",
    )


def _pairs(spark, sf_dir):
    where = tx_sites(spark, sf_dir).select(*X.SITE).distinct()
    return where, X.site_read_overlap(where, X.read_spans(alignments(spark, sf_dir), CFG), CFG)


def _select(where: DataFrame, features: DataFrame, names: list[str], keys=X.SITE) -> DataFrame:
    joined = where.join(features.select(*keys, *names), list(keys), "left")
    joined = joined.fillna(300, [c for c in names if c == "nearest_splice_dist"]).fillna(
        0, [c for c in names if c != "nearest_splice_dist"]
    )
    doubles = {c for c, t in joined.dtypes if t == "double"}
    return joined.select(*X.SITE, *[r6(c).alias(c) if c in doubles else c for c in names])


def _features(spark, sf_dir, parts: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Distinct sites, and the features that the named parts of the block sums give."""
    where = tx_sites(spark, sf_dir).select(*X.SITE).distinct()
    parsed = X.usable_reads(alignments(spark, sf_dir), CFG)
    return where, X.read_features(X.site_sums(where, parsed, CFG, parts), CFG)


def from_sums(names: list[str], parts: tuple[str, ...]):
    def run(spark, sf_dir):
        return _select(*_features(spark, sf_dir, parts), names)

    return run


def register_sums(
    name: str, columns: dict[str, str], extra: str = "", source: str = "pair", *, parts: tuple[str, ...] = ()
) -> None:
    query(name, per_site(columns, extra, source))(from_sums(list(columns), parts))


PAIR_COLUMNS = ["chrom", "position", "strand", "ref_start", "ref_end", "read_strand"]


@query(
    "prj_08_read_strand",
    with_views(f"with {READS_SQL} select read_id, chrom, ref_start, read_strand from rd", "v_aln"),
)
def prj_08(spark, sf_dir):
    reads = view(spark, sf_dir, "v_aln").where(F.col("mapq") >= CFG.min_mapq)
    strand = R.read_strand(F.col("ts"), F.col("is_reverse"))
    return reads.select("read_id", "chrom", "ref_start", strand.alias("read_strand"))


@query(
    "prj_09_soft_clip_ends",
    with_views(
        f"""with {READS_SQL} select chrom, ref_start, ref_end, read_strand,
          case when read_strand = '+' then left_clip else right_clip end as start_clip,
          case when read_strand = '+' then right_clip else left_clip end as end_clip,
          case when read_strand = '+' then left_seq else right_seq end as start_seq,
          case when read_strand = '+' then right_seq else left_seq end as end_seq
        from rd""",
        "v_aln",
    ),
)
def prj_09(spark, sf_dir):
    usable = X.usable_reads(alignments(spark, sf_dir), CFG)
    plus = F.col("read_strand") == "+"
    start = F.when(plus, F.col("left_seq")).otherwise(F.col("right_seq"))
    end = F.when(plus, F.col("right_seq")).otherwise(F.col("left_seq"))
    return usable.select(
        "chrom", "ref_start", "ref_end", "read_strand",
        F.length(start).cast("bigint").alias("start_clip"),
        F.length(end).cast("bigint").alias("end_clip"),
        start.alias("start_seq"), end.alias("end_seq"),
    )


@query(
    "src_04_alignment_cigar",
    with_views(
        """select read_id, ref_start, ref_start + m1 + n + m2 as ref_end,
             cast((left_clip > 0)::int + 2 + (n > 0)::int + (right_clip > 0)::int as int) as operations,
             left_clip + m1 + m2 + n + right_clip as total_length from v_aln""",
        "v_aln",
    ),
)
def src_04(spark, sf_dir):
    parsed = alignments(spark, sf_dir).withColumn("ops", R.parse_cigar(F.col("cigar")))
    return parsed.select(
        "read_id",
        "ref_start",
        (F.col("ref_start") + R.reference_span(F.col("ops"))).alias("ref_end"),
        F.size("ops").alias("operations"),
        F.aggregate("ops", F.lit(0).cast("bigint"), lambda a, c: a + c["len"]).alias("total_length"),
    )


@query(
    "jon_01_site_read_overlap",
    with_views(
        f"""with {PAIRS_SQL} select {', '.join(PAIR_COLUMNS)}, count(*) as n from pair group by all""",
        "v_tx",
        "v_aln",
    ),
)
def jon_01(spark, sf_dir):
    _, pairs = _pairs(spark, sf_dir)
    return pairs.select(*PAIR_COLUMNS, "n")


register_sums(
    "agg_04_site_counts",
    {
        "total_reads": "count(*)",
        "read_start_density": "count(*) filter (abs(s - position) <= 100)",
        "read_end_density": "count(*) filter (abs(e - position) <= 100)",
        "strand_ratio": rnd(
            "count(*) filter (read_strand = strand)::double / greatest(count(*) filter (read_strand <> strand), 1)"
        ),
    },
)


@query(
    "agg_05_clip_length_stats",
    per_site(
        {
            "start_soft_clip_mean": rnd("avg(cs)"),
            "end_soft_clip_mean": rnd("avg(ce)"),
            "start_soft_clip_max": "max(cs)::double",
            "end_soft_clip_max": "max(ce)::double",
            "start_soft_clip_median": "median(cs)::double",
            "end_soft_clip_median": "median(ce)::double",
            "start_soft_clip_count": "count(*)",
            "end_soft_clip_count": "count(*)",
        }
    ),
)
def agg_05(spark, sf_dir):
    names = [f"{end}_soft_clip_{stat}" for end in ("start", "end") for stat in ("mean", "max", "median", "count")]
    return _select(*_features(spark, sf_dir, ("clips",)), names)


register_sums(
    "agg_06_mapq_stats", {"mean_mapq": rnd("avg(mapq)"), "std_mapq": rnd("stddev_pop(mapq)")}, parts=("mapq",)
)

# Overlap with one flank, counted only when a read end lies inside it.
FLANK = """coalesce(sum(case when (ref_start >= position{lo} and ref_start < position{hi})
    or (ref_end > position{lo} and ref_end <= position{hi})
    then greatest(least(ref_end, position{hi}) - greatest(ref_start, position{lo}), 0) end), 0)"""
LEFT, RIGHT = FLANK.format(lo="-100", hi=""), FLANK.format(lo="", hi="+100")
BEFORE = f"(case when strand = '+' then {LEFT} else {RIGHT} end)::double"
AFTER = f"(case when strand = '+' then {RIGHT} else {LEFT} end)::double"

register_sums(
    "agg_07_coverage_before_after",
    {"coverage_before": BEFORE, "coverage_after": AFTER, "delta_coverage": f"{AFTER} - {BEFORE}"},
    parts=("flanks",),
)


@query(
    "agg_08_nearest_splice",
    per_site({
        "nearest_splice_dist": """least(300, coalesce(min(case when intron > 0 then
        least(abs(position - (ref_start + left_clip + m1)), abs(position - (ref_start + left_clip + m1 + intron))) end), 300))"""
    }),
)
def agg_08(spark, sf_dir):
    return _select(*_features(spark, sf_dir, ("splice",)), ["nearest_splice_dist"])


register_sums(
    "agg_09_softclip_bias",
    {
        "softclip_bias": rnd(
            """coalesce(count(*) filter (read_strand = strand and ((left_clip > 0 and abs(ref_start - position) <= 5)
            or (right_clip > 0 and abs(ref_end - position) <= 5)))::double
            / nullif(count(*) filter (read_strand = strand), 0), 0)"""
        )
    },
    parts=("bias",),
)

HISTOGRAMS = """,
hs as (select chrom, position, strand, 's' as kind, s as v, count(*) as c from pair group by all
       union all select chrom, position, strand, 'e', e, count(*) from pair group by all),
hp as (select *, c::double / sum(c) over (partition by chrom, position, strand, kind) as p from hs)"""


@query(
    "agg_10_position_entropy",
    per_site(
        {
            "start_entropy": rnd("-sum(p * log2(p)) filter (kind = 's')"),
            "end_entropy": rnd("-sum(p * log2(p)) filter (kind = 'e')"),
        },
        HISTOGRAMS,
        "hp",
    ),
)
def agg_10(spark, sf_dir):
    return _select(*_features(spark, sf_dir, ("entropy",)), ["start_entropy", "end_entropy"])


GRID = """,
bins as (select p.chrom, p.position, p.strand, g.o,
                sum(greatest(least(ref_end, position + g.o + 10) - greatest(ref_start, position + g.o), 0)) as cov
         from pair p cross join (select unnest(range(-100, 101, 10)) as o) g group by all),
steps as (select *, cov - lag(cov) over (partition by chrom, position, strand order by o) as step from bins)"""
register_sums(
    "agg_11_coverage_gradient",
    {
        "coverage_gradient_sharpness": rnd(
            """(case when strand = '-' and max(-step) > 0 then max(-step) else max(abs(step)) end / 10.0::double)
            / greatest(sum(cov) / 210.0::double, 1.0)"""
        ),
        "max_coverage_gradient": rnd("max(abs(step)) / 10.0::double"),
        "local_avg_coverage": rnd("sum(cov) / 210.0::double"),
    },
    GRID,
    "steps",
    parts=("grid",),
)
register_sums(
    "agg_12_start_moments",
    {
        "read_start_variance": rnd("var_pop(s - position)"),
        "read_start_coefficient_variation": rnd("var_pop(s - position) / greatest(avg(s), 1.0)"),
        "weighted_read_start_density": rnd("sum(1.0::double / greatest(abs(s - position), 1))"),
        "read_start_clustering": rnd("count(*) filter (abs(s - position) <= 5)::double / count(*)"),
        "up_down_stream_ratio": rnd(
            "count(*) filter (s < position)::double / greatest(count(*) filter (s > position), 1)"
        ),
    },
    parts=("starts",),
)
SLOPE = """,
starts as (select p.chrom, p.position, p.strand, g.i,
             count(*) filter (s >= position - 50 + 10 * g.i and s < position - 40 + 10 * g.i) as c
           from pair p cross join (select unnest(range(0, 11)) as i) g group by all)"""
register_sums(
    "agg_13_degradation_slope",
    {
        "five_prime_degradation_score": rnd(
            "case when sum(c) = 0 then 0.0 else -regr_slope(c::double, i::double) end"
        )
    },
    SLOPE,
    "starts",
    parts=("starts",),
)
CLIPS = """,
lens as (select chrom, position, strand, cs as l from pair union all select chrom, position, strand, ce from pair)"""
MEAN = "(sum(l) / count(*)::double)"
SECOND = "(sum(l * l)::double / count(*)::double)"
THIRD = "(sum(l * l * l)::double / count(*)::double)"
SKEWNESS = {
    "softclip_length_variance": rnd(f"{SECOND} - {MEAN} * {MEAN}"),
    "softclip_length_skewness": rnd(
        f"""case when count(*) < 3 or max(l) = min(l) then 0.0
        else ({THIRD} - 3 * {MEAN} * {SECOND} + 2 * {MEAN} * {MEAN} * {MEAN}) / pow({SECOND} - {MEAN} * {MEAN}, 1.5) end"""
    ),
}


# raw moments on both sides: rational skewness values often end in rounding ties
@query("agg_14_skewness", per_site(SKEWNESS, CLIPS, "lens"))
def agg_14(spark, sf_dir):
    where, moments = _features(spark, sf_dir, ("clips",))
    joined = where.join(moments.select(*X.SITE, *SKEWNESS), list(X.SITE), "left").fillna(0, list(SKEWNESS))
    return joined.select(*X.SITE, *[(r6(c) + 0.0).alias(c) for c in SKEWNESS])


register_sums(
    "agg_15_ratio_features",
    {
        "coverage_ratio": rnd(f"{AFTER} / greatest({BEFORE}, 1.0)"),
        "coverage_log_ratio": rnd(
            f"case when {BEFORE} > 0 then log2(greatest({AFTER}, 1.0) / greatest({BEFORE}, 1.0)) else 0.0 end"
        ),
        "normalized_delta_coverage": rnd(f"({AFTER} - {BEFORE}) / greatest({AFTER} + {BEFORE}, 1.0)"),
        "norm_read_density": rnd(f"count(*) / greatest({AFTER}, 1.0)"),
        "coverage_efficiency": rnd(f"count(*) / greatest({AFTER} + {BEFORE}, 1.0)"),
        "softclip_sparsity": "(2.0 * count(*) / greatest(count(*), 1))::double",
    },
    parts=("flanks",),
)

# Clip sequences whose read end lies within 10 bp of the site.
CLIP_SQL = f"""{SITES_SQL},
coord as (select distinct chrom, position, strand from site),
clip as (select chrom, ref_start as cp, upper(left_seq) as seq from v_aln where mapq >= 10 and left_clip > 0
         union all select chrom, ref_end, upper(right_seq) from v_aln where mapq >= 10 and right_clip > 0),
near as (select c.chrom, c.position, c.strand, k.seq from coord c join clip k
         on k.chrom = c.chrom and k.cp between c.position - 10 and c.position + 10)"""


def clip_sql(columns: dict[str, str], extra: str = "", source: str = "near") -> str:
    inner = ", ".join(f"{e} as {c}" for c, e in columns.items())
    outer = ", ".join(f"coalesce(a.{c}, 0.0) as {c}" for c in columns)
    return with_views(
        f"""with {CLIP_SQL}{extra},
        agg as (select chrom, position, strand, {inner} from {source} group by chrom, position, strand)
        select c.chrom, c.position, c.strand, {outer}
        from coord c left join agg a using (chrom, position, strand)""",
        "v_tx",
        "v_aln",
    )


def letters(cond: str) -> str:
    return f"sum(length(seq) - length(regexp_replace(seq, '[{cond}]', '', 'g')))::double"


def run_length(base: str) -> str:
    return f"max(coalesce(list_max([length(x) for x in regexp_extract_all(seq, '{base}+')]), 0))::double"


COMPOSITION = {
    "avg_clip_length": rnd("avg(length(seq))"),
    "max_clip_length": "max(length(seq))::double",
    "num_clips": "count(*)::double",
    "gc_content": rnd(f"{letters('GC')} / sum(length(seq))"),
    "purine_ratio": rnd(f"{letters('AG')} / sum(length(seq))"),
    **{f"max_poly{b}": run_length(b) for b in "ACGT"},
}


@query("agg_16_clip_seq_summary", clip_sql(COMPOSITION))
def agg_16(spark, sf_dir):
    where = tx_sites(spark, sf_dir).select(*X.SITE).distinct()
    clips = X.clip_sequences(alignments(spark, sf_dir), CFG)
    return _select(where, X.clip_profile(where, clips, CFG, kmers=False), list(COMPOSITION), ("chrom", "position"))


KMERS_SQL = """,
words as (select chrom, position, strand, unnest(regexp_extract_all(substr(seq, o), '...')) as w
          from near cross join (select unnest([1, 2, 3]) as o)),
tally as (select chrom, position, strand, w, count(*) as c from words
          where regexp_full_match(w, '[ATGC]+') group by all),
counted as (select *, c::double / sum(c) over (partition by chrom, position, strand) as p,
              length(regexp_replace(w, '[AT]', '', 'g')) / 3.0::double as gc,
              length(regexp_replace(w, '[CT]', '', 'g')) / 3.0::double as pu,
              w in ('AAA', 'CCC', 'GGG', 'TTT') as rep
            from tally)"""
KMER_COLUMNS = {
    "k3_gc_kmers_ratio": rnd("coalesce(sum(c) filter (gc >= 0.5), 0)::double / sum(c)"),
    "k3_kmer_diversity": rnd("count(*)::double / sum(c)"),
    "k3_kmer_entropy": rnd("-sum(p * log2(p))"),
    "k3_most_frequent_kmer_ratio": rnd("max(c)::double / sum(c)"),
    "k3_unique_kmers": "count(*)::double",
    "k3_at_rich_kmers": "coalesce(sum(c) filter (not rep and gc < 0.4), 0)::double",
    "k3_gc_rich_kmers": "coalesce(sum(c) filter (not rep and gc > 0.6), 0)::double",
    "k3_purine_rich_kmers": "coalesce(sum(c) filter (pu > 0.6), 0)::double",
    "k3_repeat_kmers": "coalesce(sum(c) filter (rep), 0)::double",
    **{f"kmer_{m}": f"coalesce(sum(c) filter (w = '{m}'), 0)::double" for m in Q.TRACKED_3MERS},
}


@query("agg_17_kmer_stats", clip_sql(KMER_COLUMNS, KMERS_SQL, "counted"))
def agg_17(spark, sf_dir):
    where = tx_sites(spark, sf_dir).select(*X.SITE).distinct()
    clips = X.clip_sequences(alignments(spark, sf_dir), CFG)
    return _select(where, X.clip_profile(where, clips, CFG), list(KMER_COLUMNS), ("chrom", "position"))


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.upper("text").alias("seq"))


@query(
    "prj_26_gc_purine",
    """select doc_id, round(coalesce((length(t) - length(regexp_replace(t, '[GC]', '', 'g')))::double / nullif(length(t), 0), 0), 6) as gc_content,
              round(coalesce((length(t) - length(regexp_replace(t, '[AG]', '', 'g')))::double / nullif(length(t), 0), 0), 6) as purine_ratio
       from (select doc_id, upper(replace(text, 'ß', 'ss')) as t from documents)""",
)
def prj_26(spark, sf_dir):
    seq = F.col("seq")

    def share(letters_: str):
        return r6(F.coalesce(F.try_divide(Q.count_of(seq, letters_), F.length(seq)), F.lit(0.0)))

    return texts(spark, sf_dir).select(
        "doc_id", share("GC").alias("gc_content"), share("AG").alias("purine_ratio")
    )


@query(
    "prj_27_homopolymer_run",
    "select doc_id, "
    + ", ".join(
        f"coalesce(list_max([length(x) for x in regexp_extract_all(upper(replace(text, 'ß', 'ss')), '{b}+')]), 0)::int as max_poly{b}"
        for b in "ACGT"
    )
    + " from documents",
)
def prj_27(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "doc_id", *[Q.longest_run(F.col("seq"), b).alias(f"max_poly{b}") for b in Q.BASES]
    )


@query(
    "prj_28_kmer_explode",
    """select doc_id, w as kmer, count(*) as n from (
         select doc_id, unnest(regexp_extract_all(substr(t, o), '(?s)...')) as w
         from (select doc_id, upper(replace(text, 'ß', 'ss')) as t from documents)
         cross join (select unnest([1, 2, 3]) as o))
       where regexp_full_match(w, '[ATGC]+') group by all""",
)
def prj_28(spark, sf_dir):
    words = texts(spark, sf_dir).select("doc_id", F.explode(Q.kmers(F.col("seq"), 3)).alias("kmer"))
    return words.groupBy("doc_id", "kmer").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj_29_reverse_complement",
    """select doc_id, translate(reverse(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^ACGT]', 'N', 'g')), 'ACGT', 'TGCA') as revcomp
       from documents""",
)
def prj_29(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", Q.reverse_complement(F.col("seq")).alias("revcomp"))


@query("job_site_feature_table")
def feature_table(spark, sf_dir):
    """The complete feature table of every candidate site."""
    return X.site_features(tx_sites(spark, sf_dir), alignments(spark, sf_dir), CFG)


FEATURE_QUERIES = (
    "agg_04_site_counts", "agg_05_clip_length_stats", "agg_06_mapq_stats", "agg_07_coverage_before_after",
    "agg_08_nearest_splice", "agg_09_softclip_bias", "agg_10_position_entropy", "agg_11_coverage_gradient",
    "agg_12_start_moments", "agg_13_degradation_slope", "agg_14_skewness", "agg_15_ratio_features",
    "agg_16_clip_seq_summary", "agg_17_kmer_stats",
)


def feature_table_sql() -> str:
    """Every site with the columns of all feature oracles."""
    joins = " ".join(
        f"join ({ORACLES[name]}) f{i} using (chrom, position, strand)" for i, name in enumerate(FEATURE_QUERIES)
    )
    sites = with_views(
        f"with {SITES_SQL} select transcript_id, site_type, chrom, position, strand from site", "v_tx"
    )
    return f"select * from ({sites}) s {joins}"


@query("snk_02_feature_table", feature_table_sql())
def snk_02(spark, sf_dir):
    """The feature table as it is written, doubles at six places."""
    features = X.site_features(tx_sites(spark, sf_dir), alignments(spark, sf_dir), CFG)
    keys = ["transcript_id", "site_type", *X.SITE]
    doubles = {c for c, t in features.dtypes if t == "double"}
    names = [c for c in features.columns if c not in keys]
    return features.select(*keys, *[(r6(c) + 0.0).alias(c) if c in doubles else c for c in names])
