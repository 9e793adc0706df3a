"""Operators that rewrite annotation files and extend a reference with novel transcripts.

Annotation lines are rows ``line_no, value, n_columns, chrom, feature, start, end,
strand, attrs, transcript_id, gene_id`` as returned by :func:`endsight.sources.gtf.read_gtf`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from endsight.functions.attributes import set_attribute, set_coverage
from endsight.operators.scale import cut_lineage, skew_join
from endsight.operators.sites import LABEL_TOLERANCE

# Id prefixes of added transcripts and the smallest supporting set.
NOVEL_GENE, NOVEL_TX = "NOVEL_GENE_", "NOVEL_TX_"
MIN_SUPPORT = 2
COLUMNS = 9


def filter_by_score(lines: DataFrame, ranked: DataFrame, threshold: float) -> DataFrame:
    """Keep the lines of transcripts with ``pred_prob >= threshold``.

    Comments and short lines stay.  A gene line stays when it has no gene id or its
    gene has a kept transcript; a line without transcript id follows its gene.
    """
    kept_tx = (
        ranked.where(F.col("pred_prob") >= threshold)
        .select("transcript_id", F.lit(True).alias("_kt"))
        .distinct()
    )
    kept_genes = (
        lines.where("feature = 'transcript' and gene_id is not null")
        .join(kept_tx, "transcript_id", "left_semi")
        .select("gene_id", F.lit(True).alias("_kg"))
        .distinct()
    )
    marked = skew_join(skew_join(lines, kept_tx, ["transcript_id"]), kept_genes, ["gene_id"])
    keep = F.expr(
        f"""case when value like '#%' or n_columns < {COLUMNS} then true
                 when feature = 'gene' then gene_id is null or coalesce(_kg, false)
                 when transcript_id is not null then coalesce(_kt, false)
                 else coalesce(_kg, false) end"""
    )
    return marked.where(keep).select(*lines.columns)


def filter_by_contig(lines: DataFrame, contigs: DataFrame) -> DataFrame:
    """Keep the lines of transcripts on the listed contigs with a known strand.

    Comments and empty lines stay, short lines and lines without a transcript id go.
    """
    allowed = contigs.select("chrom").distinct()
    known = lines.where(f"feature = 'transcript' and n_columns >= {COLUMNS} and strand <> '.'")
    kept = (
        skew_join(known.select("chrom", "transcript_id"), allowed, ["chrom"], "inner")
        .select("transcript_id", F.lit(True).alias("_kept"))
        .where("transcript_id is not null")
        .distinct()
    )
    marked = skew_join(lines, kept, ["transcript_id"])
    return marked.where(
        f"value = '' or value like '#%' or (n_columns >= {COLUMNS} and coalesce(_kept, false))"
    ).select(*lines.columns)


def _with_attributes(value: Column, attrs: Column) -> Column:
    """The line with its attribute column replaced; columns after it stay, however many."""
    columns = F.split(value, "\t")
    return F.concat_ws(
        "\t",
        F.array_join(F.slice(columns, 1, COLUMNS - 1), "\t"),
        attrs,
        F.when(F.size(columns) > COLUMNS, F.array_join(F.slice(columns, F.lit(COLUMNS + 1), F.size(columns)), "\t")),
    )


def inject_score(lines: DataFrame, scores: DataFrame) -> DataFrame:
    """Write ``score`` as coverage into the transcript lines that have one.

    ``scores`` has one row per ``transcript_id``.
    """
    new = scores.select("transcript_id", F.col("score").alias("_new"))
    marked = skew_join(lines, new, ["transcript_id"])
    rewritten = set_coverage(F.col("attrs"), F.col("_new"))
    change = F.col("_new").isNotNull() & (F.col("feature") == "transcript")
    attrs = F.when(change, rewritten).otherwise(F.col("attrs"))
    value = F.when(change, _with_attributes(F.col("value"), attrs)).otherwise(F.col("value"))
    return marked.withColumns({"value": value, "attrs": attrs}).select(*lines.columns)


# ---- consensus of several assemblies ----


def consensus_cells(
    transcripts: DataFrame, *, by: Sequence[str] = (), tolerance: int = LABEL_TOLERANCE
) -> DataFrame:
    """Target cell (``_gx, _gy``) of every occupied grid cell (``_cx, _cy``).

    Cells are as wide as the tolerance, so transcripts of one cell are within it of each other in both
    ends.  A cell outranks a neighbour whose mean ends are within the tolerance of its own if
    it holds more transcripts, or as many at smaller coordinates.  A cell that nothing outranks
    is a peak; a cell whose highest-ranking neighbour is a peak joins it; any other stands alone.
    """
    keys = [*by, "chrom", "strand"]
    cells = (
        transcripts.where(F.col("strand").isin("+", "-"))
        .selectExpr(*keys, "tss", "tes", *_cell_columns(tolerance))
        .groupBy(*keys, "_cx", "_cy")
        .agg(F.count(F.lit(1)).alias("_n"), F.avg("tss").alias("_mx"), F.avg("tes").alias("_my"))
    )
    around = cells.selectExpr(
        "*", "explode(array(-1, 0, 1)) as _dx"
    ).selectExpr("*", "explode(array(-1, 0, 1)) as _dy").where("_dx <> 0 or _dy <> 0")
    a = around.selectExpr(*keys, "_cx", "_cy", "_n", "_mx", "_my", "_cx + _dx as _bx", "_cy + _dy as _by")
    other = cells.selectExpr(*keys, "_cx as _bx", "_cy as _by", "_n as _bn", "_mx as _bmx", "_my as _bmy")
    higher = a.join(other, [*keys, "_bx", "_by"]).where(
        f"abs(_mx - _bmx) <= {tolerance} and abs(_my - _bmy) <= {tolerance} and "
        "(_bn > _n or (_bn = _n and (_bx < _cx or (_bx = _cx and _by < _cy))))"
    )
    best = higher.groupBy(*keys, "_cx", "_cy").agg(F.expr("max(struct(_bn, -_bx as x, -_by as y)) as _best"))
    outranked = best.selectExpr(*keys, "_cx as _gx", "_cy as _gy")
    joins = best.selectExpr(*keys, "_cx", "_cy", "-_best.x as _gx", "-_best.y as _gy").join(
        outranked, [*keys, "_gx", "_gy"], "left_anti"
    )
    return cells.join(joins, [*keys, "_cx", "_cy"], "left").selectExpr(
        *keys, "_cx", "_cy", "coalesce(_gx, _cx) as _gx", "coalesce(_gy, _cy) as _gy"
    )


def _cell_columns(tolerance: int) -> list[str]:
    return [f"bigint(floor(tss / {tolerance + 1})) as _cx", f"bigint(floor(tes / {tolerance + 1})) as _cy"]


def consensus_groups(
    transcripts: DataFrame, *, by: Sequence[str] = (), tolerance: int = LABEL_TOLERANCE
) -> DataFrame:
    """Assign each transcript to the consensus group (``component``) of its cell.

    ``transcripts`` has ``assembler_id, assembly_ord, file_ord, transcript_id, chrom, strand, tss, tes``.
    The rule does not depend on the order of the rows: it replaces a greedy walk in file order, whose groups it
    matches where groups are further apart than the tolerance.  Rows meet by cell, never by locus.
    """
    keys = [*by, "chrom", "strand", "_cx", "_cy"]
    placed = transcripts.where(F.col("strand").isin("+", "-")).selectExpr("*", *_cell_columns(tolerance))
    cells = consensus_cells(transcripts, by=by, tolerance=tolerance)
    joined = skew_join(placed, cells, keys, "inner")
    return joined.withColumn("component", F.concat_ws(":", "_gx", "_gy")).select(*transcripts.columns, "component")


def consensus_summary(grouped: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """One row per consensus group: mean centre, support, representative, creation order."""
    keys = [*by, "chrom", "strand", "component"]
    return grouped.groupBy(*keys).agg(
        F.expr("bigint(bround(avg(tss), 0)) as tss_center"),
        F.expr("bigint(bround(avg(tes), 0)) as tes_center"),
        F.expr("size(collect_set(assembler_id)) as support_assemblers"),
        F.expr("array_join(array_sort(collect_set(assembler_id)), ',') as assemblers"),
        F.expr("min(struct(assembler_id, transcript_id)) as rep"),
        F.expr("min(struct(assembly_ord, file_ord)) as created"),
    )


def annotation_match(
    groups: DataFrame, annotation: DataFrame, *, by: Sequence[str] = (), tolerance: int = LABEL_TOLERANCE, how: str = "left_anti"
) -> DataFrame:
    """Groups without (``left_anti``) or with (``left_semi``) an annotated transcript near both ends.

    Distinct annotated end pairs are placed in every cell of a square grid that their
    tolerance box touches (at most four); a group looks up its own cell.
    """
    width = max(1024, 2 * tolerance + 1)
    near = {
        end: f"explode(sequence(floor(({end} - {tolerance}) / {width}), floor(({end} + {tolerance}) / {width})))"
        for end in ("tss", "tes")
    }
    known = (
        annotation.where("strand in ('+', '-')")
        .selectExpr(*by, "chrom", "strand", "tss as _atss", "tes as _ates")
        .distinct()
        .selectExpr("*", near["tss"].replace("(tss ", "(_atss ") + " as _cx")
        .selectExpr("*", near["tes"].replace("(tes ", "(_ates ") + " as _cy")
    )
    placed = groups.selectExpr(
        "*", f"floor(tss_center / {width}) as _cx", f"floor(tes_center / {width}) as _cy"
    )
    g, a = placed.alias("g"), known.alias("a")
    same = [F.col(f"g.{k}") == F.col(f"a.{k}") for k in (*by, "chrom", "strand", "_cx", "_cy")]
    close = F.expr(f"abs(g.tss_center - a._atss) <= {tolerance} and abs(g.tes_center - a._ates) <= {tolerance}")
    condition = close
    for c in same:
        condition = condition & c
    return g.join(a, condition, how).drop("_cx", "_cy")


def novel_key(chrom: Column, strand: Column, tss: Column, tes: Column) -> Column:
    return F.concat_ws("|", chrom, strand, tss.cast("string"), tes.cast("string"))


def novel_ids(key: Column) -> tuple[Column, Column]:
    """Gene and transcript id of a novel key: the first 16 hex digits of its SHA-1."""
    digest = F.upper(F.substring(F.sha1(key), 1, 16))
    return F.concat(F.lit(NOVEL_GENE), digest), F.concat(F.lit(NOVEL_TX), digest)


def select_novel(
    groups: DataFrame,
    annotation: DataFrame,
    *,
    by: Sequence[str] = (),
    min_support: int = MIN_SUPPORT,
    tolerance: int = LABEL_TOLERANCE,
) -> DataFrame:
    """Consensus groups with ``reason`` NULL when kept, else why they were dropped."""
    if min_support < 2:
        raise ValueError("min_support must be at least 2")
    key = novel_key(F.col("chrom"), F.col("strand"), F.col("tss_center"), F.col("tes_center"))
    keyed = cut_lineage(groups.withColumn("canonical_key", key))
    annotated = annotation_match(keyed, annotation, by=by, tolerance=tolerance, how="left_semi").select(
        *by, "canonical_key", F.lit(True).alias("_ann")
    ).distinct()
    marked = keyed.join(annotated, [*by, "canonical_key"], "left")
    candidate = f"support_assemblers >= {min_support} and _ann is null"
    first = marked.where(candidate).groupBy(*by, "canonical_key").agg(F.min("created").alias("_first"))
    gene, tx = novel_ids(F.col("canonical_key"))
    reason = F.expr(
        f"""case when support_assemblers < {min_support} then 'support_below_min'
                 when _ann then 'annotation_match'
                 when created <> _first then 'duplicate_novel_key' end"""
    )
    return (
        marked.join(first, [*by, "canonical_key"], "left")
        .withColumns({"reason": reason, "_gene": gene, "_tx": tx})
        .selectExpr(
            *by, "reason", "if(reason is null, _gene, null) as new_gene_id",
            "if(reason is null, _tx, null) as new_transcript_id", "chrom", "strand", "tss_center", "tes_center",
            "support_assemblers", "assemblers", "rep.assembler_id as representative_assembler",
            "rep.transcript_id as representative_transcript_id", "canonical_key", "created",
        )
    )


def rename_lines(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """Lines of the chosen representatives with gene and transcript id replaced."""
    joined = lines.where(f"n_columns >= {COLUMNS}").join(chosen, ["assembler_id", "transcript_id"])
    attrs = set_attribute(
        set_attribute(F.col("attrs"), "gene_id", F.col("new_gene_id")), "transcript_id", F.col("new_transcript_id")
    )
    return joined.withColumn("value", _with_attributes(F.col("value"), attrs))


def union_annotation(annotation: DataFrame, added: DataFrame) -> DataFrame:
    """Reference lines followed by the added lines, as (part, line_no, value)."""
    return annotation.selectExpr("0 as part", "line_no", "value").unionByName(
        added.selectExpr("1 as part", "line_no", "value")
    )


def union_first(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of frames keeping, per key, the row of the earliest frame."""
    tagged = [p.withColumn("_src", F.lit(i)) for i, p in enumerate(parts)]
    stacked = tagged[0]
    for more in tagged[1:]:
        stacked = stacked.unionByName(more)
    rest = [c for c in parts[0].columns if c not in keys]
    picked = stacked.groupBy(*keys).agg(F.min(F.struct("_src", *rest)).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
