"""Clipped read ends summed per site and clip type, from running sums over blocks (see ``profile``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from endsight.operators.profile import BLOCK, Intervals, Linear, by_block

# The order of clip types; the type of a row that is a site.
TYPES = ("start", "end")
PLACE = -1


class EndBlock:
    """Counts, distances, bases and the greatest text of one clip type at every place of a block."""

    def __init__(self, counts_only: bool = False):
        self.counts_only = counts_only
        self.n, self.bases, self.distance = Intervals(), Intervals(), Linear()
        self.last = np.full(BLOCK, "", object)

    def add(self, low, high, at, n, lengths, texts: pa.Array) -> None:
        self.n.add(low, high, n)
        if self.counts_only:
            return
        self.bases.add(low, high, n * lengths)
        middle = np.clip(at, low, high)
        self.distance.add(low, middle, n * at, -n)
        self.distance.add(middle, high, -n * at, n)
        self._raise(texts, np.clip(low, 0, BLOCK), np.clip(high, 0, BLOCK))

    def _raise(self, texts: pa.Array, low: np.ndarray, high: np.ndarray) -> None:
        """Paint the texts of a batch in ascending order, then keep the greater text of every place."""
        coded = texts.dictionary_encode()
        known = np.array([*coded.dictionary.to_pylist(), ""], object)
        ascending = np.argsort(known[:-1])
        rank = np.empty(len(ascending), np.int64)
        rank[ascending] = np.arange(len(ascending))
        of_row = rank[coded.indices.to_numpy()]
        painted = np.full(BLOCK, len(ascending), np.int64)
        order = np.argsort(of_row, kind="stable")
        for r, frm, to in zip(of_row[order].tolist(), low[order].tolist(), high[order].tolist()):
            painted[frm:to] = r
        self.last = np.maximum(self.last, known[np.append(ascending, len(ascending))[painted]])


def end_sums(sites: DataFrame, ends: DataFrame, w: int, *, counts_only: bool = False) -> DataFrame:
    """Per distinct site and clip type with ends around it: ``n, distance, bases, last_sequence``.

    With ``counts_only`` just ``n``: ends of one read span are one row, and neither texts nor places travel.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin = key[1].as_py() * BLOCK
        blocks, places, strands = [EndBlock(counts_only), EndBlock(counts_only)], [], []
        for batch in batches:
            row = {c: batch.column(c).to_numpy() for c in ("type", "a", "b", "at", "n", "length")}
            of = row["type"] == PLACE
            if of.any():
                places.append(row["at"][of] - origin)
                strands += batch.column("text").filter(pa.array(of)).to_pylist()
            for i, block in enumerate(blocks):
                of = row["type"] == i
                if of.any():
                    block.add(
                        row["a"][of] - origin - w + 1, row["b"][of] - origin + w, row["at"][of] - origin,
                        row["n"][of], row["length"][of], batch.column("text").filter(pa.array(of)),
                    )
        if not places:
            return
        place, strand = np.concatenate(places), np.array(strands, object)
        for name, block in zip(TYPES, blocks):
            n = block.n.values()
            some = n[place] > 0
            p = place[some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0].as_py()] * len(p), pa.string()), pa.array(p + origin), pa.array(strand[some], pa.string()),
                    pa.array([name] * len(p), pa.string()), pa.array(n[p]), pa.array(block.distance.values()[p]),
                    pa.array(block.bases.values()[p]), pa.array(block.last[p], pa.string()),
                ],
                names=["chrom", "position", "strand", "clip_type", "n", "distance", "bases", "last_sequence"],
            )

    block_of = "bigint(floor(({}) / " + str(BLOCK) + "))"
    shaped = ends.where("chrom is not null and ref_start is not null").selectExpr(
        "chrom", "if((side = 'left') = (read_strand = '+'), 0, 1) as type", "ref_start as a", "ref_end as b",
        *(
            ("0L as at", "0L as length", "'' as text")
            if counts_only
            else ("read_position as at", "bigint(length(sequence)) as length", "sequence as text")
        ),
    )
    first, last = block_of.format(f"a - {w - 1}"), block_of.format(f"b + {w - 1}")
    counted = shaped.groupBy(*shaped.columns).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.where(f"a - {w - 1} <= b + {w - 1}").selectExpr("*", f"explode(sequence({first}, {last})) as block")
    places = sites.select("chrom", "position", "strand").distinct().where("chrom is not null and position is not null and strand is not null")
    rows = rows.unionByName(
        places.selectExpr(
            "chrom", f"{PLACE} as type", "0L as a", "0L as b", "bigint(position) as at", "0L as length",
            "strand as text", "0L as n", f"{block_of.format('position')} as block",
        )
    )
    schema = "chrom string, position long, strand string, clip_type string, n long, distance long, bases long, last_sequence string"
    sums = by_block(rows).groupBy("chrom", "block").applyInArrow(run, schema)
    return sums.select("chrom", "position", "strand", "clip_type", "n") if counts_only else sums
