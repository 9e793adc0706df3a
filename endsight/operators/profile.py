"""Sums and histograms of reads around sites, from running sums over blocks of a contig.

A read counts for a site while the site lies in an interval around the read, and each sum
over reads is a polynomial of the site's place on a few such intervals.  So a read adds to
two places per interval, running sums give the value at every place of a block, and sites
only look theirs up: the work grows with reads plus sites, never with their pairs.

Spark collapses equal reads, cuts contigs into blocks and deals the blocks out; a task
streams the rows of a block into arrays of a fixed length.  What is kept beside them are the
distinct read spans of a block.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Positions of a block, cells looked at together, distinct spans kept unmerged,
# kinds of rows.
BLOCK = 4_096
CELLS = 2_000_000
UNMERGED = 1_000_000
READ, BOUND, LONE_BOUND, PLACE = range(4)
STRANDS = {"+": 0, "-": 1, ".": 2}
PARTS = ("mapq", "flanks", "bias", "grid", "starts", "entropy", "clips", "medians", "splice")


class Intervals:
    """Weights on half-open intervals of the places of a block."""

    def __init__(self, low: int = 0, high: int = BLOCK):
        self.low, self.high = low, high
        self.steps = np.zeros(high - low + 1, np.int64)

    def add(self, low, high, weight) -> None:
        low = np.clip(low, self.low, self.high) - self.low
        high = np.clip(high, self.low, self.high) - self.low
        some = high > low
        weight = np.broadcast_to(weight, some.shape)[some]
        np.add.at(self.steps, low[some], weight)
        np.subtract.at(self.steps, high[some], weight)

    def values(self) -> np.ndarray:
        return np.cumsum(self.steps)[:-1]


class Linear:
    """Weights ``constant + slope * place`` on intervals."""

    def __init__(self):
        self.constant, self.slope = Intervals(), Intervals()

    def add(self, low, high, constant, slope) -> None:
        self.constant.add(low, high, constant)
        self.slope.add(low, high, slope)

    def values(self) -> np.ndarray:
        return self.constant.values() + self.slope.values() * np.arange(BLOCK)


class Counter:
    """Counts per pair of integers, merged whenever many are unmerged."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, first, second, count) -> None:
        self.parts.append((first.astype(np.int64), second.astype(np.int64), count.astype(np.int64)))
        self.size += len(first)
        if self.size > UNMERGED and len(self.parts) > 1:
            merged = self.merged()
            self.parts, self.size = [merged], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted by both numbers."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        first, second, count = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        order = np.lexsort((second, first))
        first, second, count = first[order], second[order], count[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(new)
        return first[at], second[at], np.add.reduceat(count, at) if len(at) else count


def _information(count: np.ndarray) -> np.ndarray:
    return count * np.log2(np.maximum(count, 1))


def _crossing(near: np.ndarray, far: np.ndarray, count: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Per place ``p``: sum of ``c log2 c`` and of ``c / (p - near)`` over the distinct ``near`` at or below
    ``p - edge``, ``c`` being the reads of one ``near`` whose ``far`` lies beyond ``p - edge``.

    Rows are sorted by ``near`` and ``far``.
    """
    information, inverse = np.zeros(BLOCK), np.zeros(BLOCK)
    # places at which the read crosses the edge of the window
    low, high = np.maximum(near + edge, 0), np.minimum(far + edge, BLOCK)
    some = high > low
    near, low, high, count = near[some], low[some], high[some], count[some]
    if not len(near):
        return information, inverse
    first = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
    last = np.append(first[1:], len(near)) - 1
    ends = np.cumsum(high[last] - low[first])
    begin = 0
    while begin < len(first):
        done = ends[begin - 1] if begin else 0
        stop = max(int(np.searchsorted(ends, done + CELLS, "right")), begin + 1)
        rows = slice(first[begin], last[stop - 1] + 1)
        cells = int(ends[stop - 1] - done)
        starts = np.append(done, ends[begin : stop - 1]) - done
        widths = (ends[begin:stop] - done) - starts
        which = np.repeat(np.arange(stop - begin), last[begin:stop] - first[begin:stop] + 1)
        marks = np.zeros(cells + 1, np.int64)
        np.add.at(marks, starts[which] + high[rows] - low[rows] - 1, count[rows])
        left = np.cumsum(marks[::-1])[::-1]
        left = left[:-1] - np.repeat(left[ends[begin:stop] - done], widths)
        place = np.arange(cells) - np.repeat(starts - low[first[begin:stop]], widths)
        gap = place - np.repeat(near[first[begin:stop]], widths)
        information += np.bincount(place, _information(left), BLOCK)
        inverse += np.bincount(place, left / np.maximum(gap, 1), BLOCK)
        begin = stop
    return information, inverse


def _both_edges(spans: tuple, start: bool, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Crossing reads whose counted end is their ``ref_start`` (left edge) or ``ref_end`` (right edge)."""
    a, b, n = spans
    if start:
        return _crossing(a, b, n, w)
    # the right edge is the left edge of the mirrored block; a read touches it from ref_end = p + w on
    near, far = BLOCK - 1 - b, BLOCK - 1 - a
    order = np.lexsort((far, near))
    information, inverse = _crossing(near[order], far[order], n[order], w)
    return information[::-1], inverse[::-1]


class Block:
    """The sums of one block; ``cfg`` is a :class:`~endsight.operators.features.FeatureConfig`."""

    def __init__(self, cfg, parts: Collection[str], grid: list[int], step: int, near: int, slope_reach: int):
        self.cfg, self.parts, self.grid, self.step = cfg, parts, grid, step
        self.near, self.slope_reach = near, slope_reach
        self.sums = {}
        self.margin = max([cfg.window_size, *(abs(o) + step for o in grid)])
        self.depth = Intervals(-self.margin, BLOCK + self.margin)
        self.by_start = [np.zeros(BLOCK + 2 * cfg.window_size, np.int64) for _ in range(2)]
        self.spans = [Counter(), Counter()]
        self.clip_steps = [Counter(), Counter()]
        cap = cfg.splice_site_window
        self.min_start = np.full(BLOCK + 2 * cap, np.iinfo(np.int64).max // 2)
        self.max_end = np.full(BLOCK + 2 * cap, np.iinfo(np.int64).min // 2)
        self.splice = np.full(BLOCK, cap, np.int64)
        self.cells = {o: Linear() for o in grid if not (-cfg.window_size <= o and o + step <= cfg.window_size)}
        self.flank = {"cov_left": Linear(), "cov_right": Linear()}

    def _sum(self, name) -> Intervals:
        return self.sums.setdefault(name, Intervals())

    def add_reads(self, row: dict[str, np.ndarray]) -> None:
        cfg, w = self.cfg, self.cfg.window_size
        a, b, n, strand = row["a"], row["b"], row["n"], row["st"]
        s, e = np.where(strand == 0, a, b), np.where(strand == 0, b, a)
        low, high = a - w + 1, b + w

        def inside(name, weight, frm=None, to=None):
            frm = low if frm is None else np.maximum(low, frm)
            self._sum(name).add(frm, high if to is None else np.minimum(high, to), weight)

        inside("reads", n)
        for code in range(3):
            of = strand == code
            inside(("same_strand", code), n * of)
        d, near = cfg.density_window, self.near
        inside("start_in_window", n, s - d, s + d + 1)
        inside("end_in_window", n, e - d, e + d + 1)
        if "mapq" in self.parts:
            inside("q1", row["q1"])
            inside("q2", row["q2"])
        if "bias" in self.parts:
            cigar, left, right = (row["flags"] & 1), (row["flags"] >> 1) & 1, (row["flags"] >> 2) & 1
            for code in range(3):
                of = n * (strand == code)
                inside(("bias_all", code), of * cigar)
                inside(("bias_clipped", code), of * left, a - near, a + near + 1)
                inside(("bias_clipped", code), of * right, b - near, b + near + 1)
                both_low, both_high = np.maximum(a, b) - near, np.minimum(a, b) + near + 1
                inside(("bias_clipped", code), -of * left * right, both_low, both_high)
        if "starts" in self.parts:
            inside("start_near", n, s - near, s + near + 1)
            inside("upstream", n, s + 1)
            inside("downstream", n, None, s)
            inside("s1", n * s)
            inside("s2", n * s * s)
            r, step = self.slope_reach, self.step
            inside("slope_c", n, s - r - step + 1, s + r + 1)
            for j in range(1, (2 * r + step) // step):
                inside("slope_ic", n * j, s + r + 1 - step * (j + 1), s + r + 1 - step * j)
        if {"starts", "entropy"} & set(self.parts):
            for i, place in enumerate((s, e)):
                at = place + w
                known = (at >= 0) & (at < len(self.by_start[i])) & (b >= a)
                np.add.at(self.by_start[i], at[known], n[known])
            for i in range(2):
                of = ((strand == 0) == (i == 0)) & (b >= a)
                self.spans[i].add(a[of], b[of], n[of])
        covers = b > a
        if "grid" in self.parts:
            self.depth.add(a[covers], b[covers], n[covers])
            for o, cell in self.cells.items():
                g = self.step
                x, y, m, lo, hi = a[covers], b[covers], n[covers], low[covers] + o, high[covers] + o
                m1, m2 = np.minimum(x, y - g), np.maximum(x, y - g)

                def piece(frm, to, constant, slope):
                    frm, to = np.maximum(frm, lo), np.minimum(to, hi)
                    cell.add(frm - o, to - o, constant + slope * o, slope)

                piece(x - g + 1, m1 + 1, m * (g - x), m)
                piece(m1 + 1, m2 + 1, m * np.minimum(g, y - x), 0 * m)
                piece(m2 + 1, y, m * y, -m)
        if "flanks" in self.parts:
            cw, reach = cfg.coverage_window, cfg.reach
            x, y, m = a[covers], b[covers], n[covers]
            lo, hi = x - reach + 1, y + reach

            def flank(name, frm, to, constant, slope):
                self.flank[name].add(np.maximum(frm, lo), np.minimum(to, hi), constant, slope)

            flank("cov_left", x + 1, np.minimum(x + cw, y) + 1, -m * x, m)
            flank("cov_left", y + 1, x + cw + 1, m * (y - x), 0 * m)
            flank("cov_left", np.maximum(y, x + cw + 1), y + cw, m * (y + cw), -m)
            flank("cov_right", np.maximum(x, y - cw), y, m * y, -m)
            flank("cov_right", y - cw, x, m * (y - x), 0 * m)
            flank("cov_right", x - cw + 1, np.minimum(x + 1, y - cw), m * (cw - x), m)
        if "clips" in self.parts:
            cs, ce = row["cs"], row["ce"]
            inside("cs1", n * cs)
            inside("ce1", n * ce)
            inside("clip2", n * (cs**2 + ce**2))
            inside("clip3", n * (cs**3 + ce**3))
            inside("long_clips", n * ((cs > 20).astype(np.int64) + (ce > 20)))
            inside("short_clips", n * ((cs <= 10).astype(np.int64) + (ce <= 10)))
            frm, to = np.clip(low, 0, BLOCK), np.clip(high, 0, BLOCK)
            some = to > frm
            for counter, value in zip(self.clip_steps, (cs, ce)):
                counter.add(value[some], frm[some], n[some])
                counter.add(value[some], to[some], -n[some])

    def add_bounds(self, bound, a, b) -> None:
        cap = self.cfg.splice_site_window
        known = (bound > -cap) & (bound < BLOCK + cap)
        np.minimum.at(self.min_start, bound[known] + cap, a[known])
        np.maximum.at(self.max_end, bound[known] + cap, b[known])

    def add_lone_bounds(self, bound, a, b) -> None:
        """Boundaries outside the window of their own read."""
        cap, w = self.cfg.splice_site_window, self.cfg.window_size
        for x, low, high in zip(bound.tolist(), (a - w + 1).tolist(), (b + w).tolist()):
            low, high = max(low, x - cap + 1, 0), min(high, x + cap, BLOCK)
            if high > low:
                np.minimum(self.splice[low:high], np.abs(np.arange(low, high) - x), out=self.splice[low:high])

    def _splice(self) -> np.ndarray:
        cap, w = self.cfg.splice_site_window, self.cfg.window_size
        place, found = np.arange(BLOCK), self.splice
        for gap in range(cap):
            left, right = place - gap + cap, place + gap + cap
            valid = (place < self.max_end[left] + w) & (place > self.min_start[left] - w)
            valid |= (place < self.max_end[right] + w) & (place > self.min_start[right] - w)
            np.copyto(found, np.minimum(found, gap), where=valid)
        return found

    def _clips(self, reads: np.ndarray) -> dict[str, np.ndarray]:
        out, lowest, highest = {}, np.full(BLOCK, np.iinfo(np.int64).max), np.full(BLOCK, -1, np.int64)
        for kind, counter in zip(("start", "end"), self.clip_steps):
            value, at, count = counter.merged()
            below = np.zeros(BLOCK, np.int64)
            medians = [np.full(BLOCK, -1, np.int64) for _ in range(2)]
            largest = np.full(BLOCK, -1, np.int64)
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else []
            for begin, end in zip(first, [*first[1:], len(value)]):
                v = value[begin]
                steps = np.zeros(BLOCK + 1, np.int64)
                steps[at[begin:end]] = count[begin:end]
                here = np.cumsum(steps)[:-1]
                below += here
                for median, rank in zip(medians, ((reads - 1) // 2, reads // 2)):
                    median[(median < 0) & (below > rank)] = v
                largest[here > 0] = v
                lowest[here > 0] = np.minimum(lowest[here > 0], v)
            highest = np.maximum(highest, largest)
            out[f"{kind}_soft_clip_median"] = np.where(reads > 0, (medians[0] + medians[1]) / 2.0, 0.0)
            out[f"c{kind[0]}_max"] = np.maximum(largest, 0)
        out["clip_min"], out["clip_max"] = np.where(highest < 0, 0, lowest), np.maximum(highest, 0)
        return out

    def table(self, place: np.ndarray, strand: np.ndarray) -> dict[str, np.ndarray]:
        """All columns at the given places of the block; ``strand`` holds codes."""
        cfg, w, at = self.cfg, self.cfg.window_size, np.arange(BLOCK)
        full = {name: sums.values() for name, sums in self.sums.items()}
        zeros = np.zeros(BLOCK, np.int64)
        reads = full.get("reads", zeros)
        out = {c: full.get(c, zeros) for c in ("reads", "start_in_window", "end_in_window")}

        def of_strand(name):
            stacked = np.stack([full.get((name, code), zeros) for code in range(3)] + [zeros])
            return stacked[strand, place]

        picked = {"same_strand": of_strand("same_strand")}
        if "mapq" in self.parts:
            out |= {"q1": full.get("q1", zeros), "q2": full.get("q2", zeros).astype(float)}
        if "bias" in self.parts:
            picked |= {c: of_strand(c) for c in ("bias_all", "bias_clipped")}
        edges = {}
        if {"starts", "entropy"} & set(self.parts):
            merged = [c.merged() for c in self.spans]
            for i in range(2):  # a histogram of read starts, one of read ends
                left, right = _both_edges(merged[i], True, w), _both_edges(merged[1 - i], False, w)
                edges[i] = (left[0] + right[0], left[1] + right[1])
        if "starts" in self.parts:
            out |= {c: full.get(c, zeros) for c in ("start_near", "upstream", "downstream", "slope_c", "slope_ic")}
            s1, s2 = full.get("s1", zeros), full.get("s2", zeros)
            out["ds1"] = s1 - at * reads
            out["ds2"] = (s2 - 2 * at * s1 + at * at * reads).astype(float)
            weights = 1.0 / np.maximum(np.abs(np.arange(-w + 1, w)), 1)
            out["inverse_distance"] = np.convolve(self.by_start[0][1:-1], weights, "valid")[:BLOCK] + edges[0][1]
        if "entropy" in self.parts:
            for i, name in enumerate(("start_entropy", "end_entropy")):
                middle = np.convolve(_information(self.by_start[i][1:-1]), np.ones(2 * w - 1), "valid")[:BLOCK]
                total = np.maximum(reads, 1)
                out[name] = np.where(reads > 0, np.log2(total) - (middle + edges[i][0]) / total, 0.0)
        if "grid" in self.parts:
            below = np.append(0, np.cumsum(self.depth.values()))
            for i, o in enumerate(self.grid):
                if o in self.cells:
                    out[f"grid_{i}"] = self.cells[o].values()
                else:
                    begin = at + o + self.margin
                    out[f"grid_{i}"] = below[begin + self.step] - below[begin]
        if "flanks" in self.parts:
            out |= {name: sums.values() for name, sums in self.flank.items()}
        if "clips" in self.parts:
            out |= {c: full.get(c, zeros) for c in ("cs1", "ce1", "long_clips", "short_clips")}
            out |= {c: full.get(c, zeros).astype(float) for c in ("clip2", "clip3")}
            out |= self._clips(reads)
        if "splice" in self.parts:
            out["nearest_splice_dist"] = self._splice()
        return {c: v[place] for c, v in out.items()} | picked


def columns_of(parts: Collection[str], grid: list[int]) -> dict[str, str]:
    """Columns that the parts give, with their types."""
    long, double = "long", "double"
    columns = dict.fromkeys(("reads", "start_in_window", "end_in_window", "same_strand"), long)
    given = {
        "mapq": {"q1": long, "q2": double},
        "flanks": {"cov_left": long, "cov_right": long},
        "bias": {"bias_all": long, "bias_clipped": long},
        "grid": {f"grid_{i}": long for i in range(len(grid))},
        "starts": dict.fromkeys(("start_near", "upstream", "downstream", "slope_c", "slope_ic", "ds1"), long)
        | {"ds2": double, "inverse_distance": double},
        "entropy": {"start_entropy": double, "end_entropy": double},
        "clips": dict.fromkeys(
            ("cs1", "ce1", "long_clips", "short_clips", "cs_max", "ce_max", "clip_min", "clip_max"), long
        )
        | dict.fromkeys(("clip2", "clip3", "start_soft_clip_median", "end_soft_clip_median"), double),
        "splice": {"nearest_splice_dist": long},
    }
    for part in PARTS:
        if part in parts:
            columns |= given.get(part, {})
    return columns


def _dealt(rows: DataFrame, low: str, high: str) -> DataFrame:
    """Rows repeated for every block that has a place between ``low`` and ``high``."""
    return rows.where(f"{low} <= {high}").selectExpr(
        "*", f"explode(sequence(bigint(floor(({low}) / {BLOCK})), bigint(floor(({high}) / {BLOCK})))) as block"
    )


def by_block(rows: DataFrame) -> DataFrame:
    """Rows dealt to tasks by block: a fixed number of tasks, as the work of a block is not in its bytes."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "chrom", "block")


def block_rows(sites: DataFrame, parsed: DataFrame, cfg, parts: Collection[str]) -> DataFrame:
    """Distinct read shapes, intron boundaries and sites by block of their contig.

    Only the columns that ``parts`` need are there: rows are shuffled, sorted and handed to Python.
    """
    w, reach, cap = cfg.window_size, cfg.reach, cfg.splice_site_window
    reads = parsed.where("ref_end > 0 and ref_start is not null and chrom is not null")
    oriented = "length(if(read_strand = '+', {0}_seq, {1}_seq))"
    keys = {
        "chrom": "chrom",
        "a": "ref_start",
        "b": "ref_end",
        "st": "case read_strand when '+' then 0L when '-' then 1L else 2L end",
    }
    sums = {"n": "count(1)"}
    if "clips" in parts:
        keys |= {
            "cs": f"bigint({oriented.format('left', 'right')})",
            "ce": f"bigint({oriented.format('right', 'left')})",
        }
    if "bias" in parts:
        keys["flags"] = "bigint(has_cigar) + 2 * bigint(left_op > 0) + 4 * bigint(right_op > 0)"
    if "mapq" in parts:
        sums |= {"q1": "sum(mapq)", "q2": "sum(mapq * mapq)"}
    shaped = reads.selectExpr(*[f"{e} as {c}" for c, e in keys.items()], *(["mapq"] if "mapq" in parts else []))
    shapes = shaped.groupBy(*keys).agg(*[F.expr(f"{e} as {c}") for c, e in sums.items()])
    numbers = [c for c in (*keys, *sums) if c not in ("chrom", "a", "b")] + (["x"] if "splice" in parts else [])
    names = ("chrom", "block", "kind", "a", "b", *numbers, "strand")

    def as_rows(df: DataFrame, kind: int, strand: str = "string(null)") -> DataFrame:
        filled = df.selectExpr("*", f"{kind} as kind", *[f"0L as {c}" for c in numbers if c not in df.columns])
        return (filled if "strand" in df.columns else filled.selectExpr("*", f"{strand} as strand")).select(*names)

    rows = as_rows(_dealt(shapes, f"a - {reach - 1}", f"b + {reach - 1}"), READ).unionByName(
        as_rows(
            sites.where("chrom is not null and position is not null and strand is not null").selectExpr(
                "chrom", "bigint(position) as a", "bigint(position) as b", "strand",
                f"bigint(floor(position / {BLOCK})) as block",
            ),
            PLACE,
        )
    )
    if "splice" in parts:
        bounds = (
            reads.where("size(introns) > 0")
            .selectExpr("chrom", "ref_start as a", "ref_end as b", "explode(introns) as x")
            .selectExpr("*", f"a - {w} < x and x < b + {w} as own")
        )
        # the windows of reads that hold the boundary overlap, so their extremes say all
        common = bounds.where("own").groupBy("chrom", "x").agg(F.min("a").alias("a"), F.max("b").alias("b"))
        lone = bounds.where("not own").select("chrom", "a", "b", "x").distinct()
        for found, kind in ((common, BOUND), (lone, LONE_BOUND)):
            rows = rows.unionByName(as_rows(_dealt(found, f"x - {cap - 1}", f"x + {cap - 1}"), kind))
    return rows


def site_profile(
    sites: DataFrame, parsed: DataFrame, cfg, parts: Collection[str], *, grid: list[int], step: int, near: int, slope_reach: int
) -> DataFrame:
    """One row per distinct site with the sums named by ``parts``; ``parsed`` is ``usable_reads``."""
    columns = columns_of(parts, grid)
    parts = frozenset(parts)
    rows = block_rows(sites, parsed, cfg, parts)
    numbers = [c for c in rows.columns if c not in ("chrom", "block", "strand")]

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin = key[1].as_py() * BLOCK
        block = Block(cfg, parts, grid, step, near, slope_reach)
        places, strands = [], []
        for batch in batches:
            row = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in numbers}
            for c in {"a", "b", "x"}.intersection(numbers):
                row[c] = row[c] - origin
            kind = row["kind"]
            of = kind == READ
            if of.any():
                block.add_reads({c: v[of] for c, v in row.items()})
            of = kind == PLACE
            if of.any():
                places.append(row["a"][of])
                strands += batch.column("strand").filter(pa.array(of)).to_pylist()
            for which, add in ((BOUND, block.add_bounds), (LONE_BOUND, block.add_lone_bounds)):
                of = kind == which
                if of.any():
                    add(row["x"][of], row["a"][of], row["b"][of])
        if not places:
            return
        place = np.concatenate(places)
        values = block.table(place, np.array([STRANDS.get(s, 3) for s in strands]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()] * len(place), pa.string()), pa.array(place + origin), pa.array(strands, pa.string())]
            + [pa.array(values[c], pa.int64() if t == "long" else pa.float64()) for c, t in columns.items()],
            names=["chrom", "position", "strand", *columns],
        )

    schema = "chrom string, position long, strand string, " + ", ".join(f"{c} {t}" for c, t in columns.items())
    return by_block(rows).groupBy("chrom", "block").applyInArrow(run, schema)
