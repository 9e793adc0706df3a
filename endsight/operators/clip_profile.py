"""Composition and k-mers of the clips near sites, from running sums over blocks (see ``profile``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from endsight.functions.sequences import BASES, TRACKED_3MERS
from endsight.operators.profile import BLOCK, Counter, Intervals, by_block

# Kinds of rows, summed and largest columns.
CLIP, PLACE = range(2)
SUMS = ("clips", "bases", "gc", "ag", "at")
LARGEST = ("longest", *(f"run_{b}" for b in BASES))


class _Letters:
    """Codes of the letters of several texts one after another: places in ``BASES``, 4 for others."""

    def __init__(self, texts: list[str]):
        table = np.full(256, 4, np.uint8)
        for i, base in enumerate(BASES):
            table[ord(base)] = i
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.codes = table[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)].astype(np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.lengths)

    def count(self, which: str) -> np.ndarray:
        some = np.isin(self.codes, [BASES.index(b) for b in which])
        return np.bincount(self.text[some], minlength=len(self.lengths))

    def longest_runs(self) -> np.ndarray:
        """One row per base, one column per text."""
        out = np.zeros((5, len(self.lengths)), np.int64)
        new = np.ones(len(self.codes), bool)
        new[1:] = (self.codes[1:] != self.codes[:-1]) | (self.text[1:] != self.text[:-1])
        at = np.flatnonzero(new)
        np.maximum.at(out, (self.codes[at], self.text[at]), np.diff(np.append(at, len(new))))
        return out[:4]

    def kmers(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, code to base 4) of every k-mer of A, C, G and T."""
        size = len(self.codes) - k + 1
        if size <= 0:
            return (np.zeros(0, np.int64),) * 2
        code, valid = np.zeros(size, np.int64), self.text[:size] == self.text[k - 1 :]
        for i in range(k):
            letter = self.codes[i : i + size]
            code, valid = code * 4 + letter, valid & (letter < 4)
        return self.text[:size][valid], code[valid]


class ClipBlock:
    """The clip columns of one block; ``kmers`` says whether k-mers are counted."""

    def __init__(self, cfg, kmers: bool):
        self.cfg, self.w = cfg, cfg.soft_clip_window
        self.sums = {c: Intervals() for c in SUMS}
        self.largest = {c: np.zeros(BLOCK + 2 * self.w, np.int64) for c in LARGEST}
        self.words = {k: Counter() for k in cfg.k_values} if kmers else {}

    def add(self, at: np.ndarray, texts: pa.Array, n: np.ndarray) -> None:
        coded = texts.dictionary_encode()
        letters = _Letters(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy().astype(np.int64)
        w, low, high = self.w, at - self.w, at + self.w + 1
        each = {"clips": 1, "bases": letters.lengths[which]}
        each |= {c: letters.count(c.upper())[which] for c in ("gc", "ag", "at")}
        for name, value in each.items():
            self.sums[name].add(low, high, n * value)
        runs = letters.longest_runs()
        for name, value in zip(LARGEST, (letters.lengths, *runs)):
            np.maximum.at(self.largest[name], at + w, value[which])
        low, high = np.clip(low, 0, BLOCK), np.clip(high, 0, BLOCK)
        for k, counter in self.words.items():
            text, code = letters.kmers(k)
            first = np.searchsorted(text, np.arange(len(letters.lengths) + 1))
            amount = np.diff(first)[which]
            row = np.repeat(np.arange(len(which)), amount)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(amount) - amount, amount)
            word = code[first[which][row] + inner]
            counter.add(word, low[row], n[row])
            counter.add(word, high[row], -n[row])

    def _composition(self) -> dict[str, np.ndarray]:
        sums = {c: s.values() for c, s in self.sums.items()}
        spans = {
            c: np.max(np.lib.stride_tricks.sliding_window_view(v, 2 * self.w + 1), axis=1)[:BLOCK]
            for c, v in self.largest.items()
        }
        clips, bases = np.maximum(sums["clips"], 1), np.maximum(sums["bases"], 1)
        out = {
            "avg_clip_length": sums["bases"] / clips,
            "max_clip_length": spans["longest"],
            "num_clips": sums["clips"],
            "gc_content": sums["gc"] / bases,
            "purine_ratio": sums["ag"] / bases,
            **{f"max_poly{b}": spans[f"run_{b}"] for b in BASES},
        }
        if self.cfg.legacy_columns:
            out["total_clip_length"] = sums["bases"]
            out["gc_content_basic"] = sums["gc"] / bases
            out["at_content_basic"] = sums["at"] / bases
        return out

    def _words(self, k: int) -> dict[str, np.ndarray]:
        word, at, count = self.words[k].merged()
        names = ("total", "unique", "gc_half", "at_rich", "gc_rich", "purine", "repeat", "balanced", "largest")
        sums = {c: np.zeros(BLOCK, np.int64) for c in names}
        information = np.zeros(BLOCK)
        tracked = {m: np.zeros(BLOCK, np.int64) for m in TRACKED_3MERS} if k == 3 else {}
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else []
        for begin, end in zip(first, [*first[1:], len(word)]):
            steps = np.zeros(BLOCK + 1, np.int64)
            steps[at[begin:end]] = count[begin:end]
            c = np.cumsum(steps)[:-1]
            text = "".join(BASES[(int(word[begin]) >> (2 * i)) & 3] for i in reversed(range(k)))
            gc, purine = sum(x in "GC" for x in text) / k, sum(x in "AG" for x in text) / k
            repeat = text == text[0] * k
            sums["total"] += c
            sums["unique"] += c > 0
            np.maximum(sums["largest"], c, out=sums["largest"])
            information += c * np.log2(np.maximum(c, 1))
            for name, when in (
                ("gc_half", gc >= 0.5), ("at_rich", not repeat and gc < 0.4), ("gc_rich", not repeat and gc > 0.6),
                ("purine", purine > 0.6), ("repeat", repeat), ("balanced", not repeat and 0.4 <= gc <= 0.6),
            ):
                if when:
                    sums[name] += c
            if text in tracked:
                tracked[text] += c
        total = np.maximum(sums["total"], 1)
        some = sums["total"] > 0
        out = {
            f"k{k}_gc_kmers_ratio": sums["gc_half"] / total,
            f"k{k}_kmer_diversity": sums["unique"] / total,
            f"k{k}_kmer_entropy": np.where(some, np.log2(total) - information / total, 0.0),
            f"k{k}_most_frequent_kmer_ratio": sums["largest"] / total,
            f"k{k}_unique_kmers": sums["unique"],
            f"k{k}_at_rich_kmers": sums["at_rich"],
            f"k{k}_gc_rich_kmers": sums["gc_rich"],
            f"k{k}_purine_rich_kmers": sums["purine"],
            f"k{k}_repeat_kmers": sums["repeat"],
        }
        if self.cfg.legacy_columns:
            out[f"k{k}_balanced_kmers"] = sums["balanced"]
        return out | {f"kmer_{m}": c for m, c in tracked.items()}

    def table(self) -> dict[str, np.ndarray]:
        out = self._composition()
        for k in self.words:
            out |= self._words(k)
        return {c: v.astype(float) for c, v in out.items()}


def clip_profile(sites: DataFrame, clips: DataFrame, cfg, *, kmers: bool = True) -> DataFrame:
    """Clip columns per distinct (chrom, position) with clips near; ``clips`` has ``chrom, clip_pos, seq, n``.

    A clip adds to the places of its window once, whatever the number of sites there.
    """
    w = cfg.soft_clip_window
    names = list(ClipBlock(cfg, kmers).table())

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin = key[1].as_py() * BLOCK
        block, places = ClipBlock(cfg, kmers), []
        for batch in batches:
            at = batch.column("at").to_numpy() - origin
            clip = batch.column("kind").to_numpy() == CLIP
            if clip.any():
                n = batch.column("n").to_numpy()
                block.add(at[clip], batch.column("seq").filter(pa.array(clip)), n[clip])
            places.append(at[~clip])
        place = np.concatenate(places)
        if not len(place):
            return
        values = block.table()
        place = place[values["num_clips"][place] > 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()] * len(place), pa.string()), pa.array(place + origin)]
            + [pa.array(values[c][place]) for c in names],
            names=["chrom", "position", *names],
        )

    block_of = "bigint(floor(({}) / " + str(BLOCK) + "))"
    rows = (
        clips.where("chrom is not null and clip_pos is not null")
        .selectExpr(
            "chrom", f"{CLIP} as kind", "bigint(clip_pos) as at", "seq", "bigint(n) as n",
            f"explode(sequence({block_of.format(f'clip_pos - {w}')}, {block_of.format(f'clip_pos + {w}')})) as block",
        )
        .unionByName(
            sites.where("chrom is not null and position is not null").select("chrom", "position").distinct().selectExpr(
                "chrom", f"{PLACE} as kind", "bigint(position) as at", "string(null) as seq", "0L as n",
                f"{block_of.format('position')} as block",
            )
        )
    )
    schema = "chrom string, position long, " + ", ".join(f"{c} double" for c in names)
    return by_block(rows).groupBy("chrom", "block").applyInArrow(run, schema)
