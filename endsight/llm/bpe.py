"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last token of its encoding.  A
candidate must end there (an automaton with suffix links over all vocabulary strings reports these
in one pass) and must be compatible with the last token of the prefix before it:
encoding the two tokens' joined text must give back those two.  The pair test undoes the
two tokens' merges along their common border, latest merge first, and looks for a merge across the
border that would have come earlier.  Following the back-pointers from the end gives the ids.

Text is prepared as the vocabulary file says: special strings are cut out of the raw
text first, then canonical composition, white space, lower case and the word pattern.
Words are remembered per Python worker, up to a bound; texts are read in pieces cut at
white space, so a long text needs memory for its own ids only.

Defined cases: a null or blank text has no tokens and decodes to the empty string; repeated
rows and null identifiers are encoded like any other; other columns are ignored.  An
empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from endsight.llm.common import keyed

#: Words a worker remembers before it starts afresh, and the longest word it remembers.
WORDS_KEPT, WORD_LENGTH = 300_000, 48
#: Compatibility results a worker remembers.
PAIRS_KEPT = 2_000_000
#: Characters read at once; a cut is made at white space only.
CHUNK = 1 << 18
#: Bytes that the byte-level alphabet shows as themselves.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Fixed value: the word pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ranges of code points that the installed pattern library counts as letters
#: or digits and the vocabulary's library does not (its character tables are older).
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
#: Lower case of newer capital letters that Python's tables lack.
NEWER_LOWER = str.maketrans(
    {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}
    | {0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
)

_DDL = "_id bigint, _ids array<int>, _decoded string"


@lru_cache(maxsize=1)
def _strict_patterns() -> tuple[regex.Pattern, regex.Pattern]:
    """A search for the characters of ``NEWER`` and the word pattern that takes them for symbols."""
    rare = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]"
    strict = rf"'s|'t|'re|'ve|'m|'ll|'d|(?:(?!{rare})\p{{L}})+|(?!{rare})\p{{N}}|(?:{rare}|[^\s\p{{L}}\p{{N}}])+"
    return regex.compile(rare), regex.compile(strict)


def _shown() -> list[str]:
    hidden = [b for b in range(256) if b not in set(SHOWN)]
    return [chr(b) if b in set(SHOWN) else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """Encoder for one vocabulary file, given as its JSON text.

    A symbol is a byte; the last byte of a word is a symbol of its own (byte + 256).
    """

    def __init__(self, source: str) -> None:
        import ahocorasick

        data = json.loads(source)
        vocab, merges, end = data["model"]["vocab"], data["model"]["merges"], data["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in (vocab | self.special).items()}
        symbols: dict[str, str] = {}
        for byte, char in enumerate(_shown()):
            symbols[char], symbols[char + end] = chr(byte), chr(256 + byte)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self.rank = {vocab[t]: -1 for t in symbols}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            symbols[a + b] = symbols[a] + symbols[b]
            made = vocab[a + b]
            self.parts[made] = vocab[a], vocab[b]
            self.merge[vocab[a], vocab[b]] = made
            self.rank[made] = rank
        self.matches = ahocorasick.Automaton()
        for name, text in symbols.items():
            self.matches.add_word(text, (len(text), vocab[name]))
        self.matches.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.word_pattern = regex.compile(PATTERN)
        self.unassigned, self.strict_pattern = _strict_patterns()
        self.capitals = regex.compile("[" + "".join(map(chr, NEWER_LOWER)) + "]")
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def compatible(self, left: int, right: int) -> bool:
        key = left << 17 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        """False if some merge across the border comes before the merges that it would undo.

        Walks back in time: whichever of the border tokens was made last is replaced by
        its part at the border.  A merge across is fatal if it precedes the making of
        the tokens undone so far; of equal ranks the one further left goes first.
        """
        merge, rank, parts = self.merge, self.rank, self.parts
        undone = (len(rank), 0)
        while True:
            across = merge.get((left, right))
            # place 1 lies at the border: after an equal merge within the left token
            if across is not None and (rank[across], 1) < undone:
                return False
            newest, side = max((rank[left], 0), (rank[right], 2))
            if newest < 0:
                return True
            undone = (newest, side)
            if side == 0:
                left = parts[left][1]
            else:
                right = parts[right][0]

    def word(self, piece: str) -> bytes:
        """Ids of one word as little-endian 32-bit integers."""
        raw = piece.encode().decode("latin-1")
        text = raw[:-1] + chr(256 + ord(raw[-1]))
        size = len(text)
        last, compatible = [-1] * (size + 1), self.compatible
        lengths = [0] * (size + 1)
        for at, (length, token) in self.matches.iter(text):
            end = at + 1
            if lengths[end]:
                continue
            start = end - length
            if start == 0 or (lengths[start] and compatible(last[start], token)):
                last[end], lengths[end] = token, length
        out, end = [], size
        while end:
            out.append(last[end])
            end -= lengths[end]
        return np.array(out[::-1], dtype="<i4").tobytes()

    def _cached(self, piece: str) -> bytes:
        ids = self.word(piece)
        if len(piece) <= WORD_LENGTH:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            self.words[piece] = ids
        return ids

    def _plain(self, text: str) -> Iterator[bytes]:
        words = self.words
        start, size = 0, len(text)
        while start < size:
            stop = start + CHUNK
            while stop < size and text[stop] not in " \n\t":
                stop += 1
            part = text[start:stop]
            start = stop
            pattern = self.word_pattern
            if not part.isascii():
                if self.unassigned.search(part):
                    pattern = self.strict_pattern
                # every character is lowered by itself, so a final sigma is a sigma
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                if self.capitals.search(part):
                    part = part.translate(NEWER_LOWER)
            pieces = pattern.findall(part.lower())
            yield b"".join([words.get(p) or self._cached(p) for p in pieces])

    def encode(self, text: str) -> np.ndarray:
        parts: list[bytes] = []
        for run in self.special_pattern.split(text):
            if run in self.special:
                parts.append(np.array([self.special[run]], dtype="<i4").tobytes())
            else:
                parts.extend(self._plain(run))
        return np.frombuffer(b"".join(parts), dtype="<i4")

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary file names no decoder: tokens are joined by single spaces."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(source: str) -> WordBpe:
    return WordBpe(source)


def _run(broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(broadcast.value)
        for batch in batches:
            held, texts, docs, weight = [], [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "")
                docs.append(doc.as_py())
                held.append(ids)
                texts.append(encoder.decode(ids.tolist()))
                weight += ids.nbytes + len(texts[-1])
                if weight > 8 << 20:
                    yield _batch(docs, held, texts)
                    held, texts, docs, weight = [], [], [], 0
            if docs:
                yield _batch(docs, held, texts)

    return run


def _batch(docs: list, held: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held), pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), ids, pa.array(texts, pa.string())], names=["_id", "_ids", "_decoded"]
    )


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id, _ids, _decoded`` of every row; ``vocabulary`` is the path of the file.

    The driver reads the file once and broadcasts its text, whose size does not depend on the data.
    """
    with open(vocabulary, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    return keyed(docs, doc_id, text).mapInArrow(_run(source), _DDL)


def digest_columns() -> list[Column]:
    """Number of tokens and checksums, as columns over ``encode``'s result."""
    return [
        F.expr("bigint(size(_ids))").alias("n_tokens"),
        F.expr("sha2(array_join(cast(_ids as array<string>), ' '), 256)").alias("ids_sha256"),
        F.expr("sha2(_decoded, 256)").alias("decoded_sha256"),
    ]
