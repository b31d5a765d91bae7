"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

Documents are tokenized and cut into full sequences and a rest. Only the numbers of rests by length
decide the packing: lengths are placed longest first, always into the packs that are shortest so far,
and packs that look alike are one pattern with a count. The histogram has at most `room` rows, so
this is the driver's only work, whatever the size of the corpus. Pieces then find their places by
rank: the k-th piece of a length takes the k-th place that the patterns have for that length.

Ranks come from counts per length and hash bucket, so that a length that a third of all documents
share is no single group. Only documents longer than a sequence are cut.

Defined results: missing or empty text is the end id alone. A document is a row: rows with the same
doc_id are packed as documents of their own, and equal rows are interchangeable. No documents give no
rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areascope.session import materialise

ROOM = 4096
END = 2
CACHE_WORDS = 150_000
BUCKET_ROWS = 200_000

# A word of letters that lower-case one by one, in front of a character that surely ends it; or
# anything else up to white space.
_LETTERS = "a-zß-öø-ÿ"
_UNIT = re.compile(rf"[{_LETTERS}]+(?=[ \n.,;:!?%*$&#|]|$)|[^ \t\n\r\x0b\x0c]+")
_WORD = re.compile(rf"[{_LETTERS}]+")


class Encoder:
    """Ids of a text by a tokenizer of words, with a bounded memory of words seen before.

    The tokenizer drops white space and never joins letters with the punctuation listed in _UNIT, so
    a text's ids are those of its units in a row. Texts with characters whose lower case or normal
    form depends on their neighbours, or with a special token's mark, go to the tokenizer whole.

    The memory is two generations of CACHE_WORDS words: when the younger is full it becomes the older,
    and words still in use move up again, so frequent words outlast the many that come once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xDF, 0x100) if _WORD.fullmatch(chr(c))]
        self.spelled = str.maketrans({c: spell.pre_tokenize_str(c)[0][0] for c in letters})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, unit: str) -> bytes:
        if _WORD.fullmatch(unit):
            spelled = unit if unit.isascii() else unit.translate(self.spelled)
            ids = [t.id for t in self.model.tokenize(spelled)]
        else:
            ids = self.whole.encode(unit, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, unit: str) -> bytes:
        out = self.known.get(unit)  # a long text may still look up in a generation that has aged
        if out is None:
            out = self.older.get(unit) or self._ids(unit)
            if len(self.known) >= CACHE_WORDS:
                self.older, self.known = self.known, {}
            self.known[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        try:
            text.encode("latin-1")
            plain = "<|" not in text
        except UnicodeEncodeError:
            plain = False
        if not plain:
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        known, learn = self.known.get, self._learn
        return b"".join([known(u) or learn(u) for u in _UNIT.findall(text.lower())])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): documents cut into full pieces and a rest."""
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = (encode(text) if text else b"") + tail
                n = len(ids) // 4
                for start in range(0, n, room):
                    part = ids[4 * start : 4 * (start + room)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack_histogram(counts: dict[int, int], room: int = ROOM) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a pack, longest first) and how many packs look so.

    Longest lengths come first; each goes into the shortest packs it fits, as many packs at a time as
    there are alike, and opens packs of its own when it fits none.
    """
    by_fill: dict[int, dict[tuple[int, ...], int]] = {}
    fills = np.zeros(room + 1, dtype=bool)
    full: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = np.flatnonzero(fills[: room - length + 1])
            if len(fit):
                fill = int(fit[0])
                pattern, packs = by_fill[fill].popitem()
                used = min(packs, left)
                if packs > used:
                    by_fill[fill][pattern] = packs - used
                elif not by_fill[fill]:
                    fills[fill] = False
            else:
                fill, pattern = 0, ()
                used = max(1, left // (room // length))
            pattern, fill, left = (*pattern, length), fill + length, left - used
            if fill == room:
                full.append((pattern, used))
            else:
                kinds = by_fill.setdefault(fill, {})
                kinds[pattern] = kinds.get(pattern, 0) + used
                fills[fill] = True
    rest = [(p, n) for fill in sorted(by_fill, reverse=True) for p, n in by_fill[fill].items()]
    return full + rest


def padded(fill: int, room: int = ROOM) -> int:
    """Tokens a sequence takes: `room`, or its fill if that is a power of two."""
    return fill if fill & (fill - 1) == 0 else room


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, packs, first sequence, offset) for every place of a pattern.

    A pattern's n packs have consecutive sequence ids; its places for one length take n ranks each.
    """
    out, ranks, sequence = [], {}, 0
    for pattern, packs in patterns:
        offset = 0
        for length in pattern:
            first = ranks.get(length, 0)
            out.append((length, first, packs, sequence, offset))
            ranks[length] = first + packs
            offset += length
        sequence += packs
    return out


def ranked(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """The pieces with their rank among those of one length, and the number of pieces by length.

    Pieces of a length are ordered within hash buckets of bounded size, as counted.
    """
    sizes = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    total = max(sizes.values(), default=0)
    buckets = max(1, -(-total // bucket_rows) * 4)
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int").alias("bucket")
    marked = rows.select("*", bucket)
    counts = marked.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    offsets = counts.select("length", "bucket", before)
    nth = F.row_number().over(W.partitionBy("length", "bucket").orderBy(*order)) - 1
    out = marked.withColumn("nth", nth).join(offsets, ["length", "bucket"])
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("nth") + F.col("before")).alias("rank"),
    ), sizes


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, end: int = END) -> DataFrame:
    """Pieces with sequence_id and offset.

    The places of the patterns, a few for each length and pattern and so bounded by the histogram, go
    to every task; a piece finds its place by searching the first ranks of its length's places.
    """
    rows = materialise(pieces(docs, tokenizer, room, end))
    rows, sizes = ranked(rows)
    spots = pd.DataFrame(
        places(pack_histogram(sizes, room)),
        columns=["length", "first", "packs", "sequence", "offset"],
    )
    by_length = {
        length: part.sort_values("first")[["first", "sequence", "offset"]].to_numpy()
        for length, part in spots.groupby("length")
    }
    shared = docs.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence = np.zeros(len(batch), dtype=np.int64)
            offset = np.zeros(len(batch), dtype=np.int64)
            rank = batch["rank"].to_numpy()
            for length, at in batch.groupby("length").indices.items():
                spot = shared.value[length]
                k = np.searchsorted(spot[:, 0], rank[at], side="right") - 1
                sequence[at] = spot[k, 1] + rank[at] - spot[k, 0]
                offset[at] = spot[k, 2]
            out = batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)
            yield out.astype({"doc_id": "Int64"})

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return rows.mapInPandas(run, ", ".join(f"{n} long" for n in names))
