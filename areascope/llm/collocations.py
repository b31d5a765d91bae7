"""Phrases whose words belong together, counted by broadcast double-array tries.

Candidates are found level by level, as in Apriori: a phrase of k words can only be frequent where both
phrases of k - 1 words in it are. A pass over the texts counts the phrases of k words by a 64-bit hash,
where the hashes of both parts pass a Bloom filter of the frequent ones before (at most 8 MB however
many there are; a full filter only lets more through). Equal hashes only add up, so no frequent phrase is
lost, and no pair is made that no text holds. One more pass lists the texts of what stays. Texts are dealt
into slots by their CRC-32, and a phrase is listed from the least slot that has it, so few tasks list it.

Then the tries count. Phrases are dealt over shards of at most `SHARD_BYTES` bytes of phrases, so a trie
has at most that many nodes. Tasks lower the texts of a chunk, and the trie moves the states of all
text positions where a word begins at once, byte by byte: base[state] + byte is the next state if
check agrees. A state behind a whole word may accept a phrase; accepted states are counted by
bincount, and the counts of all tasks and shards are added up. Each shard reads the texts once.

The rest is Spark SQL: every cut of a phrase by joins of the counts with themselves, in exact decimals,
and a limited window per language.

Defined results: a missing text is empty, a missing lang is `und`, together with the lang of that
name; repeated rows count each. Texts of any length are read whole: longer than a chunk, they are cut
where pieces end. Other columns are ignored, whatever their names. An empty table gives an empty
result. Ties in the ranking are broken by count, then by the bytes of the phrase. Only where candidates are
listed does a hash stand for its text, inside one chunk; the counts are of texts.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areascope.llm.sketch import mix
from areascope.llm.text import partitions
from areascope.session import materialise

LONGEST = 4
CHUNK_BYTES = 1 << 20
SHARD_BYTES = 12 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 1 << 12
SLICE = 1 << 12  # counts that move together

SPACE, BREAK = 1, 2
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[[0x20, 0x09]] = SPACE
CLASS[[*b".,;:!?\n\x0b\x0c\r"]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = mix(np.arange(1, 257))  # a number for each byte


class Chunk:
    """The words of some texts: lowered, each followed by a space, or by a newline at a piece's end."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        kind = CLASS[raw]
        word = kind == 0
        before = np.concatenate([[False], word[:-1]])
        starts = np.flatnonzero(word & ~before)
        ends = np.flatnonzero(~word & before)
        breaks = np.cumsum(kind == BREAK, dtype=np.int32)
        self.joined = np.zeros(len(starts), dtype=bool)  # with the next word in a piece
        self.joined[:-1] = breaks[starts[1:] - 1] == breaks[ends[:-1] - 1]
        low = LOWER[raw]
        low[ends] = np.where(self.joined, 32, 10)
        word[ends] = True
        self.bytes = low[word]
        self.size = ends - starts
        self.starts = np.cumsum(self.size + 1) - self.size - 1
        self.slots = np.array([zlib.crc32(t) % SLOTS for t in texts], dtype=np.int32)
        text_starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        self.names, codes = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.text = np.searchsorted(text_starts, starts, side="right") - 1
        self.lang = codes[self.text]

    def hashes(self) -> np.ndarray:
        """A number for each word and language."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        place = np.arange(len(self.bytes)) - np.repeat(self.starts, self.size + 1)
        power = np.cumprod(np.full(int(self.size.max()) + 1, ODD))
        letters = np.where(self.bytes == 10, 32, self.bytes)
        words = np.add.reduceat(BYTE[letters] * power[place], self.starts)
        salt = [hashlib.blake2b(n.encode(), digest_size=8).digest() for n in self.names]
        return mix(words ^ np.frombuffer(b"".join(salt), dtype=np.uint64)[self.lang])

    def grams(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they are all there in the piece."""
        out, there = words, np.ones(len(words), dtype=bool)
        for i in range(1, k):
            ahead = np.concatenate([words[i:], np.zeros(min(i, len(words)), dtype=np.uint64)])
            linked = np.concatenate([self.joined[i - 1 :], np.zeros(min(i - 1, len(words)), dtype=bool)])
            there = there & linked
            out = mix(out * ODD + ahead)
        return out, there

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The texts of k words from each of the given words on."""
        last = at + k - 1
        begin = self.starts[at]
        size = self.starts[last] + self.size[last] - begin
        ends = np.cumsum(size)
        places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - begin, size)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        data = self.bytes[places]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))


def _segments(text: bytes, limit: int) -> Iterator[bytes]:
    """A text cut into parts of about `limit` bytes where pieces end."""
    start = 0
    if len(text) > limit:
        ends = np.flatnonzero(CLASS[np.frombuffer(text, dtype=np.uint8)] == BREAK) + 1
        while len(text) - start > limit:
            at = int(np.searchsorted(ends, start + limit, side="right"))
            # the last end within the limit, or else the next one
            at -= at > 0 and ends[at - 1] > start
            if at == len(ends):
                break
            yield text[start : int(ends[at])]
            start = int(ends[at])
    yield text[start:]


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Chunk]:
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(
            batch.column("text").cast(pa.binary()), batch.column("lang"), strict=True
        ):
            for part in _segments(text.as_py(), limit):
                texts.append(part)
                langs.append(lang.as_py())
                size += len(part)
                if size >= limit:
                    yield Chunk(texts, langs)
                    texts, langs, size = [], [], 0
    if texts:
        yield Chunk(texts, langs)


HELD = 1 << 20  # hashes that a task holds before it adds them up and hands them on
FILTER_WORDS = 1 << 20


def _word_and_bits(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a filter that a hash belongs to, and its four bits there."""
    one, bits = np.uint64(1), np.zeros(len(hashes), dtype=np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= one << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return ((hashes >> np.uint64(24)) % np.uint64(words)).astype(np.int64), bits


def _passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at, bits = _word_and_bits(hashes, len(words))
    return (words[at] & bits) == bits


def _filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of the one column of longs, 16 bits each, at most 8 MB."""
    size = min(FILTER_WORDS, max(16, -(-hashes.count() // 4)))
    name = hashes.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bits = _word_and_bits(batch.column(name).to_numpy().view(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], names=["word", "bits"])

    words = hashes.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()  # at most FILTER_WORDS rows
    out = np.zeros(size, dtype=np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _hash_counts(k: int, parts, limit: int):
    """Counts by hash of the phrases of k words whose two parts pass the filter, and their least slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for chunk in _chunks(batches, limit):
            words = chunk.hashes()
            grams, there = chunk.grams(words, k)
            if parts is not None:
                before, _ = chunk.grams(words, k - 1)
                hold = np.append(_passes(parts.value, before), False)
                there = there & hold[:-1] & hold[1:]
            slots = chunk.slots[chunk.text]
            held.append(_added([(grams[there], np.ones(int(there.sum()), dtype=np.int64), slots[there])]))
            size += len(held[-1][0])
            if size > HELD:
                held = [_added(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield _hash_batch(*held[0])
                    held, size = [], 0
        if held:
            yield _hash_batch(*_added(held))

    return run


def _added(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal hashes added up, and their least slot."""
    hashes, counts, slots = (np.concatenate(part) for part in zip(*held, strict=True))
    if not len(hashes):
        return hashes, counts, slots
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return (
        hashes[first], np.add.reduceat(counts[order], first), np.minimum.reduceat(slots[order], first)
    )


def _hash_batch(hashes: np.ndarray, counts: np.ndarray, slots: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes.view(np.int64)), pa.array(counts), pa.array(slots)], names=["hash", "n", "slot"]
    )


def _in_slot(hashes: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return mix(hashes + slots.astype(np.uint64) * ODD)


LISTED = pa.schema(
    [("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())]
)


def _list(filters: list, limit: int):
    """Phrases of each chunk that pass the filters of their length, alone and with their slot; the
    number of all words of a language is with the phrase of no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, limit):
            names, size = pa.array(chunk.names, pa.string()), len(chunk.names)
            total = np.bincount(chunk.lang, minlength=size)
            yield pa.RecordBatch.from_arrays(
                [names, pa.array([""] * size), pa.array([0] * size, pa.int32()), pa.array(total)],
                schema=LISTED,
            )
            words, slots = chunk.hashes(), chunk.slots[chunk.text]
            for k, (heavy, keyed) in enumerate(filters, 1):
                grams, there = chunk.grams(words, k)
                at = np.flatnonzero(there)
                at = at[_passes(heavy.value, grams[at])]
                at = at[_passes(keyed.value, _in_slot(grams[at], slots[at]))]
                _, first = np.unique(grams[at], return_index=True)
                at = at[first]
                zero = pa.array(np.zeros(len(at), dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(chunk.lang[at])), chunk.phrases(at, k),
                     pa.array(np.full(len(at), k, dtype=np.int32)), zero], schema=LISTED,
                )

    return run


def _keys(counts: DataFrame) -> DataFrame:
    """The hashes with their least slots, as `_list` looks them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, slots = (batch.column(c).to_numpy() for c in ("hash", "slot"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_in_slot(hashes.view(np.uint64), slots).view(np.int64))], names=["key"]
            )

    return counts.mapInArrow(run, "key long")


class Trie:
    """A double-array trie of (lang, phrase) pairs over bytes; every word ends with a space.

    A node with one child takes any free place, the others a window of places from their least to
    their largest byte.
    """

    def __init__(self, keys: list[tuple[str, bytes]]):
        langs = sorted({lang for lang, _ in keys})
        self.roots = {lang: i for i, lang in enumerate(langs)}
        parent, label = array("i", bytes(4 * len(langs))), bytearray(len(langs))
        ends, keys_of = array("i"), array("i")
        path, last = [0], (None, b"")
        spaced = [(lang, phrase + b" ") for lang, phrase in keys]
        for i in sorted(range(len(keys)), key=spaced.__getitem__):
            lang, phrase = spaced[i]
            same = 0
            if lang == last[0]:
                same = len(os.path.commonprefix([phrase, last[1]]))
            else:
                path = [self.roots[lang]]
            del path[same + 1 :]
            new = range(len(parent), len(parent) + len(phrase) - same)
            if new:
                parent.append(path[-1])
                parent.extend(new[:-1])
                label += phrase[same:]
                path.extend(new)
            ends.append(path[-1])
            keys_of.append(i)
            last = lang, phrase
        del spaced
        count = len(parent)
        parent, label = np.array(parent, dtype=np.int32), np.frombuffer(label, dtype=np.uint8).astype(np.int32)
        child = np.arange(len(langs), count, dtype=np.int32)
        least, most = np.full(count, 255, dtype=np.int32), np.zeros(count, dtype=np.int32)
        np.minimum.at(least, parent[child], label[child])
        np.maximum.at(most, parent[child], label[child])
        n = np.bincount(parent[child], minlength=count)
        many = np.flatnonzero(n > 1)
        width = most[many] - least[many] + 1
        offset = len(langs) + 256 + np.cumsum(width) - width
        base = np.zeros(count, dtype=np.int32)
        base[many] = offset - least[many]
        wide = np.flatnonzero(n[parent] > 1)
        wide = wide[wide >= len(langs)]
        taken = np.zeros(len(langs) + 256 + int(width.sum()), dtype=bool)
        taken[: len(langs) + 256] = True
        taken[base[parent[wide]] + label[wide]] = True
        single = np.flatnonzero(n == 1)
        free = np.flatnonzero(~taken)[: len(single)]
        free = np.concatenate([free, len(taken) + np.arange(len(single) - len(free))])
        base[single] = free - least[single]
        slot = np.arange(count, dtype=np.int32)
        slot[child] = base[parent[child]] + label[child]
        size = int(slot.max(initial=0)) + 257
        self.base = np.zeros(size, dtype=np.int32)
        self.check = np.full(size, -1, dtype=np.int32)
        self.accept = np.full(size, -1, dtype=np.int32)
        self.base[slot] = base
        self.check[slot[child]] = slot[parent[child]]
        self.accept[slot[np.array(ends, dtype=np.int32)]] = np.array(keys_of, dtype=np.int32)
        self.keys = len(keys)

    def count(self, chunk: Chunk) -> np.ndarray:
        """How often each key occurs in the chunk."""
        codes = np.where(chunk.bytes == 10, 32, chunk.bytes).astype(np.int32)
        root = np.array([self.roots.get(name, -1) for name in chunk.names], dtype=np.int32)[chunk.lang]
        state, at = root[root >= 0], chunk.starts[root >= 0].astype(np.int32)
        accepted = []
        while len(at):
            code = codes[at]
            to = self.base[state] + code
            good = np.flatnonzero(self.check[to] == state)
            state, at = to[good], at[good]
            ended = np.flatnonzero(code[good] == 32)
            if len(ended):
                accepted.append(state[ended])
                stop = ended[chunk.bytes[at[ended]] == 10]
                state, at = np.delete(state, stop), np.delete(at, stop)
            at += 1
        keys = self.accept[np.concatenate([np.zeros(0, dtype=np.int64), *accepted])]
        return np.bincount(keys[keys >= 0], minlength=self.keys)


def _count(texts: DataFrame, shard: DataFrame, limit: int) -> DataFrame:
    """(id, f) of the phrases of a shard (id, lang, phrase)."""
    rows = shard.toArrow()  # at most about SHARD_BYTES bytes of phrases
    langs, phrases = rows["lang"].to_pylist(), rows["phrase"].cast(pa.binary()).to_pylist()
    trie = Trie(list(zip(langs, phrases, strict=True)))
    ids = rows["id"].to_numpy()
    del rows, langs, phrases
    shared = texts.sparkSession.sparkContext.broadcast((trie, ids))  # 12 bytes a node and some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ids = shared.value
        sums = np.zeros(len(ids), dtype=np.int64)
        for chunk in _chunks(batches, limit):
            sums += trie.count(chunk)
        parts = [sums[i : i + SLICE] for i in range(0, len(sums), SLICE)]
        held = [i for i, part in enumerate(parts) if part.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), pa.array([parts[i].tobytes() for i in held], pa.binary())],
            names=["slice", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums = shared.value[1], {}
        for batch in batches:
            for number, counts in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                sums[number] = sums.get(number, 0) + np.frombuffer(counts.as_py(), dtype=np.int64)
        for number, counts in sums.items():
            own = ids[number * SLICE : number * SLICE + SLICE][counts > 0]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[counts > 0])], names=["id", "f"])

    # a row for every SLICE counts, not for every phrase
    sliced = texts.mapInArrow(run, "slice long, counts binary").repartition(partitions(texts), "slice")
    sums = sliced.mapInArrow(add, "id long, f long")
    out = materialise(sums)
    shared.unpersist()
    return out


def frequent_phrases(
    docs: DataFrame, least: int = 30, longest: int = LONGEST, chunk_bytes: int = CHUNK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of the phrases of up to `longest` words that occur `least` times in a
    lang, and (lang, n): its words."""
    texts = docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    spark, parts, filters = docs.sparkSession, None, []
    for k in range(1, longest + 1):
        counts = texts.mapInArrow(_hash_counts(k, parts, chunk_bytes), "hash long, n long, slot int")
        sums = counts.groupBy("hash").agg(F.sum("n").alias("n"), F.min("slot").alias("slot"))
        heavy = materialise(sums.where(F.col("n") >= least).select("hash", "slot"))
        parts = spark.sparkContext.broadcast(_filter(heavy.select("hash")))  # at most 8 MB
        filters.append((parts, spark.sparkContext.broadcast(_filter(_keys(heavy)))))
    schema = "lang string, phrase string, words int, n long"
    listed = texts.mapInArrow(_list(filters, chunk_bytes), schema)
    listed = materialise(listed.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")))
    totals = listed.where("words = 0").select("lang", "n")
    phrases = listed.where("words > 0").select("lang", "phrase", "words")
    every = materialise(phrases.withColumn("id", F.monotonically_increasing_id()))
    size = every.agg(F.sum(F.octet_length("phrase") + 1)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    part = F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards))
    counted = [
        _count(texts, every.where(part == s).select("id", "lang", "phrase"), chunk_bytes)
        for s in range(shards)
    ]
    sums = counted[0]
    for more in counted[1:]:
        sums = sums.unionByName(more)
    return every.join(sums, "id").where(F.col("f") >= least).drop("id"), totals


def collocations(
    docs: DataFrame, least: int = 30, top: int = 2000, cover: int = 80, **how
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of two words or more of each lang.

    score is the floor of 2,000,000 a / (l + r) at the cut where it is lowest. A phrase inside a longer
    one that occurs at least `cover` % as often is left out.
    """
    counts, totals = frequent_phrases(docs, least, **how)
    counts = materialise(counts)
    words = F.split("phrase", " ")
    wide = lambda c: F.col(c).cast("decimal(25,0)")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", "words", "a", cut).select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("head"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("tail"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn(
        "sum", wide("l") + wide("r")
    ).withColumn("wide_a", wide("a") * F.lit(2_000_000).cast("decimal(7,0)"))
    scored = both.withColumn("score", F.expr("wide_a div sum")).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best")
    )
    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda k: F.transform(
                F.sequence(F.lit(1), F.col("words") - k + 1),
                lambda i: F.array_join(F.slice(words, i, k), " "),
            ),
        )
    )
    longer = (
        candidates.where("words > 2").select("lang", "a", F.explode(F.array_distinct(inside)).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * cover)
    )
    order = W.partitionBy("lang").orderBy(
        F.col("best.score").desc(), F.col("a").desc(), F.col("phrase")
    )
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
        F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"),
    )

