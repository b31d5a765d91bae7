"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, and their components.

Equal sets are one node. A node's n-grams are ordered rare first; two sets that overlap enough share
an n-gram among the first of both (the prefix), so only prefixes are joined. The order needs no exact
frequencies, only the same ones everywhere: they come from a table of SLOTS counters that all
n-grams of the corpus are counted into, bounded however large the corpus is.

Candidates pass a length filter, a positional filter (what is left behind the shared n-gram must
suffice) and a suffix filter (the sets are cut into 256 parts by hash; the smaller counts of each
part bound the overlap). What remains is verified once per pair on whole sets.

Groups of near copies would give a pair for any two members, so candidates come in two steps. First
every node of an n-gram is paired with the node that has it earliest and with its neighbours by
length; verified links make components. Then all other pairs of the n-gram are looked at, but only
those between components, which is all that can still join anything. N-grams that very many nodes
share are cut into blocks, and blocks meet pairwise in bounded tasks.

Defined results: n-grams are hashed to 64 bits. A text with fewer words than an n-gram is one n-gram;
a missing, empty or blank one has none and links with nothing. Rows without doc_id take part, but
can't name a component. Repeated rows are in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.llm.components import components
from areascope.llm.sketch import id_filter, may_hold, mix, prefilter
from areascope.llm.text import partitions
from areascope.session import materialise

WORDS = 5
PERCENT = 75
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
PIECES = 64
COUNTS = "piece int, sender int, counts binary"
SLICE_ROWS = 512
PARTS = 256
GROUP_ROWS = 1024
HOT_SHARE = 0.25

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        for i, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case; words end at white space of ASCII."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    change = np.flatnonzero(space[1:] != space[:-1])
    start, end = change[::2], change[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    w = word_hashes(text or "")
    n = min(words, len(w))
    if not n:
        return w
    code = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        code = code * np.uint64(_BASE) + w[k : len(w) - n + 1 + k]
    return np.unique(mix(code))


def node_of(grams: np.ndarray) -> int:
    """Id of a set: a hash of its members, in any order."""
    members = mix(grams + np.uint64(0x632BE59BD9B4E019))
    total = np.append(members, np.uint64(len(grams))).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total).view(np.int64)[0])


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _part_counts(grams: np.ndarray) -> bytes:
    """Numbers of members by hash part; the last bits, which the order doesn't use."""
    counts = np.bincount((grams & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
    return counts.astype("<u4").tobytes() if counts.max() > 255 else counts.astype("u1").tobytes()


def _read_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="u1" if len(raw) == PARTS else "<u4").astype(np.int64)


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts of few texts, so that what a task holds and sends at once stays small."""
    for start in range(0, len(batch), SLICE_ROWS):
        yield batch.iloc[start : start + SLICE_ROWS]


def _count_rows(sums: dict, sender: int) -> Iterator[pd.DataFrame]:
    for piece, counts in sums.items():
        kind = "<u2" if counts.max() < 65536 else "<u8"
        yield pd.DataFrame(
            {"piece": [piece], "sender": [sender], "counts": [counts.astype(kind).tobytes()]}
        )


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, parts) of every row, node and parts null for empty sets; and each task's
    counts of its n-grams by slot, rows with a `piece`, so that texts are cut up once for both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for rows in _slices(batch):
                found = [shingles(t) for t in rows["text"]]
                np.add.at(total, _slot(np.concatenate(found)), 1)
                yield whole(
                    doc_id=rows["doc_id"].to_numpy(),
                    node=pd.array([node_of(g) if len(g) else None for g in found], dtype="Int64"),
                    n=[len(g) for g in found],
                    parts=[_part_counts(g) if len(g) else None for g in found],
                )
        if total.any():
            sums = dict(enumerate(total.reshape(PIECES, SLOTS // PIECES)))
            for rows in _count_rows(sums, TaskContext.get().partitionId() % PIECES):
                yield whole(**rows)

    def whole(**columns) -> pd.DataFrame:
        size = len(columns.get("n", [0]))
        empty = {c: [None] * size for c in names}
        return pd.DataFrame(empty | columns)

    schema = f"doc_id long, node long, n int, parts binary, {COUNTS}"
    names = ["doc_id", "node", "n", "parts", "piece", "sender", "counts"]
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def frequencies(parts: DataFrame) -> np.ndarray:
    """Counts of all n-grams by slot, from the counts of the tasks; two levels add them up."""
    size = SLOTS // PIECES

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for piece, sender, raw in zip(batch["piece"], batch["sender"], batch["counts"]):
                counts = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * size else "<u8")
                key = (int(piece), int(sender))
                sums[key] = sums.get(key, 0) + counts.astype(np.int64)
        for (piece, sender), counts in sums.items():
            yield from _count_rows({piece: counts}, sender)

    width = partitions(parts)
    parts = parts.repartition(width, "piece", "sender").mapInPandas(add, COUNTS)
    parts = parts.withColumn("sender", F.lit(0)).repartition(PIECES, "piece")
    total = np.zeros((PIECES, size), dtype=np.int64)
    for row in parts.mapInPandas(add, COUNTS).collect():  # PIECES rows, SLOTS numbers
        raw = row["counts"]
        total[row["piece"]] = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * size else "<u8")
    return np.minimum(total.reshape(-1), (1 << 32) - 1).astype(np.uint32)


def prefix_size(n, percent: int = PERCENT):
    """So many of n ordered members that two sets with enough overlap share one of them."""
    return n - (n * percent + 99) // 100 + 1


def needed(n, m, percent: int = PERCENT):
    """Least intersection of sets of n and m members: 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def prefixes(docs: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(gram, salt, node, n, pos): the rare-first prefix of each node, once per task.

    An n-gram whose slot holds more than a good share of a task's rows gets a salt by node.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # SLOTS numbers
    total = int(counts.sum())
    hot = max(64 * total // SLOTS, int(HOT_SHARE * total / partitions(docs)), 256)
    hot = min(hot, 1 << 31)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, done = shared.value, set()
        for batch in (rows for whole in batches for rows in _slices(whole)):
            parts = []
            for text in batch["text"]:
                grams = shingles(text)
                node = node_of(grams) if len(grams) else None
                if node is None or node in done:
                    continue
                done.add(node)
                often = counts[_slot(grams)]
                n = len(grams)
                first = np.lexsort((grams, often))[: prefix_size(n, percent)]
                salts = -(-often[first].astype(np.int64) // hot)
                salt = np.where(salts > 1, 1 + (node & 0x7FFFFFFF) % np.maximum(salts, 1), 0)
                parts.append((grams[first].view(np.int64), salt, node, n))
            if parts:
                sizes = [len(p[0]) for p in parts]
                yield pd.DataFrame(
                    {
                        "gram": np.concatenate([p[0] for p in parts]),
                        "salt": np.concatenate([p[1] for p in parts]).astype(np.int32),
                        "node": np.repeat([p[2] for p in parts], sizes),
                        "n": np.repeat([p[3] for p in parts], sizes).astype(np.int32),
                        "pos": np.concatenate([np.arange(k) for k in sizes]).astype(np.int32),
                    }
                )

    return docs.select("text").mapInPandas(
        run, "gram long, salt int, node long, n int, pos int"
    )


def shared_grams(rows: DataFrame) -> DataFrame:
    """(gram, node, n, pos) without n-grams that only one node has; salted ones all stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in batches:
            if left is not None:
                batch = pd.concat([left, batch], ignore_index=True)
            gram, node = batch["gram"].to_numpy(), batch["node"].to_numpy()
            # the last n-gram may go on in the next batch
            end = int(np.searchsorted(gram, gram[-1]))
            yield keep(batch.iloc[:end], gram[:end], node[:end])
            left = batch.iloc[end:]
            if len(left) > 1:
                left = left.drop_duplicates(["gram", "salt", "node"])
        if left is not None:
            yield keep(left, left["gram"].to_numpy(), left["node"].to_numpy())

    def keep(rows, gram, node):
        if not len(rows):
            return rows.drop(columns="salt")
        same = gram[1:] == gram[:-1]
        new = np.concatenate([[True], ~(same & (node[1:] == node[:-1]))])
        rows, gram = rows[new], gram[new]
        same = gram[1:] == gram[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return rows[many | (rows["salt"].to_numpy() > 0)].drop(columns="salt")

    placed = rows.repartition(partitions(rows), "gram", "salt")
    placed = placed.sortWithinPartitions("gram", "node")
    return placed.mapInPandas(run, "gram long, node long, n int, pos int")


def _passes(n, m, i, j, percent: int):
    """Length and positional filter for sets of n and m members that share members i and j."""
    least = needed(n, m, percent)
    return (np.minimum(n, m) * 100 >= percent * np.maximum(n, m)) & (
        np.minimum(n - i, m - j) >= least
    )


def _sql_passes(a: str, b: str, percent: int):
    n, m, i, j = (F.col(x).cast("long") for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    enough = F.least(n - i, m - j) * (100 + percent) >= (n + m) * percent
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & enough


def first_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with the node that has an n-gram earliest, and neighbours by length."""
    hub = shared.groupBy("gram").agg(F.min(F.struct("pos", "n", "node")).alias("h"))
    hub = hub.select("gram", "h.pos", "h.n", "h.node")
    joined = shared.alias("s").join(materialise(hub).alias("h"), "gram")
    stars = joined.where(
        (F.col("s.node") != F.col("h.node")) & _sql_passes("s", "h", percent)
    ).select(F.col("s.node").alias("a"), F.col("h.node").alias("b"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            g, v, n, p = (batch[c].to_numpy() for c in ("gram", "node", "n", "pos"))
            n, p = n.astype(np.int64), p.astype(np.int64)
            good = (g[1:] == g[:-1]) & _passes(n[1:], n[:-1], p[1:], p[:-1], percent)
            pairs = pd.DataFrame({"a": v[1:][good], "b": v[:-1][good]})
            yield pairs.drop_duplicates()

    order = ["gram", "n", "node"]
    lined = shared.repartitionByRange(partitions(shared), *order).sortWithinPartitions(*order)
    near_pairs = lined.mapInPandas(near, "a long, b long")
    return _distinct(stars.unionByName(near_pairs))


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).where("a < b").distinct()


def later_pairs(shared: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes that share an n-gram and are in different components so far."""
    marked = materialise(
        shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    split = marked.groupBy("gram").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows")
    ).where("lo <> hi")
    blocks = F.ceil(F.col("rows") / GROUP_ROWS).cast("int").alias("blocks")
    rows = marked.join(materialise(split.select("gram", blocks)), "gram")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a block meets every block, itself included; most n-grams are one block
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other).select(
        "gram", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "own", "node", "root", "n", "pos",
    )
    key = ["gram", "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in batches:
            if left is not None:
                batch = pd.concat([left, batch], ignore_index=True)
            last = (batch[key] == batch[key].iloc[-1]).all(axis=1).to_numpy()
            end = int(np.argmax(last))
            yield meet(batch.iloc[:end])
            left = batch.iloc[end:]
        if left is not None:
            yield meet(left)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs of rows of a group at distance 1, 2, ... until no group is that long."""
        pairs = []
        if len(rows):
            keys = rows[key].to_numpy()
            new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
            group = np.cumsum(new) - 1
            ends = np.append(np.flatnonzero(new)[1:], len(rows))[group]
            node, root, own = (rows[c].to_numpy() for c in ("node", "root", "own"))
            n, pos = rows["n"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64)
            mixed = (rows["low"] != rows["high"]).to_numpy()
            at, step = np.arange(len(rows)), 1
            while True:
                at = at[at + step < ends[at]]
                if not len(at):
                    break
                to = at + step
                # rows of one block meet in that block's own group
                ok = (root[at] != root[to]) & ~(mixed[at] & (own[at] == own[to]))
                a, b = at[ok], to[ok]
                good = _passes(n[a], n[b], pos[a], pos[b], percent)
                if good.any():
                    pairs.append(np.stack([node[a[good]], node[b[good]]], axis=1))
                step += 1
        found = np.concatenate(pairs) if pairs else np.zeros((0, 2), dtype=np.int64)
        found = np.unique(np.sort(found, axis=1), axis=0)
        return pd.DataFrame(found, columns=["a", "b"])

    placed = rows.repartition(partitions(rows), *key).sortWithinPartitions(*key)
    return _distinct(placed.mapInPandas(run, "a long, b long"))


def _suffix_filter(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = np.zeros(len(batch), dtype=bool)
            parts = zip(batch["n"], batch["m"], batch["parts_a"], batch["parts_b"])
            for k, (n, m, a, b) in enumerate(parts):
                most = np.minimum(_read_counts(a), _read_counts(b)).sum()
                good[k] = most >= needed(int(n), int(m), percent)
            yield batch.loc[good, ["a", "b"]]

    return run


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = np.zeros(len(batch), dtype=bool)
            for k, (a, b) in enumerate(zip(batch["text_a"], batch["text_b"])):
                both = np.concatenate([shingles(a), shingles(b)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good[k] = 100 * common >= percent * (len(both) - common)
            yield batch.loc[good, ["a", "b"]]

    return run


def texts_of(docs: DataFrame, nodes: DataFrame, words: np.ndarray, ids: np.ndarray) -> DataFrame:
    """(node, text) of the named nodes only: filters first, then a join that settles it.

    Only rows whose doc_id may be in the filter `ids`, or that have none, are cut up. Texts take
    half the room of the sets of hashes that they give.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words, ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = set()
        for batch in batches:
            maybe = batch["doc_id"].isna().to_numpy()
            named = np.flatnonzero(~maybe)
            known = batch["doc_id"].to_numpy()[named].astype(np.int64)
            maybe[named] = may_hold(shared.value[1], known)
            for rows in _slices(batch[maybe]):
                yield kept(rows["text"].to_numpy(), done)

    def kept(texts: np.ndarray, done: set) -> pd.DataFrame:
        found = [(k, shingles(t)) for k, t in enumerate(texts)]
        at = [k for k, g in found if len(g)]
        nodes = np.array([node_of(g) for _, g in found if len(g)], dtype=np.int64)
        out = {}
        for k in np.flatnonzero(may_hold(shared.value[0], nodes)):
            if int(nodes[k]) not in done:
                done.add(int(nodes[k]))
                out[int(nodes[k])] = texts[at[k]]
        return pd.DataFrame({"node": np.array([*out], dtype=np.int64), "text": [*out.values()]})

    rows = docs.select("doc_id", "text").mapInPandas(run, "node long, text string")
    return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _nodes(pairs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The nodes of pairs and a filter of them."""
    nodes = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    return nodes, id_filter(nodes, nodes.count())


def verified(docs: DataFrame, pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link; `info` has (node, n, parts, first_id)."""
    few = prefilter(info.select("node", "n", "parts"), "node", _nodes(pairs)[1])
    a = few.select(F.col("node").alias("a"), "n", F.col("parts").alias("parts_a"))
    b = few.select(
        F.col("node").alias("b"), F.col("n").alias("m"), F.col("parts").alias("parts_b")
    )
    left = materialise(
        pairs.join(a, "a").join(b, "b").mapInPandas(_suffix_filter(percent), "a long, b long")
    )
    nodes, words = _nodes(left)
    firsts = info.join(nodes, "node", "left_semi").where("first_id IS NOT NULL").select("first_id")
    firsts = materialise(firsts)
    found = materialise(texts_of(docs, nodes, words, id_filter(firsts, firsts.count())))
    a = found.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = found.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return materialise(
        left.join(a, "a").join(b, "b").mapInPandas(_verify(percent), "a long, b long")
    )


def join_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, node, component_id) of every row.

    component_id is the smallest doc_id that links lead to; node names the class of equal sets.
    """
    both = materialise(sets(docs))
    rows = both.where("piece IS NULL").select("doc_id", "node", "n", "parts")
    info = materialise(
        rows.where("node IS NOT NULL").groupBy("node").agg(
            F.first("n").alias("n"), F.first("parts").alias("parts"),
            F.min("doc_id").alias("first_id"),
        )
    )
    counts = frequencies(both.where("piece IS NOT NULL").select("piece", "sender", "counts"))
    shared = materialise(shared_grams(prefixes(docs, counts, percent)))
    links = verified(docs, materialise(first_pairs(shared, percent)), info, percent)
    roots = materialise(components(links))
    later = materialise(later_pairs(shared, roots, percent))
    links = links.unionByName(verified(docs, later, info, percent))
    roots = components(links)
    known = materialise(
        info.select("node", "first_id").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    firsts = known.groupBy("root").agg(F.min("first_id").alias("component"))
    known = known.join(firsts, "root").select(F.col("node").alias("__node"), "component")
    out = rows.select("doc_id", "n", "node").join(
        known, F.col("node") == F.col("__node"), "left"
    )
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "node",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
        .alias("component_id"),
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those that another document of their component stands for.

    Rows with the same doc_id are one document; rows without doc_id stay.
    """
    found = join_components(docs, percent)
    gone = materialise(
        found.groupBy("doc_id").agg(
            F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept")
        ).where((F.col("kept") == 0) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("__gone"))
    )
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
