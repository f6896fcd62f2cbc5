"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into ranges, the fragments; each document sends
each fragment the n-grams that it has there, packed. No fragment sees a whole document and no document is compared with all
others. The fragments are passed twice:

* First a fragment tells each document which of its n-grams there some other document has. The parts are summed per
  document: one whose shared n-grams are fewer than 75 % of its set can be linked with nothing and is done. Where most of a
  corpus is original text this leaves few.
* Then the shared n-grams of the others are cut by the order again, and a fragment counts, for every two documents that meet
  there, how many they share. With what is left of both elsewhere this bounds their overlap; pairs that can still be linked
  are sent on, and their counts are summed over the fragments.

N-grams that ``HOT`` documents or more share make no pairs; they are kept with each of their documents, as its hot list. A
fragment knows which of its n-grams these are. The most frequent, at most ``HOT_LIST`` by a count of what each task saw
more than once of a sample of ``SAMPLE`` documents, are known before and skip the fragments, so that none fills a task; which
ones does not change the result. All documents are read once besides, and their rows pass through the fragments with them.
So a pair has two parts: the sum over the fragments, and the overlap of two hot lists, which is taken only where it could
decide. A pair without any fragment in common can be linked only if 75 % of either set are hot; such documents go another
way (``hot_links``), which links them into the same components without making all their pairs.

The number of fragments follows the n-grams to cut (``FRAGMENT`` in each). Documents of equal sets are one node, named by a
64-bit hash of the set. Hashes of n-grams travel as the fragment and 48 bits: for two sets of 10,000 the chance that an
overlap is off is below 1e-6, whatever the size of the corpus.

Defined results: null, empty and blank texts have size 0 and link with nothing, so each is its own component; fewer words
than ``SHINGLE`` make one n-gram; a null doc_id takes part but never names a component, unless it holds nulls alone;
repeated rows each give a row of the same component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.components import connected_components
from veilframe.llm.tables import partitions, table, written
from veilframe.llm.text import RunHasher, distinct, words

HOT, HOT_LIST, LOCAL, CHUNK, BLOCK = 24, 65_536, 2, 1_000_000, 2048
#: N-grams in a fragment, the least number of fragments that count pairs, and the pairs that one holds at once.
FRAGMENT, COUNTING, PAIRS = 4_000_000, 4, 4_000_000
#: Documents that the survey reads, and its tasks. It only foresees which n-grams are frequent and how many there are.
SAMPLE, SURVEYORS = 20_000, 8
#: Columns of a matrix that counts overlaps.
SLAB = 4096


def node_of(grams: np.ndarray) -> int:
    """The name of a set, given sorted."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def survey(docs: DataFrame) -> DataFrame:
    """kind 0: how many n-grams (n) the documents of a batch have. kind 1: an n-gram (as node) that n documents of one chunk share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size, seen = RunHasher(), [], 0, set()

        def shared() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            use = n >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(np.ones(int(use.sum()), np.int32)), pa.array(grams[use].view(np.int64)), pa.array(n[use].astype(np.int64))], ["kind", "node", "n"])

        for b in batches:
            total = 0
            for t in b.column("t").to_pylist():
                found = words(t)
                if not found:
                    continue
                grams = hasher.shingles(found)
                total += len(grams)
                if (node := node_of(grams)) not in seen:
                    seen.add(node)
                    held.append(grams)
                    size += len(grams)
                    if size >= 2 * CHUNK:
                        yield shared()
                        held, size, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], ["kind", "node", "n"])
        if held:
            yield shared()

    return written(docs.select("t").mapInArrow(run, "kind int, node long, n long"), "ngram-survey")


def surveyed_share(docs: DataFrame, n_rows: int, most: int) -> tuple[DataFrame, float]:
    """``survey`` of some ``most`` of the documents, and their share of all."""
    share = min(1.0, most / max(1, n_rows))
    return survey(docs.select("t").sample(share, 20240229).repartition(SURVEYORS) if share < 1 else docs), share


def hot_grams(surveyed: DataFrame, hot: int = HOT, most: int = HOT_LIST) -> np.ndarray:
    """The hot n-grams, rarest first."""
    counts = surveyed.where("kind = 1").groupBy("node").agg(F.sum("n").alias("c")).where(F.col("c") >= hot)
    held, least = 0, None
    for r in sorted(counts.groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r.c):
        if held + r.k > most:
            break
        held, least = held + r.k, r.c
    if least is None:
        return np.zeros(0, np.uint64)
    rows = sorted((r.c, r.node) for r in counts.where(F.col("c") >= least).collect())
    return np.array([n for _, n in rows], np.int64).view(np.uint64)


#: What a blob says of each of its documents: its node and size, how many codes follow, and of these how many are hot (or, where
#: pairs are counted, how many more it has elsewhere). Each stands for all documents together, so that small numbers and zeros
#: take next to nothing once compressed: with many fragments there is one such head for nearly every n-gram.
_HEAD = {"node": "<i8", "n": "<u4", "k": "<u4", "h": "<u4"}


def stable_order(key: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """The order that sorts ``key`` (none below 0), equal ones as in ``order``: by digits of 16 bits, which numpy sorts by radix."""
    most, shift = int(key.max(initial=0)), 0
    while most >> shift:
        digit = (key >> shift).astype(np.uint16)
        order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
        shift += 16
    return np.arange(len(key)) if order is None else order


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, where one of each stands, and for each entry the number of its value."""
    order = np.argsort(key)
    now = key[order]
    new = np.concatenate([[True], now[1:] != now[:-1]]) if len(key) else np.zeros(0, bool)
    number = np.empty(len(key), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return now[new], order[new], number


def blobs_of(head: dict[str, np.ndarray], head_cut: np.ndarray, codes: bytes = b"", code_cut: np.ndarray | None = None) -> list[bytes]:
    """The blobs of heads and codes that are cut so."""
    columns = [(head[c].astype(kind).tobytes(), np.dtype(kind).itemsize) for c, kind in _HEAD.items()]
    cuts = head_cut.tolist()
    tails = [0] * len(cuts) if code_cut is None else code_cut.tolist()
    return [b"".join([(y - x).to_bytes(4, "little"), *[c[x * w : y * w] for c, w in columns], codes[p:q]]) for x, y, p, q in zip(cuts, cuts[1:], tails, tails[1:])]


def packed(target: np.ndarray, doc: np.ndarray, code: np.ndarray, node: np.ndarray, n: np.ndarray, last: np.ndarray | None = None, whole: np.ndarray | None = None, width: int = 8) -> tuple[np.ndarray, list[bytes]]:
    """Targets, and a blob for each: heads of its documents, then ``width`` bytes of each code. The codes of a document come
    ascending. ``last`` marks those that stand last in their document and are counted in its head; ``whole`` has the codes of
    each document over all targets."""
    last = np.zeros(len(doc), bool) if last is None else last
    order = None if not len(last) or last.all() or not last.any() else np.argsort(last, kind="stable")
    if order is not None or (doc[1:] < doc[:-1]).any():
        order = stable_order(doc, order)
    order = stable_order(target, order)
    target, doc, code, last = target[order], doc[order], code[order], last[order]
    start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (target[1:] != target[:-1])])) if len(doc) else np.zeros(0, np.int64)
    k = np.diff(np.append(start, len(doc)))
    h = np.add.reduceat(last, start, dtype=np.int64) if whole is None else whole[doc[start]] - k
    head = {"node": node[doc[start]], "n": n[doc[start]], "k": k, "h": h}
    raw = np.ascontiguousarray(code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    at = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
    cut, head_cut = np.append(at, len(target)), np.append(np.searchsorted(start, at), len(start))
    return target[at], blobs_of(head, head_cut, raw.tobytes(), cut * width)


def sizes_only(target: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Targets, and for each a blob of the nodes and sizes of its documents, without codes."""
    order = stable_order(target)
    target, node, n = target[order], node[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    none = np.zeros(len(node), np.int64)
    return target[at], blobs_of({"node": node, "n": n, "k": none, "h": none}, np.append(at, len(target)))


def unpacked(blobs: list[bytes], width: int = 8) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The heads of all blobs, the blob of each, and the codes."""
    sizes = [int.from_bytes(blob[:4], "little") for blob in blobs]
    head, skip = {}, 0
    for c, kind in _HEAD.items():
        head[c] = np.concatenate([np.frombuffer(blob, kind, m, 4 + skip * m) for blob, m in zip(blobs, sizes)])
        skip += np.dtype(kind).itemsize
    code = np.zeros((int(head["k"].sum()), 8), np.uint8)
    at = 0
    for blob, m in zip(blobs, sizes):
        low = np.frombuffer(blob, np.uint8, offset=4 + skip * m).reshape(-1, width)
        code[at : at + len(low), :width] = low
        at += len(low)
    return head, np.repeat(np.arange(len(blobs), dtype=np.int32), sizes), code.view("<u8").ravel()


def grouped(key: str, blob: str, each) -> object:
    """A function for mapInArrow over rows sorted by ``key``: what ``each(key, blobs)`` yields for every key that has blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            blobs = b.column(blob)
            for i, k in enumerate(b.column(key).to_pylist()):
                if k != now and held:
                    yield from each(now, held)
                    held = []
                now = k
                if (x := blobs[i].as_py()) is not None:
                    held.append(x)
        if held:
            yield from each(now, held)

    return run


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that hash partitioning puts there, so that each fragment gets a task of its own."""
    found: dict[int, int] = {}
    for r in spark.range(32 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect():
        found[r.p] = r.id
    return [found.get(p, 32 * n + p) for p in range(n)]


def fragmented(docs: DataFrame, hot, keys: list[int]) -> DataFrame:
    """(fragment, blob) of the documents' n-grams by range of the order, (fragment, hot_blob) of their sizes and hot lists, dealt
    over the fragments, and (fragment, rows) of the rows with their nodes. A fragment is not told the sizes."""

    n_fragments = len(keys)
    number = np.array(keys, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RunHasher()
        by_hash = np.sort(hot.value)
        rank = np.argsort(hot.value, kind="stable").astype(np.uint64) + np.uint64(1 << 62)  # after all codes of fragments, which are rarer
        seen: set[int] = set()
        nodes: list[int] = []
        grams: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            flat, n = np.concatenate(grams), np.array([len(g) for g in grams], np.int64)
            node, doc = np.array(nodes, np.int64), np.repeat(np.arange(len(grams)), n)
            is_hot = np.zeros(len(flat), bool)
            if len(by_hash):
                at = np.minimum(np.searchsorted(by_hash, flat), len(by_hash) - 1)
                is_hot = by_hash[at] == flat
            cold = ~is_hot
            fragment = ((flat[cold] >> np.uint64(32)) * np.uint64(n_fragments) >> np.uint64(32)).astype(np.int64)
            to, blobs = packed(fragment, doc[cold], flat[cold], node, np.zeros_like(n), width=6)
            bucket = np.mod(node, n_fragments)
            size_to, size_blobs = sizes_only(bucket, node, n)
            ranks, of = rank[at[is_hot]] if is_hot.any() else flat[:0], doc[is_hot]
            by_rank = np.lexsort((ranks, of))
            hot_to, hot_blobs = packed(bucket[of], of, ranks[by_rank], node, n, last=np.ones(len(of), bool))
            nodes.clear()
            grams.clear()
            more = [*size_blobs, *hot_blobs]
            kinds = (pa.array(number[np.concatenate([to, size_to, hot_to])]), pa.array([*blobs, *[None] * len(more)], pa.binary()), pa.array([*[None] * len(blobs), *more], pa.binary()))
            return pa.RecordBatch.from_arrays([*kinds, pa.nulls(len(blobs) + len(more), pa.binary())], ["fragment", "blob", "hot_blob", "rows"])

        for b in batches:
            of_rows, n_rows = np.zeros(b.num_rows, np.int64), np.full(b.num_rows, -1, np.int64)
            for i, t in enumerate(b.column("t").to_pylist()):
                found = words(t)
                if not found:
                    continue
                g = hasher.shingles(found)
                node = of_rows[i] = node_of(g)
                n_rows[i] = len(g)
                if node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                grams.append(g)
                size += len(g)
                if size >= CHUNK:
                    yield out()
                    size = 0
            if b.num_rows:
                doc_id = b.column("doc_id")
                sent = rows_blob(b.column("row").to_numpy(), doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(False), of_rows, n_rows)
                yield pa.RecordBatch.from_arrays([pa.array([keys[zlib.crc32(sent) % n_fragments]], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([sent], pa.binary())], ["fragment", "blob", "hot_blob", "rows"])
        if grams:
            yield out()

    return docs.select("row", "doc_id", "t").mapInArrow(run, "fragment long, blob binary, hot_blob binary, rows binary")


def rows_blob(row: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray, node: np.ndarray, n: np.ndarray) -> bytes:
    """Rows with their nodes and sizes; size -1 means no words."""
    return np.stack([row, doc_id, no_id, node, n]).astype("<i8").tobytes()


def rows_of(blob: bytes) -> pa.RecordBatch:
    row, doc_id, no_id, node, n = np.frombuffer(blob, "<i8").reshape(5, -1)
    m = len(row)
    lists = [pa.nulls(m, pa.list_(pa.int64()))] * 2
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(row), pa.array(doc_id, mask=no_id > 0), pa.array(node, mask=n < 0), pa.array(np.maximum(n, 0)), *lists], LINKABLE)


#: kind 0: a row with its node and size. kind 1: a document that others may be linked with, and its shared n-grams.
LINKABLE = ["kind", "row", "doc_id", "node", "n", "codes", "hot"]


def linked(overlap, a, b):
    """100 * intersection >= 75 * union, for sets of sizes a and b."""
    return 175 * overlap >= 75 * (a + b)


def shared_grams(number: int, blobs: list[bytes], buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Of a fragment's n-grams those that two documents or more have, packed for the buckets of the documents; hot ones last."""
    head, sent, gram = unpacked(blobs, 6)
    nodes, first, doc = numbered(head["node"])
    kept = np.repeat(sent == sent[first][doc], head["k"])  # of copies that several tasks sent, one
    gram, doc = gram[kept], np.repeat(doc, head["k"])[kept]
    n = head["n"][first]
    del head, sent, kept
    order = np.argsort(gram)
    gram, doc = gram[order], doc[order]
    del order
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(gram)))
    shared, hot = np.repeat(length > 1, length), np.repeat(length >= HOT, length)
    code = gram[shared] + (np.uint64(number + 1) << np.uint64(48))
    return packed(np.mod(nodes, buckets)[doc[shared]], doc[shared], code, nodes, n, last=hot[shared])


def shared_parts(pieces: DataFrame, keys: list[int]) -> DataFrame:
    """(bucket, blob): what each fragment knows of the documents of each bucket; as many buckets as fragments. (bucket, rows) pass."""
    number = {key: f for f, key in enumerate(keys)}
    named = np.array(keys, np.int64)

    def rows(to: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(named[to]), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.binary())], ["bucket", "blob", "rows"])

    def each(key: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        yield rows(*shared_grams(number[key], blobs, len(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: list[pa.RecordBatch] = []

        def passed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.column("blob").null_count:
                    use = b.filter(b.column("blob").is_null())
                    hot.append(pa.RecordBatch.from_arrays([use.column("fragment"), use.column("hot_blob"), use.column("rows")], ["bucket", "blob", "rows"]))
                yield b

        for out in grouped("fragment", "blob", each)(passed()):
            yield from hot
            hot.clear()
            yield out
        yield from hot

    return pieces.repartition(len(keys), "fragment").sortWithinPartitions("fragment").mapInArrow(run, "bucket long, blob binary, rows binary")


def linkable(parts: DataFrame, keys: list[int]) -> DataFrame:
    """``LINKABLE``: all rows; (node, n, codes, hot) of the documents of which others share 75 % or more: their shared n-grams
    below and from ``HOT``."""

    def each(_: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        head, _, code = unpacked(blobs)
        nodes, _, doc = numbered(head["node"])
        n = np.zeros(len(nodes), np.int64)
        np.maximum.at(n, doc, head["n"].astype(np.int64))  # fragments say 0
        start = np.cumsum(head["k"], dtype=np.int64)
        hot = np.arange(len(code)) >= np.repeat(start - head["h"], head["k"])
        doc = np.repeat(doc, head["k"])
        order = np.lexsort((code, hot, doc))
        code, hot, doc = code[order], hot[order], doc[order]
        own = np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.zeros(0, bool)  # copies send their hot lists again
        code, hot, doc = code[own], hot[own], doc[own]
        use = 4 * np.bincount(doc, minlength=len(nodes)) >= 3 * n
        code, hot, doc = code[use[doc]], hot[use[doc]], doc[use[doc]]
        m = int(use.sum())
        out = [pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(nodes[use]), pa.array(n[use])]
        for part in (~hot, hot):
            cut = np.concatenate([[0], np.cumsum(np.bincount(doc[part], minlength=len(nodes))[use])])
            out.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(code[part].view(np.int64))))
        yield pa.RecordBatch.from_arrays(out, LINKABLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: list[bytes] = []

        def passed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                sent.extend(b.column("rows").drop_null().to_pylist())
                yield b

        for out in grouped("bucket", "blob", each)(passed()):
            yield from map(rows_of, sent)
            sent.clear()
            yield out
        yield from map(rows_of, sent)

    rows = parts.repartition(len(keys), "bucket").sortWithinPartitions("bucket")
    return written(rows.mapInArrow(run, "kind int, row long, doc_id long, node long, n long, codes array<long>, hot array<long>"), "ngram-linkable")


def cut_again(docs: DataFrame, keys: list[int]) -> DataFrame:
    """(fragment, blob) of the shared n-grams below ``HOT``, with how many more n-grams each document shares elsewhere."""
    named = np.array(keys, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, hot = b.column("codes"), b.column("hot")
            code = codes.flatten().to_numpy().view(np.uint64)
            k = codes.value_lengths().to_numpy().astype(np.int64)
            whole = k + hot.value_lengths().to_numpy()
            low = (code & np.uint64((1 << 48) - 1)) >> np.uint64(16)
            to, blobs = packed((low * np.uint64(len(keys)) >> np.uint64(32)).astype(np.int64), np.repeat(np.arange(b.num_rows), k), code, b.column("node").to_numpy(), b.column("n").to_numpy(), whole=whole)
            yield pa.RecordBatch.from_arrays([pa.array(named[to]), pa.array(blobs, pa.binary())], ["fragment", "blob"])

    return docs.mapInArrow(run, "fragment long, blob binary")


def partial_counts(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, na, nb, shared) of the pairs of one fragment whose overlap may still suffice: what they share here and, at most,
    the fewer n-grams that one of them has elsewhere. Where there are more than ``PAIRS`` they are made in several passes."""
    head, _, gram = unpacked(blobs)
    nodes, n, rest = head["node"].copy(), head["n"].astype(np.int64), head["h"].astype(np.int64)
    m, doc = len(nodes), np.repeat(np.arange(len(nodes)), head["k"])
    order = np.argsort(gram)
    gram, doc = gram[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(gram)))
    passes = int(-(-(length * (length - 1) // 2).sum() // PAIRS))
    for p in range(passes):
        held = [np.zeros(0, np.int64)]
        for k in range(2, int(length.max()) + 1):
            at = start[length == k]
            i, j = np.triu_indices(k, 1)
            step = max(1, 500_000 // len(i))
            for lo in range(0, len(at), step):
                members = doc[at[lo : lo + step, None] + np.arange(k)]
                members.sort(1)
                x, y = members[:, i].ravel(), members[:, j].ravel()
                ok = (100 * np.minimum(n[x], n[y]) >= 75 * np.maximum(n[x], n[y])) & ((x % passes == p) if passes > 1 else True)
                held.append(x[ok] * m + y[ok])
        code, shared = np.unique(np.concatenate(held), return_counts=True)
        i, j = code // m, code % m
        may = linked(shared + np.minimum(rest[i], rest[j]), n[i], n[j])
        yield nodes[i[may]], nodes[j[may]], n[i[may]], n[j[may]], shared[may]


def counted(docs: DataFrame, keys: list[int]) -> DataFrame:
    """(a, b, na, nb, shared): partial counts of the pairs, one row a pair and fragment."""
    names = ["a", "b", "na", "nb", "shared"]

    def each(_: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        for part in partial_counts(blobs):
            a, b, na, nb, shared = part
            up = a <= b
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (np.where(up, a, b), np.where(up, b, a), np.where(up, na, nb), np.where(up, nb, na), shared)], names)

    rows = cut_again(docs, keys).repartition(len(keys), "fragment").sortWithinPartitions("fragment")
    return rows.mapInArrow(grouped("fragment", "blob", each), ", ".join(f"{c} long" for c in names))


def overlaps_with(flat: np.ndarray, offsets: np.ndarray, own: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """How many entries each list shares with ``own``; lists are slices of ``flat``, none empty."""
    mark[own] = 1
    got = np.add.reduceat(mark[flat], offsets[:-1])
    mark[own] = 0
    return got


def overlaps_between(left: pa.ListArray, right: pa.ListArray) -> Iterator[np.ndarray]:
    """For each list of ``left`` how many entries it shares with each of ``right``; none is empty. Near copies have few different
    entries, and slabs of a matrix product count them; where most entries are rare, list by list."""
    lengths = [x.value_lengths().to_numpy().astype(np.int64) for x in (left, right)]
    x, y = (x.flatten().to_numpy() for x in (left, right))
    width, both = len(seen := distinct(np.concatenate([x, y]))), (np.searchsorted(seen, x), np.searchsorted(seen, y))
    if width > 16 * max(256, len(y) // max(1, len(right))):
        offsets, mark = np.concatenate([[0], np.cumsum(lengths[1])]), np.zeros(width, np.int32)
        for own in np.split(both[0], np.cumsum(lengths[0])[:-1]):
            yield overlaps_with(both[1], offsets, own, mark)
        return
    row = [np.repeat(np.arange(len(n)), n) for n in lengths]
    total = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, width, SLAB):
        slabs = []
        for k, codes, n in zip(row, both, lengths):
            use = (codes >= lo) & (codes < lo + SLAB)
            slabs.append(np.zeros((len(n), min(SLAB, width - lo)), np.float32))
            slabs[-1][k[use], codes[use] - lo] = 1
        total += slabs[0] @ slabs[1].T
    yield from total.astype(np.int64)


def renumbered(lists: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The same lists over 0, 1, ... and how many numbers those take."""
    seen, flat = np.unique(np.concatenate(lists), return_inverse=True)
    return np.split(flat, np.cumsum([len(x) for x in lists])[:-1]), len(seen)


def block_components(nodes: np.ndarray, n: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """The least linked node of each node, exactly: each component grows by comparing its members with what is still outside."""
    label = np.zeros(len(nodes), np.int64)
    outside = np.argsort(nodes, kind="stable")
    lists, width = renumbered(lists)
    mark = np.zeros(width, np.int32)
    while len(outside):
        root, outside = outside[0], outside[1:]
        label[root] = nodes[root]
        grow = [root]
        while grow and len(outside):
            p = grow.pop()
            ok = np.flatnonzero(100 * np.minimum(n[outside], n[p]) >= 75 * np.maximum(n[outside], n[p]))
            if not len(ok):
                continue
            part = [lists[i] for i in outside[ok]]
            shared = overlaps_with(np.concatenate(part), np.concatenate([[0], np.cumsum([len(x) for x in part])]), lists[p], mark)
            new = ok[linked(shared, n[outside[ok]], n[p])]
            label[outside[new]] = nodes[root]
            grow += outside[new].tolist()
            outside = np.delete(outside, new)
    return label


def hot_classes(docs: DataFrame) -> DataFrame:
    """(node, n, codes, class) such that two linked documents without a fragment in common are of one class.

    By the prefix rule such documents share one of their first n - ceil(0.75 n) + 1 n-grams in any one order; in the order
    that puts the hot ones last, by code, these are hot ones. So classes are the components of the hot n-grams that stand in
    the prefix of one document, found like all components, by joins.
    """
    first = F.col("n") - F.ceil(0.75 * F.col("n")) + 1 - (F.col("n") - F.size("codes"))
    own = docs.withColumn("head", F.slice("codes", 1, F.greatest(F.lit(1), first).cast("int")))
    steps = own.select(F.explode(F.arrays_zip(F.slice("head", F.lit(1), F.size("head") - 1).alias("x"), F.slice("head", F.lit(2), F.size("head") - 1).alias("y"))).alias("e"), ).where("e.x is not null and e.y is not null").select(F.col("e.x").alias("a"), F.col("e.y").alias("b"))
    component = connected_components(steps.distinct()).select(F.col("node").alias("_c"), "component")
    return own.join(component, F.col("head")[0] == F.col("_c"), "left").select("node", "n", "codes", F.coalesce("component", F.col("head")[0]).alias("class"))


def hot_links(hot_docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the documents of mostly hot n-grams exactly as all their links would.

    Blocks of a class are solved exactly, then blocks of the representatives of what was found, which joins a large group of
    near copies in two rounds. Whatever is not in the largest component of its class by then is compared, block by block,
    with all of its class. So every link is either inside a known component or found.
    """
    docs = written(hot_classes(hot_docs), "ngram-hot-class")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [np.asarray(x, np.int64) for x in pdf["codes"]]
        nodes = pdf["node"].to_numpy(np.int64)
        return pd.DataFrame({"a": nodes, "b": block_components(nodes, pdf["n"].to_numpy(np.int64), lists), "class": pdf["class"]})

    now, edges, blocks = docs, [], 2
    for _ in range(3):
        sizes = now.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / block).alias("k"))
        dealt = now.join(F.broadcast(sizes), "class").withColumn("part", F.pmod(F.xxhash64("node", F.lit(len(edges))), F.col("k")))
        found = written(dealt.groupBy("class", "part").applyInPandas(solve, "a long, b long, class long"), "ngram-hot-edges")
        edges.append(found.where("a <> b").select("a", "b"))
        blocks = sizes.agg(F.max("k")).first()[0] or 0
        if blocks <= 1:
            break
        now = now.join(found.where("a = b").select(F.col("a").alias("node")), "node", "left_semi")
    together = edges[0]
    for e in edges[1:]:
        together = together.unionByName(e)
    if len(edges) == 1:
        return together  # every class was one block, solved exactly
    component = connected_components(together)
    labelled = written(docs.join(component, "node", "left").withColumn("component", F.coalesce("component", "node")), "ngram-hot-labels")
    size = labelled.groupBy("class", "component").agg(F.count(F.lit(1)).alias("size"))
    main = size.groupBy("class").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    rest = labelled.join(F.broadcast(main), "class").where("component <> main").drop("main")
    gather = F.collect_list(F.struct("node", "n", "codes", "component")).alias("docs")
    counts = labelled.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / block).alias("k"))
    all_blocks = labelled.join(F.broadcast(counts), "class").groupBy("class", F.pmod(F.xxhash64("node"), F.col("k")).alias("part")).agg(gather)
    few = rest.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / block).alias("k"))
    rest_blocks = rest.join(F.broadcast(few), "class").groupBy("class", F.pmod(F.xxhash64("node"), F.col("k")).alias("rest_part")).agg(F.collect_list(F.struct("node", "n", "codes", "component")).alias("rest"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for left, right in zip(b.column("rest"), b.column("docs")):
                (_, n, codes, comp), (_, other_n, other_codes, other_comp) = left.values.flatten(), right.values.flatten()
                comp, other_comp = comp.to_numpy(), other_comp.to_numpy()
                out = set()
                for d, shared in enumerate(overlaps_between(codes, other_codes)):
                    hit = linked(shared, other_n.to_numpy(), n[d].as_py()) & (other_comp != comp[d])
                    out |= {(int(comp[d]), int(c)) for c in np.unique(other_comp[hit])}
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])

    late = rest_blocks.join(all_blocks, "class").select("rest", "docs").mapInArrow(compare, "a long, b long").distinct()
    return together.unionByName(late)


def pair_links(partial: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs that their partial counts link, with the overlap of their hot lists where only that can decide."""
    pairs = written(partial.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("shared").alias("shared")), "ngram-pairs")
    sure = linked(F.col("shared"), F.col("na"), F.col("nb"))
    size = lists.select("node", F.size("codes").alias("h"))
    open_ = pairs.where(~sure).join(size.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(size.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    open_ = open_.where(linked(F.col("shared") + F.least("ha", "hb"), F.col("na"), F.col("nb"))).drop("ha", "hb")
    met = open_.join(lists.select(F.col("node").alias("a"), F.col("codes").alias("la")), "a").join(lists.select(F.col("node").alias("b"), F.col("codes").alias("lb")), "b")
    more = F.size(F.array_intersect("la", "lb"))
    return pairs.where(sure).select("a", "b").unionByName(met.where(linked(F.col("shared") + more, F.col("na"), F.col("nb"))).select("a", "b"))


def fragment_keys(spark: SparkSession, n_grams: int, least: int) -> list[int]:
    return partition_keys(spark, max(least, -(-n_grams // FRAGMENT)))


def jaccard_components(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and component (a name of its own, which
    neither null nor repeated doc_ids confuse; null without words) of every row.

    ``docs`` has doc_id and text; ``row`` names a column that is a unique id of each row. Without one, rows are numbered as they are read.
    """
    spark = docs.sparkSession
    raw = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    surveyed, share = surveyed_share(raw, docs.count(), SAMPLE)
    hot = hot_grams(surveyed)
    keys = fragment_keys(spark, int((surveyed.where("kind = 0").agg(F.sum("n")).first()[0] or 0) / share), partitions(spark))
    passed = linkable(shared_parts(fragmented(raw, spark.sparkContext.broadcast(hot), keys), keys), keys)
    kept = passed.where("kind = 1").select("node", "n", "codes", "hot")
    sizes = kept.agg(F.sum(F.size("codes")).alias("cold"), F.sum((4 * F.size("hot") >= 3 * F.col("n")).cast("long")).alias("mostly")).first()
    lists = kept.where(F.size("hot") > 0).select("node", "n", F.col("hot").alias("codes"))
    edges = pair_links(counted(kept, fragment_keys(spark, sizes.cold or 0, COUNTING)), lists)
    if sizes.mostly:
        edges = edges.unionByName(hot_links(written(lists.where(4 * F.size("codes") >= 3 * F.col("n")), "ngram-mostly-hot")))
    component = connected_components(edges)
    rows = passed.where("kind = 0").select("row", "doc_id", "node", F.col("n").alias("n_shingles"))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = written(nodes.join(component, "node", "left"), "ngram-named")
    together = named.where("component is not null")
    least = written(together.groupBy("component").agg(F.min("least").alias("component_id")), "ngram-least")
    alone = named.where("component is null").select("node", F.col("node").alias("component"), F.col("least").alias("component_id"))
    label = together.join(least, "component").select("node", "component", "component_id").unionByName(alone).withColumnRenamed("node", "_node")
    return rows.join(label, F.col("node") == F.col("_node"), "left").select("row", "doc_id", "n_shingles", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")
