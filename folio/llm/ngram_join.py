"""N-gram Jaccard join by vertical partitioning.

Each document is the set of its distinct ``K``-word shingles. All shingles have one global order: by the number of
documents that hold them, then by hash.

1. *Counts.* The shingle space is cut by hash. Tasks pack their documents' shingles and send each part to its group,
   which counts how many documents hold each shingle and answers with the shared ones. Shingles that the very same
   documents hold are one *element* with a weight, named by a hash of those documents. A shingle that is frequent
   within one task's chunk is not sent for each of its documents: the chunk flags it, all documents keep it as
   ``HOT``, last in the order, and the group sees one entry for each chunk.
2. *Documents.* Shared elements are gathered for each document in the global order, cut into fragments at the counts
   ``PIVOTS``. A partner must share ``SHARE`` of the set, so documents that share less are done. Equal sets are one
   representative from here on.
3. *Candidates.* Two sets that link have their first common element in the *head* of both: the elements from which on
   the weight still reaches the least overlap. In each element's list of heads, first the set with the least unshared
   weight is a hub, and only pairs with it are counted: copies of one text link with the one that is nearest to their
   common source. Then the pairs of a list that are still in different components are counted, if three bounds on
   their overlap allow a link: set sizes, the weight from the common element on, and the parity sketches, whose
   differing bits are at most as many as differing shingles. So a group of copies costs a few pairs for each
   member, and no pair that could join two components is left out.
4. *Overlaps.* A pair's partial overlap is counted in each fragment of the global order apart, and summed for each pair.

Every link that could join two components is counted exactly. A shingle is a 48-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cut, drop_held, free_name, quoted, release
from folio.llm.components import connected_components, contract, labels

K = 5
SHARE = (75, 100)  # the least similarity, as a fraction
BITS, IDX = 48, 12  # of a shingle's hash, and of a chunk's document number beside it
CHUNK_DOCS, CHUNK_WORDS = (1 << IDX) - 1, 600_000
FRAGMENT = 1_200_000  # shingles of one counting group, as planned
HOT_IN_CHUNK, GROUP_ENTRIES = 64, 2_000_000  # a chunk flags a shingle of so many documents, or fewer where chunks are so many that unflagged ones could fill a group
HOT = 2**16 - 1  # the count of flagged shingles; counts are kept in 16 bits
PIVOTS = (3, 8, 64)  # document counts at which the global order is cut into fragments
SKETCH = 512  # bits
LIST_BLOCK = 2000  # entries of a list that meet others in one task
PAIRS_FOR_ENTRY = 1000  # more pairs to bound than so many for each entry call for further hubs, as long as these halve them
WORDS = 400_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_keys(words: np.ndarray, lengths: np.ndarray, k: int = K) -> np.ndarray:
    """Sorted distinct (shingle << IDX | document) of documents whose word hashes stand one after another."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    parts = []
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, dtype="u8")
        for i in range(k):
            h += words[i : len(words) - k + 1 + i] * MIX[i % len(MIX)] + np.uint64(i // len(MIX))
            if k > len(MIX):
                h = _mix(h)
        doc = np.repeat(np.arange(len(lengths), dtype="u8"), lengths)[: len(h)]
        whole = np.arange(len(h)) + k <= np.repeat(ends, lengths)[: len(h)]
        parts.append((_mix(h)[whole] >> np.uint64(64 - BITS) << np.uint64(IDX)) | doc[whole])
    few = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(few):
        own = np.array([xxhash.xxh3_64_intdigest(words[starts[d] : ends[d]].tobytes(), seed=int(lengths[d])) for d in few], dtype="u8")
        parts.append((own >> np.uint64(64 - BITS) << np.uint64(IDX)) | few.astype("u8"))
    keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype="u8")
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal neighbours."""
    if not len(sorted_values):
        return np.zeros(0, dtype="i8"), np.zeros(0, dtype="i8")
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return starts, np.diff(starts, append=len(sorted_values))


def _packed(sorted_keys: np.ndarray) -> bytes:
    """Differences of neighbours in as few bytes as the largest needs, low bytes first, which compresses well."""
    if not len(sorted_keys):
        return b""
    steps = np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + steps.view("u1").reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype="u8")
    planes = np.frombuffer(raw, dtype="u1", offset=1).reshape(raw[0], -1)
    steps = np.zeros((planes.shape[1], 8), dtype="u1")
    steps[:, : raw[0]] = planes.T
    return np.cumsum(steps.view("<u8")[:, 0], dtype="u8")


PACKED = "grp int, keys binary, docs binary, extra binary"
ANSWER = "grp int, docs binary, own binary, keys binary, df binary, weights binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """Chunks of documents: their ids, their words' hashes one after another, and how many words each has."""
    drop_held()
    get = _WordHashes().__getitem__
    ids, words, lengths = [], [], []
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for doc, raw in zip(part.column("doc").to_pylist(), part.column("raw").to_pylist(), strict=True):
                own = raw.lower().split() if raw else []
                ids.append(doc)
                words.extend(map(get, own))
                lengths.append(len(own))
                if len(ids) >= CHUNK_DOCS or len(words) >= CHUNK_WORDS:
                    yield ids, words, lengths
                    ids, words, lengths = [], [], []
    if ids:
        yield ids, words, lengths


def _keys_of(words: list[int], lengths: list[int], k: int) -> np.ndarray:
    return shingle_keys(np.array(words, dtype="u8"), np.array(lengths, dtype="i8"), k)


def _pack(docs: DataFrame, groups: int, k: int, hot_in_chunk: int) -> DataFrame:
    """Chunks of documents as one row for each counting group (extra: its flagged shingles) and one of the documents' set sizes (extra) and hot shingles."""
    step = np.uint64((1 << (BITS + IDX)) // groups + 1)

    def chunk(ids: list[int], words: list[int], lengths: list[int]) -> pa.RecordBatch:
        keys = _keys_of(words, lengths, k)
        doc = np.array(ids, dtype="i8")
        sizes = np.bincount((keys & np.uint64(CHUNK_DOCS)).astype("i8"), minlength=len(ids)).astype("i8")
        starts, counts = _runs(keys >> np.uint64(IDX))
        hot_run = counts >= hot_in_chunk
        hot = np.repeat(hot_run, counts) if len(counts) else np.zeros(0, dtype=bool)
        flagged, sent = keys[starts[hot_run]] if len(counts) else keys, keys[~hot]
        bounds = np.arange(groups, dtype="u8") * step
        at = np.append(np.searchsorted(sent, bounds), len(sent))
        at_hot = np.append(np.searchsorted(flagged, bounds), len(flagged))
        rows = []
        for g in range(groups):
            part = sent[at[g] : at[g + 1]]
            if len(part) or at_hot[g] < at_hot[g + 1]:
                used, own = np.unique((part & np.uint64(CHUNK_DOCS)).astype("i8"), return_inverse=True)
                part = (part >> np.uint64(IDX) << np.uint64(IDX)) | own.astype("u8")
                rows.append((g, _packed(part), doc[used].tobytes(), (flagged[at_hot[g] : at_hot[g + 1]] >> np.uint64(IDX)).tobytes()))
        rows.append((groups + int(xxhash.xxh3_64_intdigest(doc.tobytes())) % groups, _packed(keys[hot]), doc.tobytes(), sizes.tobytes()))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["grp", "keys", "docs", "extra"])

    return docs.mapInArrow(lambda batches: (chunk(*c) for c in _chunks(batches)), PACKED)


def _buckets(doc: np.ndarray, key: np.ndarray, df: np.ndarray, weight: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of ANSWER that deal documents out by a hash of their ids; ``own`` points into ``docs``."""
    b = (_mix(doc.astype("u8")) % np.uint64(buckets)).astype("i4")
    order = np.argsort(b, kind="stable")
    doc, key, df, weight, b = doc[order], key[order], df[order], weight[order], b[order]
    starts, counts = _runs(b)
    for s, n in zip(starts.tolist(), counts.tolist(), strict=True):
        used, own = np.unique(doc[s : s + n], return_inverse=True)
        yield int(b[s]), used.tobytes(), own.astype("u4").tobytes(), key[s : s + n].tobytes(), df[s : s + n].astype("u2").tobytes(), weight[s : s + n].astype("u4").tobytes()


def _elements(doc: np.ndarray, key: np.ndarray, flagged: np.ndarray, repeats: bool) -> tuple[np.ndarray, ...]:
    """(document, element, count, weight) of the shared ones among (document, shingle)."""
    order = np.lexsort((doc, key)) if repeats else np.argsort(key, kind="stable")
    doc, key = doc[order], key[order]
    if repeats and len(key):
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        doc, key = doc[new], key[new]
    starts, counts = _runs(key)
    if not len(key):
        return doc, key, counts, counts
    holders = np.add.reduceat(_mix(doc.astype("u8") * MIX[0] + MIX[1]), starts)
    name = _mix(holders + counts.astype("u8") * MIX[2]) >> np.uint64(64 - BITS)
    count = np.minimum(counts, HOT - 1)
    if len(flagged):
        hot = np.isin(key[starts], flagged)
        name, count = np.where(hot, key[starts], name), np.where(hot, HOT, count)
    name, count = np.repeat(name, counts), np.repeat(count, counts)
    shared = count >= 2
    doc, name, count = doc[shared], name[shared], count[shared]
    order = np.lexsort((name, doc))
    doc, name, count = doc[order], name[order], count[order]
    if not len(doc):
        return doc, name, count, count
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (name[1:] != name[:-1]))))
    return doc[first], name[first], count[first], np.diff(first, append=len(doc))


def _answer(packed: DataFrame, groups: int, buckets: int, repeats: bool) -> DataFrame:
    """For each shared element and document that holds it, (document, element, count, weight), packed by bucket of documents.

    Set sizes come with the count 0, in place of an element.
    """

    def run(table: pa.Table) -> pa.Table:
        drop_held()
        grp = table.column("grp")[0].as_py()
        docs = [np.frombuffer(x, dtype="i8") for x in table.column("docs").to_pylist()]
        keys = [_unpacked(x) for x in table.column("keys").to_pylist()]
        extra = table.column("extra").to_pylist()
        doc = np.concatenate([d[(k & np.uint64(CHUNK_DOCS)).astype("i8")] for d, k in zip(docs, keys, strict=True)])
        key = np.concatenate(keys) >> np.uint64(IDX)
        if grp >= groups:
            every, sizes = np.concatenate(docs), np.concatenate([np.frombuffer(x, dtype="i8") for x in extra])
            one = np.ones(len(doc) + len(every), dtype="i8")
            found = np.concatenate([doc, every]), np.concatenate([key, sizes.astype("u8")]), np.concatenate([np.full(len(key), HOT), np.zeros(len(every), dtype="i8")]), one
        else:
            found = _elements(doc, key, np.unique(np.concatenate([np.frombuffer(x, dtype="u8") for x in extra])), repeats)
        rows = list(_buckets(*found, buckets)) or [(0, *[b""] * 5)]
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["grp", "docs", "own", "keys", "df", "weights"])

    return packed.groupBy("grp").applyInArrow(run, ANSWER)


UNION = np.uint64(1 << 62)  # marks the size of the union of an id's rows


def _union_sizes(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """Rows of ANSWER with the set sizes of documents of several rows."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, lengths in _chunks(batches):
            keys = _keys_of(words, lengths, k)
            own = np.array(ids, dtype="i8")[(keys & np.uint64(CHUNK_DOCS)).astype("i8")]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array((keys >> np.uint64(IDX)).astype("i8"))], names=["doc", "key"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, size = batch.column("doc").to_numpy(), batch.column("n").to_numpy().astype("u8")
            columns = list(zip(*_buckets(doc, size | UNION, np.zeros(len(doc)), np.ones(len(doc)), buckets), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["grp", "docs", "own", "keys", "df", "weights"])

    return docs.mapInArrow(shingles, "doc long, key long").distinct().groupBy("doc").agg(F.count("*").alias("n")).mapInArrow(rows, ANSWER)


NODE = "doc long, n_shingles long, copies long, digest binary, c long, heads array<long>, suffix array<long>, sketch array<long>, segments array<array<long>>"


def _sketches(name: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """``SKETCH`` parities for each of ``n`` sets: an element of weight w flips w bits of its own."""
    out = np.zeros((n, SKETCH // 64), dtype="i8")
    for lo in range(0, n, 1000):
        a, b = np.searchsorted(owner, [lo, lo + 1000])
        w = weight[a:b]
        nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        bit = _mix(np.repeat(name[a:b], w) * MIX[0] + nth.astype("u8") * MIX[1]) % np.uint64(SKETCH)
        m = min(1000, n - lo)
        flips = np.bincount(np.repeat(owner[a:b] - lo, w) * SKETCH + bit.astype("i8"), minlength=m * SKETCH)
        out[lo : lo + m] = np.packbits((flips & 1).astype("u1").reshape(m, SKETCH), axis=1).view("<i8")
    return out


def _gather(answers: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Rows of NODE. Documents that share enough have their shared weight c, the elements in the head, the
    weight from each of these on, a sketch, and the fragments of their elements, each as name << 16 | weight; of others these are empty."""
    need, of = share

    def run(table: pa.Table) -> pa.Table:
        drop_held()
        cat = lambda c, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(c).to_pylist()])
        tables = zip(table.column("docs").to_pylist(), table.column("own").to_pylist(), strict=True)
        doc = np.concatenate([np.frombuffer(d, dtype="i8")[np.frombuffer(o, dtype="u4")] for d, o in tables])
        key, df, weight = cat("keys", "u8"), cat("df", "u2").astype("i8"), cat("weights", "u4").astype("i8")
        size_row = df == 0
        of_doc, sizes = doc[size_row], key[size_row]
        order = np.lexsort((sizes, of_doc))
        of_doc, sizes = of_doc[order], sizes[order]
        starts, rows = _runs(of_doc)
        ids = of_doc[starts]
        last = sizes[starts + rows - 1] if len(starts) else sizes
        copies = rows - (last >= UNION)
        n = (last & (UNION - np.uint64(1))).astype("i8")
        doc, key, df, weight = doc[~size_row], key[~size_row], df[~size_row], weight[~size_row]
        order = np.lexsort((key, df, doc))
        doc, key, df, weight = doc[order], key[order], df[order], weight[order]
        if len(doc):
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (df[1:] != df[:-1]))))
            weight = np.where(df[first] == HOT, 1, np.add.reduceat(weight, first))
            doc, key, df = doc[first], key[first], df[first]
        owner = np.searchsorted(ids, doc)
        total = np.bincount(owner, weights=weight, minlength=len(ids)).astype("i8")
        lives = (total * of >= n * need) & (n > 0)
        kept = lives[owner]
        owner, key, df, weight = owner[kept], key[kept], df[kept], weight[kept]
        c = np.where(lives, total, 0)
        before = np.cumsum(weight) - weight
        suffix = c[owner] - before + (np.cumsum(c) - c)[owner]
        in_head = suffix * of >= n[owner] * need
        in_heads = np.bincount(owner[in_head], minlength=len(ids))
        # sets of equal shared elements and size are equal: what is not shared is in no other set
        lo, hi = np.searchsorted(owner, np.arange(len(ids)), "left"), np.searchsorted(owner, np.arange(len(ids)), "right")
        named = (key << np.uint64(16)) | np.minimum(weight, 0xFFFF).astype("u8")
        marks = [xxhash.xxh3_128_digest(named[a:b].tobytes()) if ok else None for a, b, ok in zip(lo.tolist(), hi.tolist(), (lives & (c == n)).tolist(), strict=True)]
        fragment = np.searchsorted(PIVOTS, df, "right")
        heavy = weight > 0xFFFF  # the rest of a weight that 16 bits can't hold is elements of names of their own
        if heavy.any():
            more = weight[heavy] // 0xFFFF
            nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            rest = np.minimum(np.repeat(weight[heavy], more) - (nth + 1) * 0xFFFF, 0xFFFF)
            name = _mix(np.repeat(key[heavy], more) + (nth.astype("u8") + np.uint64(1)) * MIX[3]) >> np.uint64(64 - BITS)
            extra = (name << np.uint64(16)) | rest.astype("u8")
            own_all, frag_all, val_all = np.append(owner, np.repeat(owner[heavy], more)), np.append(fragment, np.repeat(fragment[heavy], more)), np.append(named, extra[: len(name)])
            order = np.lexsort((frag_all, own_all))
            own_all, frag_all, val_all = own_all[order], frag_all[order], val_all[order]
        else:
            own_all, frag_all, val_all = owner, fragment, named
        pieces = len(PIVOTS) + 1
        offsets = lambda counts: pa.array(np.append(0, np.cumsum(counts)).astype("i4"))
        inner = pa.ListArray.from_arrays(offsets(np.bincount(own_all * pieces + frag_all, minlength=len(ids) * pieces)), pa.array(val_all.view("i8")))
        segments = pa.ListArray.from_arrays(offsets(np.full(len(ids), pieces)), inner)
        alive = np.flatnonzero(lives)
        place = np.cumsum(lives) - 1
        sketch = pa.ListArray.from_arrays(offsets(np.where(lives, SKETCH // 64, 0)), pa.array(_sketches(key, weight, place[owner], len(alive)).ravel()))
        heads = pa.ListArray.from_arrays(offsets(in_heads), pa.array(key[in_head].astype("i8")))
        suffixes = pa.ListArray.from_arrays(offsets(in_heads), pa.array(suffix[in_head]))
        return pa.table(
            [pa.array(ids), pa.array(n), pa.array(copies.astype("i8")), pa.array(marks, pa.binary()), pa.array(c), heads, suffixes, sketch, segments],
            names=["doc", "n_shingles", "copies", "digest", "c", "heads", "suffix", "sketch", "segments"],
        )

    return answers.groupBy("grp").applyInArrow(run, NODE)


def _links(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) that reach the similarity: partial overlaps are counted in each fragment of the order and summed for each pair."""
    need, of = share
    cells = sets.select("doc", "n_shingles", F.posexplode("segments").alias("f", "s")).where(F.size("s") > 0)
    side = lambda name: cells.select(F.col("doc").alias(name), F.col("n_shingles").alias(f"n_{name}"), "f", F.col("s").alias(f"s_{name}"))
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), ["b", "f"])
    partial = F.aggregate(F.array_intersect("s_a", "s_b"), F.lit(0).cast("long"), lambda sum_, x: sum_ + x.bitwiseAND(F.lit(0xFFFF)))
    counted = met.groupBy("a", "b", "n_a", "n_b").agg(F.sum(partial).alias("common"))
    return counted.where(of * F.col("common") >= need * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _may_link(share: tuple[int, int], x: str, y: str) -> Column:
    """Whether the sizes of two sets, and the weights from their first common element on, allow a link."""
    need, of = share
    of_x, of_y = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (of * F.least(of_x, of_y) >= need * F.greatest(of_x, of_y)) & ((need + of) * F.least(f"{x}.suffix", f"{y}.suffix") >= need * (of_x + of_y))


def _sketches_near(share: tuple[int, int], x: str, y: str) -> Column:
    """Whether the sketches allow a link: shared weights less the differing bits are twice the overlap at least."""
    need, of = share
    bits = sum((F.bit_count(F.get(f"{x}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    return (need + of) * (F.col(f"{x}.c") + F.col(f"{y}.c") - bits) >= 2 * need * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _components_of(entries: DataFrame, found: DataFrame | None) -> DataFrame:
    """``entries`` with the component that links have given each document so far."""
    if found is None:
        return entries.withColumn("comp", F.col("doc"))
    known = labels(found).select(F.col("node").alias("doc"), "component")
    return entries.join(known, "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")


def _hub_pairs(entries: DataFrame, share: tuple[int, int], turn: int) -> DataFrame:
    """Pairs (a, b) of each list's hub with the others outside its component."""
    first = F.col("unshared") if turn == 0 else F.lit(0)
    lists = entries.groupBy("key").agg(F.min(F.struct(first.alias("u"), F.xxhash64("doc", F.lit(turn)).alias("h"), "doc", "n", "suffix", "comp")).alias("y"), F.count("*").alias("size")).where("size > 1")
    met = entries.select("key", F.struct("doc", "n", "suffix", "comp").alias("x")).join(lists.select("key", "y"), "key")
    return met.where((F.col("x.comp") != F.col("y.comp")) & _may_link(share, "x", "y")).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()


def _open_lists(entries: DataFrame) -> DataFrame:
    """key, pairs (of different components), size of each list that could still join components."""
    by_comp = entries.groupBy("key", "comp").agg(F.count("*").alias("m"))
    lists = by_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("m").alias("size"), F.sum(F.col("m") * F.col("m")).alias("squares"))
    return lists.where("comps > 1").select("key", ((F.col("size") * F.col("size") - F.col("squares")) / 2).alias("pairs"), "size")


def _rest_pairs(entries: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different components in one list that the bounds let link.

    A list is cut into cells of like sizes and like shares of weight from the common element on, and large cells by hashes of
    ids into blocks of about ``LIST_BLOCK`` entries. Cells meet only if their extremes allow a link, and each pair of blocks
    is a key of its own, so no task pairs more than two blocks, and a list whose members can't link makes no rows.
    """
    need, of = share
    at = [F.floor(F.log2("n") * 4).cast("int").alias("nb"), F.floor(F.col("suffix") * 50 / F.col("n")).cast("int").alias("sb")]
    whole = cut(entries.join(sets.select("doc", "c", "sketch"), "doc").select("key", *at, F.struct("doc", "n", "suffix", "comp", "c", "sketch").alias("x")))
    cells = whole.groupBy("key", "nb", "sb").agg(F.min("x.n").alias("least"), F.max("x.n").alias("most"), F.max("x.suffix").alias("suffix"), F.ceil(F.count("*") / LIST_BLOCK).alias("s"))
    one, two = (cells.select("key", *(F.col(c).alias(f"{side}_{c}") for c in cells.columns if c != "key")) for side in "ab")
    order = F.struct("a_nb", "a_sb") <= F.struct("b_nb", "b_sb")
    sizes = (of * F.col("a_most") >= need * F.col("b_least")) & (of * F.col("b_most") >= need * F.col("a_least"))
    weights = (need + of) * F.least("a_suffix", "b_suffix") >= need * (F.col("a_least") + F.col("b_least"))
    same = (F.col("a_nb") == F.col("b_nb")) & (F.col("a_sb") == F.col("b_sb"))
    meet = one.join(two, "key").where(order & sizes & weights).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("a_s"))))
    meet = meet.withColumn("j", F.explode(F.sequence(F.when(same, F.col("i")).otherwise(1), F.col("b_s"))))
    meet = cut(meet.select("key", "a_nb", "a_sb", "a_s", "i", "b_nb", "b_sb", "b_s", "j"))

    def side(name: str, at: str, as_: str) -> DataFrame:
        blocks = meet.select("*", F.col(f"{name}_nb").alias("nb"), F.col(f"{name}_sb").alias("sb"), F.col(at).alias("own"))
        salts = cells.select("key", "nb", "sb", "s")
        salted = whole.join(salts, ["key", "nb", "sb"]).withColumn("own", F.pmod(F.xxhash64("x.doc"), "s") + 1)
        return salted.join(blocks, ["key", "nb", "sb", "own"]).select("key", "a_nb", "a_sb", "i", "b_nb", "b_sb", "j", F.col("x").alias(as_))

    met = side("a", "i", "x").join(side("b", "j", "y"), ["key", "a_nb", "a_sb", "i", "b_nb", "b_sb", "j"])
    alone = same & (F.col("i") == F.col("j"))
    may = (~alone | (F.col("x.doc") < F.col("y.doc"))) & (F.col("x.comp") != F.col("y.comp")) & _may_link(share, "x", "y") & _sketches_near(share, "x", "y")
    return met.where(may).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()


def _resolve(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """node, component for every representative that links with another: hubs, then the rest, as the module says."""
    unshared = F.floor(1000 * (F.col("n_shingles") - F.col("c")) / F.col("n_shingles")).cast("int")
    entries = cut(sets.select("doc", F.col("n_shingles").alias("n"), unshared.alias("unshared"), F.explode(F.arrays_zip("heads", "suffix")).alias("e")).select("doc", "n", "unshared", F.col("e.heads").alias("key"), "e.suffix"))
    found, turn, last = None, 0, float("inf")
    while True:
        links = _links(cut(_hub_pairs(_components_of(entries, found), share, turn)), sets, share)
        found, turn = contract(links if found is None else found.union(links)), turn + 1
        now = cut(_components_of(entries, found))
        lists = cut(_open_lists(now))
        entries = now.join(lists.select("key"), "key", "left_semi").drop("comp")
        cost, size = lists.agg(F.sum("pairs"), F.sum("size")).first()
        if cost is None:
            return connected_components(found)
        if cost <= PAIRS_FOR_ENTRY * size or cost > last / 2:
            break
        entries, last = cut(entries), cost
    rest = cut(_rest_pairs(now.join(lists.select("key"), "key", "left_semi"), sets, share))
    return connected_components(found.union(_links(rest, sets, share)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, share: tuple[int, int] = SHARE) -> DataFrame:
    """One row for each document: id, n_shingles, component_id (the least id reachable by links), copies (its rows).

    Words are split at space, tab, line feed, vertical tab, form feed and carriage return; A-Z are lower-cased. Fewer
    words than ``k`` make one shingle; documents without words, or with a null text, have none and link with nothing.
    Rows that repeat an id are one document, whose set is the union of its rows' sets; rows with a null id are left
    out. Ids are integers. Other columns are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("raw"))
    size = given.agg(F.sum(F.octet_length("raw")).alias("b")).first().b or 0
    groups = max(4, -(-size // (6 * FRAGMENT)))
    hot = max(2, min(HOT_IN_CHUNK, GROUP_ENTRIES * CHUNK_WORDS * 6 // max(size, 1)))
    repeated = cut(given.groupBy("doc").agg(F.count("*").alias("m")).where("m > 1").select("doc"))
    repeats = repeated.limit(1).count() > 0
    answers = _answer(_pack(given, groups, k, hot), groups, groups, repeats)
    if repeats:
        answers = answers.unionByName(_union_sizes(given.join(repeated, "doc", "left_semi"), k, groups))
    nodes = cut(_gather(answers, share))
    release(spark)
    alive = nodes.where("size(heads) > 0")
    equal = alive.where("digest is not null").groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("m")).where("m > 1").select("digest", "rep")
    member = cut(alive.where("digest is not null").select("doc", "digest").join(equal, "digest").select("doc", "rep"))
    copies = member.where("doc <> rep").select("doc")
    sets = cut(alive.drop("copies", "digest").join(copies, "doc", "left_anti"))
    comps = _resolve(sets, share)
    via = member.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc", F.coalesce("component", "rep").alias("component"))
    placed = comps.join(member.select(F.col("doc").alias("node")), "node", "left_anti").select(F.col("node").alias("doc"), "component").union(via)
    return nodes.select("doc", "n_shingles", "copies").join(placed, "doc", "left").select(F.col("doc").alias(id_col), "n_shingles", F.coalesce("component", "doc").alias("component_id"), "copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that with the least id, and of rows that repeat it the least by its
    columns that can be ordered. Rows with a null id stay. No column name can clash."""
    own, repeated = (free_name(docs, x) for x in ("doc", "repeated"))
    found = near_duplicates(docs, id_col, text_col).where(F.col(id_col) == F.col("component_id"))
    marks = cut(found.select(F.col(id_col).alias(own), (F.col("copies") > 1).alias(repeated)))
    of = lambda rows: docs.join(rows.select(own), F.col(id_col).cast("long") == F.col(own), "left_semi")
    kept = of(marks.where(f"not {repeated}")).unionByName(docs.where(F.col(id_col).isNull()))
    several = marks.where(repeated)
    if not several.limit(1).count():
        return kept
    ordered = [f.name for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    one = of(several).groupBy(F.col(id_col).alias(own)).agg(F.min_by(F.struct(*quoted(docs.columns)), F.struct(*quoted(ordered))).alias("r"))
    return kept.unionByName(one.select(*(F.col("r")[c].alias(c) for c in docs.columns)))
