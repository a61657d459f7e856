"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Items and documents are lower-cased (A-Z) and cut into words of letters, digits and characters from U+0080.
The automaton of a block of items goes to every worker; a document's words are streamed through it while the
state keeps the longest match that ends at each word. Where that length reaches ``window``, the last ``window``
words are hit. Items shorter than the window count as one window of their own length: their states are marked,
and a match hits them whenever it passes through a marked state by suffix links.

Only blocks of at most ``BLOCK_WORDS`` item words are sent to the workers, where one automaton is built for each
process. A benchmark of more words is cut into several blocks, which come to the driver one after the other, each for
a pass over the documents; an item too long for a block is cut into pieces that overlap by a window less one word.
The passes' spans are written, merged for each text and joined back to the rows. So what the driver or a worker holds
is bounded whatever the benchmark's size, and the result is the same however many blocks there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import ALNUM, cut, free_name, held, quoted, text_bytes
from folio.llm.suffix_automaton import SuffixAutomaton

WINDOW = 10
BLOCK_WORDS = 500_000
SPAN = "array<struct<start:int,end:int>>"


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = b"" if text is None else text if isinstance(text, bytes) else text.encode()
    return raw.translate(ALNUM).split()


class ItemMatcher:
    """Finds the windows of a block of items in sequences of words."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int) -> None:
        self.window = window
        self.sam = sam = SuffixAutomaton([w for _, w in items])
        size = len(sam.next)
        owners: list[set[int]] = [set() for _ in range(size)]
        short: list[dict[int, set[int]]] = [{} for _ in range(size)]  # at a state: length of a short item to its ids
        marked = set()
        for k, (item, words) in enumerate(items):
            if 0 < len(words) < window:
                v = sam.find(words)
                short[v].setdefault(len(words), set()).add(item)
                marked.add(v)
            for v in sam.ends[k]:
                while v > 0 and sam.length[v] >= window and item not in owners[v]:
                    owners[v].add(item)
                    v = sam.link[v]
        self.owners, self.cut = owners, sam.at_length(window)
        # nearest state with short items on each chain of suffix links, itself included
        self.marked, self.short = [-1] * size, short
        for v in sorted(range(1, size), key=sam.length.__getitem__):
            self.marked[v] = v if v in marked else self.marked[sam.link[v]]
        self.shortest = min((n for d in short for n in d), default=window)
        self.least = min(self.shortest, window)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of hit words and the items with occurring windows."""
        sam, window, least = self.sam, self.window, self.least
        nxt, link, length, marked = sam.next, sam.link, sam.length, self.marked
        root = nxt[0]
        v = n = 0
        out, spans, items, seen = root, [], set(), set()
        for i, w in enumerate(words):
            to = out.get(w)
            if to is None:
                while v and to is None:
                    v = link[v]
                    to = nxt[v].get(w)
                if to is None:
                    v = n = 0
                    out = root
                    continue
                n = length[v]
            v, n = to, n + 1
            out = nxt[v]
            if n < least:
                continue
            hit = 0
            if n >= window:
                hit = window
                at = self.cut[v]
                if at not in seen:
                    seen.add(at)
                    items |= self.owners[at]
            m = marked[v]
            while m >= 0:
                for size, ids in self.short[m].items():
                    if size <= n:
                        hit = max(hit, size)
                        items |= ids
                m = marked[link[m]] if link[m] > 0 else -1
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((start, i + 1))
        return spans, items


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, window: int) -> Iterator[list[tuple]]:
    """The items in order of their ids, in blocks of bounded size, one block at a time; items without words are left out."""
    block, size, most = [], 0, max(block_words, window)
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").orderBy("id", "text")
    for row in rows.toLocalIterator():
        words = words_of(row.text)
        for at in range(0, max(1, len(words) - window + 1), most - window + 1) if len(words) > most else [0]:
            part = words[at : at + most] if len(words) > most else words
            if block and size + len(part) > block_words:
                yield block
                block, size = [], 0
            if part:
                block.append((row.id, part))
                size += len(part)
    yield block


def _matcher(key: str, items: list[tuple], window: int) -> ItemMatcher:
    """The automaton of one block, built once for each worker process; only the last one is kept."""
    return held((ItemMatcher, key), lambda: ItemMatcher(items, window))


def _scan(docs: DataFrame, items: list[tuple], window: int, kind: T.DataType, item_kind: T.DataType) -> DataFrame:
    given, key = docs.sparkSession.sparkContext.broadcast(items), uuid4().hex
    item_type = pa.string() if isinstance(item_kind, T.StringType) else pa.int64()
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, given.value, window)
        for batch in batches:
            for ids, texts in text_bytes([batch], "id", "raw"):
                n, spans, found = [], [], []
                for raw in texts:
                    words = raw.translate(ALNUM).split()
                    s, items = matcher.match(words)
                    n.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    found.append(sorted(items))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(spans, span_type), pa.array(found, pa.list_(item_type))], names=["id", "n_words", "spans", "items"])

    out = f"id {kind.simpleString()}, n_words long, spans {SPAN}, items array<{'string' if item_type == pa.string() else 'long'}>"
    return docs.mapInArrow(run, out)


def _first_block(blocks: Iterator[list[tuple]]) -> tuple[list[tuple], Iterator[list[tuple]] | None]:
    """The first block, and, if there are more, an iterator over all of them."""
    first = next(blocks)
    second = next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, spans of hit words (from 0, end exclusive, merged) and the sorted item ids.

    Null or empty texts have no words and no hits. Items with null ids or without words are left out; repeated
    items count once by id. Null and repeated ids keep their rows. Other columns are not read, so their names can't clash.
    """
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    first, more = _first_block(item_blocks(benchmark, item_col, item_text, block_words, window))
    if more is None:
        return _scan(given, first, window, kind, item_kind).withColumnRenamed("id", id_col)
    found = _scan_blocks(given, more, window, item_kind).withColumnRenamed("sha", "found_sha")
    met = given.withColumn("sha", F.sha2(F.coalesce("raw", F.lit(b"")), 256)).join(found, F.col("sha") == F.col("found_sha"))
    return met.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def _scan_blocks(given: DataFrame, blocks: Iterator[list[tuple]], window: int, item_kind: T.DataType) -> DataFrame:
    """sha, n_words, and the spans and items of all blocks, of each distinct text (raw, null being empty) of ``given``."""
    texts = given.select(F.coalesce("raw", F.lit(b"")).alias("raw")).select(F.sha2("raw", 256).alias("id"), "raw")
    both = None
    for b in blocks:
        part = cut(_scan(texts, b, window, T.StringType(), item_kind).groupBy("id").agg(F.any_value("n_words").alias("n_words"), F.any_value("spans").alias("spans"), F.any_value("items").alias("items")))
        both = part if both is None else both.unionByName(part)
    found = both.groupBy("id").agg(F.any_value("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr(
        "aggregate(s, cast(array() as array<struct<start:int,end:int>>), (a, x) -> CASE WHEN size(a) > 0 AND element_at(a, -1).end >= x.start"
        " THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))) ELSE concat(a, array(x)) END)"
    )
    return found.select(F.col("id").alias("sha"), "n_words", merged.alias("spans"), "items")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The figures of ``contamination``: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    texts = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(texts, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without benchmark text: hit spans are cut out of the texts, and documents go whose hit share exceeds ``max_coverage``.

    A cut reaches from the first character of a span's first word to the last one of its last word; all other
    characters stay as they are. Every other column is kept, ``n_chars`` (if there) is counted anew. Null texts, null
    and repeated ids stay.
    Spans are found in the given texts and counted and cut once, however many blocks of ``block_words`` words the
    benchmark has; several blocks cost a scan each and a join of their spans with the texts.
    """
    first, more = _first_block(item_blocks(benchmark, item_col, item_text, block_words, window))
    if more is None:
        return _remove(docs, docs.columns, max_coverage, text_col=text_col, items=first, window=window)
    sha, held, spans = (free_name(docs, x) for x in ("sha", "held", "spans"))
    given = docs.select(F.col(text_col).cast("binary").alias("raw"))
    found = _scan_blocks(given, more, window, benchmark.schema[item_col].dataType).where(F.size("spans") > 0).select(F.col("sha").alias(held), F.col("spans").alias(spans))
    keyed = docs.withColumn(sha, F.sha2(F.col(text_col).cast("binary"), 256))
    met = keyed.join(found, F.col(sha) == F.col(held), "left").select(*quoted(docs.columns), spans)
    return _remove(met, docs.columns, max_coverage, text_col=text_col)


def _remove(docs: DataFrame, names: list[str], max_coverage: float, text_col: str, items: list[tuple] | None = None, window: int = WINDOW) -> DataFrame:
    """The columns ``names`` of ``docs``, cut by the spans in its last column or, with ``items``, by those found here."""
    given, key = None if items is None else docs.sparkSession.sparkContext.broadcast(items), uuid4().hex
    at = names.index(text_col)
    chars = names.index("n_chars") if "n_chars" in names else -1
    spaces = np.frombuffer(ALNUM, dtype="u1") == 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None if given is None else _matcher(key, given.value, window)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                keep, texts = [], []
                known = [None] * batch.num_rows if matcher else batch.column(len(names)).to_pylist()
                for text, spans in zip(batch.column(at).to_pylist(), known, strict=True):
                    raw = b"" if text is None else text
                    words = raw.translate(ALNUM).split()
                    spans = matcher.match(words)[0] if matcher else [(s["start"], s["end"]) for s in spans or []]
                    keep.append(not spans or sum(b - a for a, b in spans) <= max_coverage * len(words))
                    if spans and keep[-1]:
                        gap = spaces[np.frombuffer(raw, dtype="u1")]
                        edge = np.diff(gap.astype("i1"), prepend=1, append=1)
                        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
                        parts, last = [], 0
                        for a, b in spans:
                            parts.append(raw[last : starts[a]])
                            last = ends[b - 1]
                        text = b"".join(parts) + raw[last:]
                    texts.append(text)
                columns, schema = batch.columns[: len(names)], pa.schema([batch.schema.field(i) for i in range(len(names))])
                columns[at] = pa.array(texts, schema.field(at).type)
                if chars >= 0:
                    columns[chars] = pa.array([c if t is None else len(t.decode(errors="replace")) for t, c in zip(texts, columns[chars].to_pylist(), strict=True)], schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(keep, pa.bool_()))

    # texts go as bytes, so that those that are no UTF-8 pass, too
    raw_text = docs.withColumn(text_col, F.col(text_col).cast("binary"))
    done = raw_text.mapInArrow(run, raw_text.select(*quoted(names)).schema)
    return done.withColumn(text_col, F.col(text_col).cast(docs.schema[text_col].dataType))


def items_digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
