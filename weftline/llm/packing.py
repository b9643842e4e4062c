"""Packing of tokenised documents into sequences of equal capacity.

Documents are cut into pieces; full windows become sequences of their own, and the other pieces of a block are dealt
to windows by Karmarkar-Karp multiway differencing. Nothing is shuffled: a block is a bounded run of the pieces of one
input partition, so the cost is linear and a task's memory is bounded by a block and the longest text.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import null_safe_text, short_batches, slices

PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_tokenizers: dict = {}


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Deals items to k windows with near-equal sums: the k-way largest differencing method.

    Every item begins as a partial partition of k windows of which one is filled. The two partial partitions of the
    largest spread are merged again and again, the fullest window of one with the emptiest of the other. Ties go to the
    partition made first. Returns the items' indices by window; empty windows come out as empty lists.
    """
    heap = [(-s, i, [0] * (k - 1) + [s], [()] * (k - 1) + [(i,)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, wa = heapq.heappop(heap)
        _, _, b, wb = heapq.heappop(heap)
        both = sorted(((x + y, (u, v) if u and v else u or v) for x, y, u, v in zip(a, reversed(b), wa, reversed(wb), strict=True)), key=lambda t: t[0])
        low = both[0][0]
        n += 1
        heapq.heappush(heap, (low - both[-1][0], n, [x - low for x, _ in both], [w for _, w in both]))
    out = []
    for tree in heap[0][3] if heap else [()] * k:
        items, stack = [], [tree] if tree else []
        while stack:
            t = stack.pop()
            stack.extend(t) if isinstance(t[0], tuple) else items.append(t[0])
        out.append(sorted(items))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest near-equal windows, from the total's lower bound on, of which none exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while k:
        found = karmarkar_karp(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        k += 1
    return []


#: Characters of a text that are encoded at once; it bounds what the ids take as objects, not the length of a text.
STRETCH = 1 << 20
_break = re.compile(r"(?<=\S) (?=\S)")


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """A text in stretches of at least ``most`` characters, but for the last, each of which begins with a single space between two others: there a pre-token begins, whatever stands around."""
    at = 0
    while len(text) - at > most and (cut := _break.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encoder(path: str | None):
    """A function from a text to its ids as little-endian unsigned 32-bit integers.

    For the default vocabulary its ranks file is used, which encodes several times as fast as the tokenizer's and gives
    the same ids; texts that hold a special token's string, and other vocabularies, go to the tokenizer.
    """
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        ranked = None
        if path is None:
            import tiktoken

            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        _tokenizers[path] = tokenizer, ranked, [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    tokenizer, ranked, special = _tokenizers[path]

    def encode(text: str) -> bytes:
        if ranked is None or any(s in text for s in special):
            return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(np.asarray(ranked(t), "<u4").tobytes() for t in stretches(text))

    return encode


def pack_documents(docs: DataFrame, capacity: int = 2048, piece: int = 512, block: int = 64, slack: int = 16, end_id: int = 1, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    A document's ids are those of the tokenizer file ``tokenizer`` (None: byte_bpe_50k.json of public_tokenizers), then
    ``end_id``. Whole windows of ``capacity`` ids are sequences of their own; what remains of a document is cut into
    pieces of at most ``piece`` ids, and each ``block`` windows' worth of pieces, less ``slack`` ids a window so that near-equal
    windows can fit, is dealt by ``windows``. Returns one row
    per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit integers).

    Nulls: a null text is empty and has the end id alone; a null doc_id is kept. Very long texts become many full
    windows. Repeated rows are packed once each. Ties in Karmarkar-Karp go to the piece read first. An empty table gives
    no rows. Other columns are ignored. sequence_id holds the partition's number in its upper bits, so a task that is
    run again gives the same ids.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = encoder(tokenizer), TaskContext.get().partitionId() << 33
        rest, held, room = [], 0, block * (capacity - slack)
        names = [f.split()[0] for f in PACKED.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        end = np.asarray([end_id], "<u4").tobytes()

        def deal(last: bool) -> list[tuple]:
            nonlocal rest, held, at
            rows = []
            while held >= room or last and rest:
                n = took = 0
                while n < len(rest) and took + rest[n][2] <= room:
                    took, n = took + rest[n][2], n + 1
                own, rest, held = rest[:n], rest[n:], held - took
                for w in windows([p[2] for p in own], capacity):
                    off = 0
                    for i in w:
                        d, start, length, total, ids = own[i]
                        rows.append((d, start, length, total, at, off, ids))
                        off += length
                    at += bool(w)
            return rows

        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for part in slices(batches, 1, 1 << 20):
            rows = []
            for d, ids in zip(part.column(0).to_pylist(), map(encode, part.column(1).to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                full = total // capacity * capacity
                for lo in range(0, full, capacity):
                    rows.append((d, lo, capacity, total, at, 0, ids[4 * lo : 4 * (lo + capacity)]))
                    at += 1
                for lo in range(full, total, piece):
                    rest.append((d, lo, min(piece, total - lo), total, ids[4 * lo : 4 * min(lo + piece, total)]))
                held += total - full
            yield as_batch(rows + deal(False))
        if rest:
            yield as_batch(deal(True))

    short_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), null_safe_text(text).alias("text")).mapInArrow(packed, PACKED)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their checksums."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
