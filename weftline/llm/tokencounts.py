"""Token counts by linear longest-match: a trie of the vocabulary with failure links and precomputed counts of popped tokens.

The automaton reads each byte of a word once. Where the trie cannot go on, the failure link leads to the node of what is
left after popping greedy tokens, and the count of these is stored with the link, so no token is ever built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import null_safe_text, short_batches, slices

_automata: dict = {}


class LongestMatch:
    """Counts the pieces of greedy longest-match segmentation over a vocabulary of byte strings.

    ``vocabulary`` begins words with ``head``, if given. A word of which some part matches no token is one unknown token.
    """

    def __init__(self, vocabulary: set[bytes], head: bytes = b"") -> None:
        self.head = head
        self.next: list[dict[int, int]] = [{}]
        token = [False]
        for t in vocabulary:
            v = 0
            for c in t:
                u = self.next[v].get(c)
                if u is None:
                    u = self.next[v][c] = len(self.next)
                    self.next.append({})
                    token.append(False)
                v = u
            token[v] = v != 0
        # by depth: a token's node pops itself; another's link goes on from its parent's, popping until its byte fits; -1: cannot go on
        self.link, self.pops = [-1] * len(self.next), [0] * len(self.next)
        level = [(0, c, u) for c, u in self.next[0].items()]
        while level:
            after = []
            for parent, c, v in level:
                if token[v]:
                    self.link[v], self.pops[v] = 0, 1
                else:
                    z, n = self.link[parent], self.pops[parent]
                    while z >= 0 and c not in self.next[z]:
                        n += self.pops[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.pops[v] = self.next[z][c], n
                after += [(v, d, u) for d, u in self.next[v].items()]
            level = after

    def count(self, word: bytes) -> int:
        """How many pieces greedy longest-match gives for a word; 0 for none, 1 where it cannot be cut."""
        v = n = 0
        nxt, link, pops = self.next, self.link, self.pops
        for c in self.head + word:
            while (u := nxt[v].get(c)) is None:
                if link[v] < 0:
                    return 1
                n += pops[v]
                v = link[v]
            v = u
        while v:
            if link[v] < 0:
                return 1
            n += pops[v]
            v = link[v]
        return n


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others for U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def automaton(path: str | None) -> tuple[LongestMatch, dict[str, int]]:
    """The automaton of a tokenizer file's byte-level vocabulary, and the counts of words that are kept; made once in a process."""
    if path not in _automata:
        import public_tokenizers

        with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        _automata[path] = (LongestMatch({bytes(alphabet[c] for c in t) for t in vocabulary if all(c in alphabet for c in t)}, b" "), {})
    return _automata[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_words (between white space) and n_tokens, the greedy longest-match pieces of all words, each with a leading space.

    The vocabulary is that of a byte-level tokenizer file (None: byte_bpe_50k.json of public_tokenizers), which holds every
    byte, so no word is unknown. Counts of up to 400,000 distinct words are kept in a process, then forgotten together.

    Nulls: a null text is empty, and an empty text has no words and no tokens; a null doc_id is kept. Long texts are
    counted whole. Repeated rows come back as often; ties cannot matter. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(vocabulary)
        for part in slices(batches, 1, 1 << 21):
            words = [t.split() for t in part.column(1).to_pylist()]
            new = set().union(*words).difference(known)
            if len(known) + len(new) > 400_000:
                known.clear()
                new = set().union(*words)
            count = machine.count
            known.update((w, count(w.encode())) for w in new)
            get = known.__getitem__
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(map(len, words), pa.int64()), pa.array((sum(map(get, w)) for w in words), pa.int64())], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), null_safe_text(text).alias("text"))
    return rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document's counts."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
