"""Operator 7: token counts of a byte-level BPE vocabulary without making any token.

A piece of text is a linked list of its byte symbols. A heap holds the ranks of adjacent pairs; the pair of
lowest rank, the leftmost of equals, is merged again and again. The count is the number of initial symbols
minus the number of merges. Counts of pieces are remembered in a bounded table, as most pieces are frequent.

Defined results: a null or empty text has 0 tokens; a special token's string inside a text is one token, as
the library does by default. Repeated rows each give a row, other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import _text

LIMIT = 512
REMEMBERED = 200_000
LONG_TEXT = 1 << 20
#: How byte-level vocabularies cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load(path: str) -> dict:
    """Pair ranks and special strings of a tokenizer file of the `tokenizers` library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("only plain byte-level BPE files are supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("special tokens that take their surroundings are not supported")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"ranks": {p: k for k, p in enumerate(pairs)}, "special": [t["content"] for t in spec["added_tokens"]]}


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges."""
    n = len(symbols)
    part, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(ranks[p], k) for k, p in enumerate(pairwise(part)) if p in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, k = heapq.heappop(heap)
        j = after[k]
        if part[k] == "" or j < 0 or ranks.get((part[k], part[j])) != rank:
            continue  # one of the two has been merged meanwhile
        part[k] += part[j]
        part[j] = ""
        merges += 1
        after[k] = nxt = after[j]
        if nxt >= 0:
            before[nxt] = k
            if (r := ranks.get((part[k], part[nxt]))) is not None:
                heapq.heappush(heap, (r, k))
        if (prev := before[k]) >= 0 and (r := ranks.get((part[prev], part[k]))) is not None:
            heapq.heappush(heap, (r, prev))
    return n - merges


class Counter(dict):
    """Token counts of pieces, made when first asked for; at most REMEMBERED of them are kept."""

    def __init__(self, vocabulary: dict):
        import regex

        super().__init__()
        self.ranks, self.symbols = vocabulary["ranks"], byte_symbols()
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary["special"], key=len, reverse=True)))) if vocabulary["special"] else None
        self.pieces = regex.compile(PIECES)

    def __missing__(self, piece: str) -> int:
        n = merged_count([self.symbols[b] for b in piece.encode()], self.ranks)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) < 64:
            self[piece] = n
        return n

    def plain(self, text: str) -> int:
        if len(text) > LONG_TEXT:
            return sum(self[m.group()] for m in self.pieces.finditer(text))
        return sum(map(self.__getitem__, self.pieces.findall(text)))

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_counters: dict[int, Counter] = {}


def token_count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text); path: of the vocabulary file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = load(path)
    stamp = hash((path, len(vocabulary["ranks"])))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        if stamp not in _counters:
            _counters[stamp] = Counter(vocabulary)
        texts = batch.column("text")
        _, at = _text.raw(texts)
        n = [_counters[stamp].count(t) for t in texts.to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(at[1:] - at[:-1]), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return _text.map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
