"""Token counts of whole texts for a byte-level BPE vocabulary, without building the ids.

Method: rank-synchronous array merging.  The distinct pre-tokens of a batch are
ragged numpy arrays of byte symbols.  In each round every pre-token applies all
occurrences of its lowest-rank pair at once; rounds go on while any pair is left,
and the surviving symbols are counted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from screenspark.llm.batches import map_batches, slices

#: Fixed value: the pattern by which byte-level pre-tokens are cut, as published with the vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space next to a space, or at the edge: there, cutting at single spaces would not be exact.
SPACE = r"\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RUN = rf"  |[{SPACE}] | [{SPACE}]|\A | \z"
CACHE_CHUNKS = 800_000
#: Symbols merged at once.
MERGE_SYMBOLS = 2_000_000

_COUNTERS: dict[str, "TokenCounter"] = {}


def public_path(name: str) -> str:
    """Path of a vocabulary file of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def counter(name: str) -> "TokenCounter":
    if name not in _COUNTERS:
        _COUNTERS[name] = TokenCounter(name)
    return _COUNTERS[name]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class TokenCounter:
    """Counts tokens with the merges of a tokenizers ``.json`` file (byte-level BPE, its own pattern)."""

    def __init__(self, name: str):
        import regex

        with open(name if "/" in name else public_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre.get("use_regex") or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{name} is not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.symbols = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.width = max(vocab.values()) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        # A pair may be merged everywhere at once unless its product starts a merge of a lower rank.
        last = {}
        for r, (a, b) in enumerate(merges):
            last[a + b] = r
        late = {t for r, m in enumerate(merges) for t in m if r < last.get(t, -1)}
        self.leftmost = np.array([a + b in late for a, b in merges])
        self.pattern = regex.compile(PATTERN)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.added_re2 = "|".join(re.escape(t) for t in added)
        self.cache: dict[str, int] = {}

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Number of symbols of each pre-token after all merges."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        counts = n.copy()
        sym = self.symbols[np.frombuffer(b"".join(words), np.uint8)]
        row = np.repeat(np.arange(len(words)), n)
        top = len(self.ranks)
        while len(sym) > 1:
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (row[:-1] == row[1:]), self.ranks[at], top)
            rank = np.append(rank, top)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            low = np.minimum.reduceat(rank, first)
            spans = np.diff(np.append(first, len(sym)))
            alive = low < top
            counts[row[first[~alive]]] = spans[~alive]
            if not alive.any():
                break
            if not alive.all():  # finished pre-tokens leave
                keep = np.repeat(alive, spans)
                sym, row, rank, low, spans = sym[keep], row[keep], rank[keep], low[alive], spans[alive]
                first = np.cumsum(spans) - spans
            hit = rank == np.repeat(low, spans)
            if self.leftmost[low].any():
                at = np.flatnonzero(hit)
                lone = np.append(True, row[at][1:] != row[at][:-1]) | ~self.leftmost[rank[at]]
                hit[at[~lone]] = False
            # In a run of hits the same pair overlaps itself: every second one counts, from the left.
            at = np.flatnonzero(hit)
            begins = np.append(True, (np.diff(at) != 1) | (row[at][1:] != row[at][:-1]))
            start = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, row = sym[keep], row[keep]
        else:
            counts[row] = 1
        return counts

    def _learn(self, chunks: list[str]) -> None:
        """Put the counts of chunks into the cache."""
        pieces = [self.pattern.findall(c) for c in chunks]
        distinct = sorted({p for x in pieces for p in x})
        known: dict[str, int] = {}
        part, size = [], 0
        for i, p in enumerate(distinct):
            part.append(p)
            size += len(p)
            if size >= MERGE_SYMBOLS or i == len(distinct) - 1:
                known.update(zip(part, self.merge([x.encode() for x in part]).tolist(), strict=True))
                part, size = [], 0
        self.cache.update((c, sum(map(known.__getitem__, x))) for c, x in zip(chunks, pieces, strict=True))

    def _lookup(self, chunks: list[str]) -> np.ndarray:
        """Counts of distinct chunks, from the cache where it has them."""
        new = [c for c in chunks if c not in self.cache]
        if self.cache and len(self.cache) + len(new) > CACHE_CHUNKS:
            self.cache.clear()
            new = chunks
        self._learn(new)
        return np.fromiter(map(self.cache.__getitem__, chunks), np.int64, len(chunks))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text (null: empty); added tokens inside texts count one each.

        Texts are cut before single spaces, which no pre-token spans, so that
        each distinct chunk of a batch is counted once.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        out = np.zeros(len(texts), np.int64)
        odd = pc.match_substring_regex(texts, RUN).to_numpy(zero_copy_only=False)
        if self.added is not None:
            odd = odd | pc.match_substring_regex(texts, self.added_re2).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd):
            text = texts[int(i)].as_py()
            parts = self.added.split(text) if self.added is not None else [text]
            out[i] = len(parts) - 1
            pieces = pa.array([p for part in parts for p in self.pattern.findall(part)], pa.large_string()).dictionary_encode()
            out[i] += self._lookup(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()].sum() if len(pieces) else 0
        plain = np.flatnonzero(~odd)
        if len(plain):
            chunks = pc.split_pattern(texts.take(pa.array(plain)), " ")
            n = pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = chunks.flatten()
            words = flat.dictionary_encode()
            codes = words.indices.to_numpy(zero_copy_only=False)
            each = self._lookup([" " + w for w in words.dictionary.to_pylist()])[codes]
            first = np.cumsum(n) - n
            heads = flat.take(pa.array(first)).dictionary_encode()
            each[first] = self._lookup(heads.dictionary.to_pylist())[heads.indices.to_numpy()]
            out[plain] = np.add.reduceat(each, first)
        return out


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``, no shuffle.

    A null or empty text has no bytes and no tokens.  Repeated rows and null ids
    give a row each.  Texts of any length are counted whole.  Other columns of
    ``docs`` are not read.
    """
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        count = counter(vocabulary).count
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = count(part.column("text"))
                yield {"doc_id": part.column("doc_id"), "n_bytes": pc.binary_length(part.column("text")).fill_null(0), "n_tokens": tokens, "over_limit": tokens > limit}

    return map_batches(docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")), run, schema)
