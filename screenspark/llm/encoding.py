"""Token ids of whole texts by the tokenizers library, with a cache of the chunks between spaces.

For a tokenizer that drops white space, the ids of a text are the ids of its
pre-tokens, one after the other, so each distinct one is encoded once and texts
are put together from the cache.  Texts of plain Latin letters, which are in normal
form, are cut into pre-tokens by Arrow; any other text is cut between
spaces, tabs and line feeds, which no normalisation or special string crosses, and
the library encodes these chunks.  Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from screenspark.llm.token_counts import byte_letters, public_path

#: When the cache would hold more than this, what the texts at hand do not need is dropped.
CACHE_KEYS = 400_000
#: Letters and marks below U+0180 that no normalisation changes; other texts, and those with "<|", are odd.
ODD = r"[^\t\n -~\x{a1}-\x{12f}\x{131}-\x{17f}]|<\|"
#: Put before a chunk in the cache, to tell it from a pre-token.
CHUNK = "\x00"

_ENCODERS: dict[str, "TextEncoder"] = {}


def encoder(name: str) -> "TextEncoder":
    """The encoder for a vocabulary file, one for each Python worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = TextEncoder(name)
    return _ENCODERS[name]


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions of all runs of n places from starts, one after the other."""
    stop = np.cumsum(n)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(starts - (stop - n), n)


class TextEncoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = name if "/" in name else public_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_chunk = norm == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["use_regex"]
        if self.by_chunk:
            self.cut = f"({pre[0]['pattern']['Regex']})"
            self.letters = dict(enumerate(byte_letters()))
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, keys: list[str]) -> None:
        """Add the ids of new pre-tokens and chunks to the cache."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for at in range(0, len(keys), 8192):
            part = keys[at : at + 8192]
            if part[0].startswith(CHUNK) or part[-1].startswith(CHUNK):
                rest = [k for k in part if k.startswith(CHUNK)]
                chunks = dict(zip(rest, (e.ids for e in self.tokenizer.encode_batch_fast([k[1:] for k in rest], add_special_tokens=False)), strict=True))
            else:
                chunks = {}
            encoded = [chunks[k] if k in chunks else [t.id for t in tokenize(k if k.isascii() else k.encode().decode("latin-1").translate(letters))] for k in part]
            n = np.fromiter(map(len, encoded), np.int64, len(part))
            self._store(part, np.fromiter(chain.from_iterable(encoded), np.uint32, int(n.sum())), n)

    def _store(self, keys: list[str], flat: np.ndarray, n: np.ndarray) -> None:
        first, k = len(self.index), len(keys)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + k > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[first : first + k] = self.used + np.cumsum(n) - n
        self.lengths[first : first + k] = n
        self.used += len(flat)
        self.index.update(zip(keys, range(first, first + k), strict=True))

    def _places(self, keys: list[str]) -> np.ndarray:
        """Cache places of distinct keys."""
        new = [k for k in keys if k not in self.index]
        if self.index and len(self.index) + len(new) > CACHE_KEYS:
            kept = [k for k in keys if k in self.index]
            at = np.fromiter(map(self.index.__getitem__, kept), np.int64, len(kept))
            n = self.lengths[at]
            flat = self.ids[_ranges(self.starts[at], n)]
            self._clear()
            self._store(kept, flat, n)
        self._learn(new)
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def _joined(self, texts: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, and where each text's ids stop."""
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " "), " ")
        chunks = lists.flatten().dictionary_encode()
        if plain:  # distinct chunks are put together from their pre-tokens
            cut = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(chunks.dictionary, self.cut, "\\1 "), " "), " ")
            keys = cut.flatten().dictionary_encode()
            at = self._places(keys.dictionary.to_pylist())[keys.indices.to_numpy(zero_copy_only=False)]
            n = self.lengths[at]
            ids = self.ids[_ranges(self.starts[at], n)]
            last = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64))
            stop = np.append(0, np.cumsum(n))[last]
            start = np.append(0, stop[:-1])[: len(stop)]
        else:
            at = self._places([CHUNK + c for c in chunks.dictionary.to_pylist()])
            ids, start, stop = self.ids, self.starts[at], self.starts[at] + self.lengths[at]
        codes = chunks.indices.to_numpy(zero_copy_only=False)
        n = (stop - start)[codes]
        per_text = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        return ids[_ranges(start[codes], n)], np.append(0, np.cumsum(n))[per_text]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a string array, and where each text's ids stop.

        A null text is empty.  With ``end``, that id follows the ids of each text.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_chunk:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            stops = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
            flat = np.fromiter((i for ids in lists for i in ids), np.uint32, int(stops[-1]) if len(stops) else 0)
            return self._ended(flat, stops, end)
        odd = pc.match_substring_regex(texts, ODD)
        plain = texts.filter(pc.invert(odd))
        flat, stops = self._joined(pc.utf8_lower(plain), True)
        if len(plain) < len(texts):
            flat2, stops2 = self._joined(texts.filter(odd), False)
            is_odd = odd.to_numpy(zero_copy_only=False)
            n = np.zeros(len(texts), np.int64)
            start = np.zeros(len(texts), np.int64)
            n[~is_odd], n[is_odd] = np.diff(np.append(0, stops)), np.diff(np.append(0, stops2))
            start[~is_odd], start[is_odd] = np.append(0, stops[:-1])[: len(stops)], len(flat) + np.append(0, stops2[:-1])
            flat, stops = np.concatenate([flat, flat2])[_ranges(start, n)], np.cumsum(n)
        return self._ended(flat, stops, end)

    @staticmethod
    def _ended(flat: np.ndarray, stops: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if end is None:
            return flat, stops
        out = np.empty(len(flat) + len(stops), np.uint32)
        ends = stops + np.arange(len(stops))
        rest = np.ones(len(out), bool)
        rest[ends] = False
        out[ends], out[rest] = end, flat
        return out, ends + 1
