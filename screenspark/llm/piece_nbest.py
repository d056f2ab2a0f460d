"""SentencePiece N-best segmentation, encoding and decoding over the piece lattice of a vocabulary.

Method: forward Viterbi scores of the lattice are exact heuristics for an A-star
search that goes backward from its end, so the first N complete paths that it pops
are the N best.  A text is cut before each run of word marks, which no piece
spans after other characters, and between characters that no piece has next to each
other; the lattices of these parts are independent, so the N best of a text follow
from those of its parts.  The forward pass keeps the two best scores of each node, so
it gives the best path of each distinct part and what the second loses; it runs over
the nodes and junctions of all new parts side by side in numpy.  Only the N words of a
text that lose least can have other paths among its N best, so only these are
searched backward.

The vocabulary is one of merges: its scores are ranks of merges, and summed alone
they favour fragments.  So the nodes of the lattice are pieces at their places, and a
junction of two pieces that the merges would not leave side by side costs BREAK,
which is more than any sum of scores.  Exactly one path has no such junction, the
library's encoding, which is thus the best; the others follow by their numbers of
broken junctions, then by the scores of their pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from screenspark.llm.batches import map_batches, slices
from screenspark.llm.token_counts import public_path

MARK = "▁"
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHE_UNITS = 300_000
#: Score of a character without a piece, below that of any piece; its bytes are the tokens.
UNKNOWN_MARGIN = 10.0

#: Fixed value: scores at or below this mark pieces that are merged after all others, such as runs of spaces.
UNUSED = -1e8
CACHE_PARTS = 300_000
CACHE_JUNCTIONS = 2_000_000
CACHE_ALL = 100_000
#: Parts whose best paths are found side by side.
SIDE = 20_000
#: Cost of a junction that the merges would not leave.
BREAK = 1e12
#: Cells of the lattices searched side by side, and the most characters of such a part.
CELLS = 4_000_000
LONGEST_ROW = 64
HASH = 0x9E3779B97F4A7C15
NO_RANK = 1 << 40

_MODELS: dict[str, "PieceLattice"] = {}


def lattice(name: str, n: int = 4) -> "PieceLattice":
    if (name, n) not in _MODELS:
        _MODELS[name, n] = PieceLattice(name, n)
    return _MODELS[name, n]


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions of all runs of n places from starts, one after the other."""
    stop = np.cumsum(n)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(starts - (stop - n), n)


class Paths:
    """The N best paths of each of a growing number of strings: ids, and what each loses against the best (inf: none)."""

    def __init__(self, n: int):
        self.n, self.flat, self._used, self.rows = n, np.zeros(1 << 16, np.int32), 0, 0
        self.start, self.length = np.zeros((1 << 12, n), np.int64), np.zeros((1 << 12, n), np.int64)
        self.score, self.loss = np.zeros(1 << 12), np.zeros((1 << 12, n))

    def add(self, flat: np.ndarray, length: np.ndarray, score: np.ndarray, loss: np.ndarray) -> None:
        """Rows of n paths each: all ids, path after path, and their lengths (0 where there is no path)."""
        while self._used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        a, b = self.rows, self.rows + len(score)
        while b > len(self.score):
            self.start, self.length, self.score, self.loss = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.score, self.loss))
        self.flat[self._used : self._used + len(flat)] = flat
        each = length.ravel()
        self.start[a:b], self.length[a:b] = (self._used + np.cumsum(each) - each).reshape(length.shape), length
        self.score[a:b], self.loss[a:b] = score, loss
        self._used, self.rows = self._used + len(flat), b

    def ids(self, row: int, place: int) -> np.ndarray:
        at = self.start[row, place]
        return self.flat[at : at + self.length[row, place]]


def least_sums(losses: list[list[float]], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n least sums of one loss from each list (the first is 0), with the places that differ from the first: (list, choice).

    Only the n lists with the least second losses matter.
    """
    if len(losses) > n:
        some = heapq.nsmallest(n, range(len(losses)), key=lambda i: (losses[i][1], i))
    else:
        some = range(len(losses))
    sums: list[tuple[float, tuple]] = [(0.0, ())]
    for i in sorted(some):
        row = losses[i]
        if row[1] < np.inf:
            sums = heapq.nsmallest(n, [(s + x, how + ((i, k),) if k else how) for s, how in sums for k, x in enumerate(row) if x < np.inf])
    return sums


class PieceLattice:
    def __init__(self, name: str, n: int = 4):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=name if "/" in name else public_path(name))
        self.model, self.n = model, n
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        raw = {model.id_to_piece(i): model.get_score(i) for i in plain}
        scored = [s for s in raw.values() if s > UNUSED]
        self.low = min(scored) - UNKNOWN_MARGIN
        # As parts of a path, pieces that are merged after all others count as the last of all.
        self.pieces = {model.id_to_piece(i): (raw[model.id_to_piece(i)] if raw[model.id_to_piece(i)] > UNUSED else min(scored) - 1, i) for i in plain}
        self.bytes = {b: model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.piece_of = {i: p for p, (_, i) in self.pieces.items()}
        self.longest = max(map(len, self.pieces))
        self.adjacent = np.unique(np.array([(ord(p[i]) << 21) | ord(p[i + 1]) for p in self.pieces for i in range(len(p) - 1)], np.uint64))
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")
        values = list(self.pieces.values())
        self.hash_scores, self.hash_ids = np.array([v[0] for v in values], np.float64)[order], np.array([v[1] for v in values], np.int64)[order]
        names = list(self.pieces)
        self._learn_merges(raw, [names[i] for i in order])
        self._learn_prefixes(names)
        self._clear()
        self._clear_parts()
        self._clear_all()

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * HASH + ord(c) + 1) & (2**64 - 1)
        return h

    def _learn_merges(self, raw: dict[str, float], names: list[str]) -> None:
        """Rank, halves and length of each piece, in the order of the hashes; a piece that its own merges do not make is broken.

        The last merge of a piece is of two shorter pieces that stay apart until its
        own rank, so the halves are found by rising length.
        """
        count = len(names)
        score = np.array([raw[p] for p in names])
        self.size = np.array([len(p) for p in names], np.int64)
        self.power = np.array([pow(HASH, k, 2**64) for k in range(self.longest + 1)], np.uint64)
        merged = self.size > 1
        levels = np.unique(-score[merged])
        self.rank = np.where(merged, np.searchsorted(levels, -score), -1)
        self.depth_rank, self.whole = np.full(count, -1, np.int64), ~merged
        self.left, self.right = np.full(count, -1, np.int64), np.full(count, -1, np.int64)
        for length in range(2, self.longest + 1):
            rows = np.flatnonzero(self.size == length)
            codes = np.frombuffer("".join(names[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), length).astype(np.uint64) + np.uint64(1)
            heads, tails = np.zeros((length + 1, len(rows)), np.uint64), np.zeros((length + 1, len(rows)), np.uint64)
            for k in range(length):
                heads[k + 1] = heads[k] * np.uint64(HASH) + codes[:, k]
                tails[k + 1] = tails[k] + codes[:, length - 1 - k] * self.power[k]
            for k in range(1, length):
                (l, has_l), (r, has_r) = self._found(heads[k]), self._found(tails[length - k])
                some = np.flatnonzero(has_l & has_r & self.whole[l] & self.whole[r] & ~self.whole[rows])
                some = some[self.kept_apart(l[some], r[some], self.rank[rows[some]])]
                i = rows[some]
                self.whole[i], self.depth_rank[i], self.left[i], self.right[i] = True, self.rank[i], l[some], r[some]

    def _learn_prefixes(self, names: list[str]) -> None:
        """Hashes of all beginnings of pieces, and the place of the piece that each is (-1: none)."""
        found: set[int] = set()
        for p in names:
            h = 0
            for c in p:
                h = (h * HASH + ord(c) + 1) & (2**64 - 1)
                found.add(h)
        self.prefixes = np.sort(np.fromiter(found, np.uint64, len(found)))
        at, hit = self._found(self.prefixes)
        self.prefix_place = np.where(hit, at, -1)

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def kept_apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges (those ``before`` a rank, if given) leave pieces a and b (places) side by side.

        The symbols on both sides of the junction are followed from the whole pieces
        back to characters; the pieces are apart if no two of these symbols would have
        been merged before one of them went into its own piece.
        """
        a, b = a.copy(), b.copy()
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), NO_RANK) if before is None else before.copy()
        while len(live):
            x, y = a[live], b[live]
            size = self.size[x] + self.size[y]
            at, hit = self._found(self.hashes[x] * self.power[self.size[y]] + self.hashes[y])
            hit &= size <= self.longest
            cross = hit & (self.rank[at] < limit[live])
            ok[live[cross]] = False
            later = self.depth_rank[x] > self.depth_rank[y]
            done = cross | (~later & (self.depth_rank[y] < 0))
            step = live[~done & later]
            limit[step] = self.depth_rank[a[step]]
            a[step] = self.right[a[step]]
            step = live[~done & ~later]
            limit[step] = self.depth_rank[b[step]] + 1
            b[step] = self.left[b[step]]
            live = live[~done]
        return ok

    def breaks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cost of each junction of two places; what is found is kept."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        if not len(key):
            return np.zeros(0)
        at = np.minimum(np.searchsorted(self.seen, key), max(0, len(self.seen) - 1))
        known = self.seen[at] == key if len(self.seen) else np.zeros(len(key), bool)
        cost = self.seen_cost[at] if len(self.seen) else np.zeros(len(key))
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            found = np.where(self.kept_apart((new >> np.uint64(32)).astype(np.int64), (new & np.uint64(0xFFFFFFFF)).astype(np.int64)), 0.0, BREAK)
            cost[~known] = found[back]
            if len(self.seen) + len(new) > CACHE_JUNCTIONS:
                self.seen, self.seen_cost = np.zeros(0, np.uint64), np.zeros(0)
            at = np.searchsorted(self.seen, new)
            self.seen, self.seen_cost = np.insert(self.seen, at, new), np.insert(self.seen_cost, at, found)
        return cost

    def _clear(self) -> None:
        """Forget the best paths of units."""
        self.index: dict[str, int] = {}
        self.unit = Paths(1)

    def _clear_parts(self) -> None:
        """Forget the best paths of parts, and the junctions."""
        self.best_index: dict[str, int] = {}
        self.best = Paths(1)
        self.seen, self.seen_cost = np.zeros(0, np.uint64), np.zeros(0)

    def _clear_all(self) -> None:
        """Forget the N best paths of units and parts."""
        self.all_index: dict[str, int] = {}
        self.all = Paths(self.n)
        self.part_index: dict[str, int] = {}
        self.part = Paths(self.n)

    def search(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a part, best first; equal scores in the order in which they are reached."""
        size = len(part)
        # Nodes: (begin, end, score, ids, place); place -1 is a character without a piece, which merges with nothing.
        nodes: list[tuple] = []
        ending: list[list[int]] = [[] for _ in range(size + 1)]
        for b in range(1, size + 1):
            for a in range(max(0, b - self.longest), b):
                if found := self.pieces.get(part[a:b]):
                    at = int(self._found(np.array([self._hash(part[a:b])], np.uint64))[0][0])
                    ending[b].append(len(nodes))
                    nodes.append((a, b, found[0] - (0.0 if self.whole[at] else BREAK), (found[1],), at))
            if part[b - 1] not in self.pieces:
                ending[b].append(len(nodes))
                nodes.append((b - 1, b, self.low, tuple(self.bytes[x] for x in part[b - 1].encode()), -1))
        joints = [(i, j) for j, node in enumerate(nodes) for i in ending[node[0]] if nodes[i][4] >= 0 and node[4] >= 0]
        cost = dict(zip(joints, self.breaks(np.array([nodes[i][4] for i, _ in joints], np.int64), np.array([nodes[j][4] for _, j in joints], np.int64)).tolist(), strict=True)) if joints else {}
        best: list[float] = []
        for j, (a, _, score, _, _) in enumerate(nodes):
            best.append(score + (max((best[i] - cost.get((i, j), 0.0) for i in ending[a]), default=-np.inf) if a else 0.0))
        heap: list = [(-best[j], j, j, 0.0, None) for j in ending[size]]
        heapq.heapify(heap)
        out, made = [], len(nodes)
        while heap and len(out) < n:
            f, _, j, tail, path = heapq.heappop(heap)
            a, _, score, ids, _ = nodes[j]
            if not a:
                found_ids: list[int] = list(ids)
                while path:
                    found_ids += path[0]
                    path = path[1]
                out.append((-f, tuple(found_ids)))
                continue
            for i in ending[a]:
                made += 1
                after = score - cost.get((i, j), 0.0) + tail
                heapq.heappush(heap, (-(best[i] + after), made, i, after, (ids, path)))
        return out

    def best_many(self, parts: list[str]) -> None:
        """The best paths of new parts, and what their second best lose."""
        long = [p for p in parts if len(p) > LONGEST_ROW]
        rows = [p for p in parts if len(p) <= LONGEST_ROW]
        for at in range(0, len(rows), SIDE):
            some = rows[at : at + SIDE]
            odd, score, second, flat, length = self._best_rows(some)
            long += [p for p, o in zip(some, odd.tolist(), strict=True) if o]
            plain = [p for p, o in zip(some, odd.tolist(), strict=True) if not o]
            self._keep_best(plain, flat, length, score, score - second)
        for p in long:  # very long ones, those with characters without a piece, and ties
            paths = self.search(p, 2) if len(p) else [(0.0, ())]
            lost = paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf
            self._keep_best([p], np.array(paths[0][1], np.int64), np.array([len(paths[0][1])]), np.array([paths[0][0]]), np.array([lost]))

    def _keep_best(self, parts: list[str], flat: np.ndarray, length: np.ndarray, score: np.ndarray, lost: np.ndarray) -> None:
        base = len(self.best_index)
        self.best_index.update(zip(parts, range(base, base + len(parts)), strict=True))
        self.best.add(flat, length[:, None], score, lost[:, None])

    def _best_rows(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward pass over the nodes of many parts at once, with the two best scores of each node.

        Returns which parts are left out (a character without a piece, or two best paths
        of one score), and of the others the best and the second score (-inf: none), the
        ids of the best paths, flat, and their lengths.
        """
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        stop = np.cumsum(n)
        part = np.repeat(np.arange(len(parts)), n)
        # Pieces by their beginnings; a place is followed as long as some piece goes on so.
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        begins, ends, places = [], [], []
        single = np.zeros(len(codes), bool)
        for k in range(1, self.longest + 1):
            h = h * np.uint64(HASH) + codes[at + k - 1]
            i = np.minimum(np.searchsorted(self.prefixes, h), len(self.prefixes) - 1)
            some = self.prefixes[i] == h
            at, h, i = at[some], h[some], self.prefix_place[i[some]]
            hit = i >= 0
            begins.append(at[hit])
            ends.append(at[hit] + k)
            places.append(i[hit])
            if k == 1:
                single[at[hit]] = True
            some = at + k < stop[part[at]]
            at, h = at[some], h[some]
            if not len(at):
                break
        odd = np.zeros(len(parts), bool)
        odd[part[~single]] = True
        begin, end, place = np.concatenate(begins), np.concatenate(ends), np.concatenate(places)
        some = ~odd[part[begin]]
        begin, end, place = begin[some], end[some], place[some]
        order = np.argsort(end, kind="stable")
        begin, end, place = begin[order], end[order], place[order]
        score = self.hash_scores[place] - np.where(self.whole[place], 0.0, BREAK)
        own = part[begin]
        start = (stop - n)[own]
        # Junctions, by their second piece.
        count = np.bincount(end, minlength=len(codes) + 1)
        before = np.where(begin > start, count[begin], 0)
        second_of = np.repeat(np.arange(len(begin)), before)
        first_of = _ranges((np.cumsum(count) - count)[begin], before)
        cost = self.breaks(place[first_of], place[second_of])
        # The ends of parts are nodes, too: their junctions cost nothing.
        last = np.flatnonzero(end == stop[own])
        live = np.flatnonzero(~odd)
        first_of, second_of = np.append(first_of, last), np.append(second_of, len(begin) + np.searchsorted(live, own[last]))
        cost = np.append(cost, np.zeros(len(last)))
        level = np.append(end - start, np.full(len(live), LONGEST_ROW + 1)).astype(np.uint8)
        one, two = np.append(np.where(begin > start, -np.inf, score), np.full(len(live), -np.inf)), np.full(len(begin) + len(live), -np.inf)
        own_score = np.append(score, np.zeros(len(live)))
        link = np.full(len(one), -1)
        step = level[second_of]
        order = np.argsort(step, kind="stable")
        first_of, second_of, cost = first_of[order], second_of[order], cost[order]
        cuts = np.searchsorted(step[order], np.arange(LONGEST_ROW + 3))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            i, j, c = first_of[a:b], second_of[a:b], cost[a:b]
            head = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
            x, y = one[i] - c, two[i] - c
            top = np.maximum.reduceat(x, head)
            is_top = np.flatnonzero(x == np.repeat(top, np.diff(np.append(head, len(j)))))
            is_top = is_top[np.append(True, j[is_top[1:]] != j[is_top[:-1]])]
            x[is_top] = y[is_top]
            node = j[head]
            one[node], two[node], link[node] = own_score[node] + top, own_score[node] + np.maximum.reduceat(x, head), i[is_top]
        goal = np.arange(len(begin), len(one))
        tie = one[goal] == two[goal]
        odd[live[tie]] = True
        goal = goal[~tie]
        on_path, now = np.zeros(len(begin), bool), link[goal]
        while len(now):
            on_path[now] = True
            now = link[now]
            now = now[now >= 0]
        on_path = np.flatnonzero(on_path)
        return odd, one[goal], two[goal], self.hash_ids[place[on_path]], np.bincount(own[on_path], minlength=len(parts))[~odd]

    def search_many(self, parts: list[str]) -> None:
        """N-best search of new parts, which are kept; those of one length go side by side."""
        by_length: dict[int, list[str]] = {}
        for p in parts:
            by_length.setdefault(len(p), []).append(p)
        for n, group in by_length.items():
            deep = min(n, self.longest)
            side = max(16, CELLS // ((n + 1) * deep * deep))
            for at in range(0, len(group), side):
                rows = group[at : at + side]
                if n > LONGEST_ROW:
                    odd = np.ones(len(rows), bool)
                else:
                    odd, scores, flat, lengths = self._search_rows(np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32).reshape(len(rows), n).astype(np.uint64))
                    plain = [r for r, o in zip(rows, odd.tolist(), strict=True) if not o]
                    base = len(self.part_index)
                    self.part_index.update(zip(plain, range(base, base + len(plain)), strict=True))
                    self.part.add(flat, lengths, scores[:, 0], scores[:, :1] - scores)
                for r, o in zip(rows, odd.tolist(), strict=True):
                    if o:  # characters without a piece, or a very long part
                        paths = self.search(r, self.n)
                        loss = [paths[0][0] - s for s, _ in paths] + [np.inf] * (self.n - len(paths))
                        lengths = [len(ids) for _, ids in paths] + [0] * (self.n - len(paths))
                        self.part_index[r] = len(self.part_index)
                        self.part.add(np.array([i for _, ids in paths for i in ids], np.int64), np.array([lengths]), np.array([paths[0][0]]), np.array([loss]))

    def _search_rows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """N-best search of parts of one length, given as code points.

        Returns which parts have a character without a piece (not searched), and of
        the others the N best scores, the ids of these paths, flat, and their lengths.
        """
        m, n = codes.shape
        deep = min(n, self.longest)
        score, ids, place = np.full((m, n + 1, deep), -np.inf), np.zeros((m, n + 1, deep), np.int32), np.zeros((m, n + 1, deep), np.int32)
        h = np.zeros((m, n), np.uint64)
        for k in range(1, deep + 1):  # pieces of k characters, by their ends
            h = h[:, : n - k + 1] * np.uint64(HASH) + codes[:, k - 1 :] + np.uint64(1)
            at, hit = self._found(h)
            score[:, k:, k - 1] = np.where(hit, self.hash_scores[at] - np.where(self.whole[at], 0.0, BREAK), -np.inf)
            ids[:, k:, k - 1], place[:, k:, k - 1] = self.hash_ids[at], at
        odd = np.isneginf(score[:, 1:, 0]).any(axis=1)
        score, ids, place = score[~odd], ids[~odd], place[~odd]
        m = len(score)
        # joint[:, b, k, j]: cost between the piece of k + 1 characters that ends at b and one of j + 1 characters before it.
        joint = np.zeros((m, n + 1, deep, deep))
        there = score > -np.inf
        met = [np.nonzero(there[:, k:, k - 1, None] & there[:, : n + 1 - k, :]) for k in range(1, deep)]
        if met:
            r, b, j = (np.concatenate(x) for x in zip(*met, strict=True))
            k = np.repeat(np.arange(1, deep), [len(x[0]) for x in met])
            joint[r, b + k, k - 1, j] = self.breaks(place[r, b, j], place[r, b + k, k - 1])
        forward = np.full((m, n + 1, deep), -np.inf)
        for b in range(1, n + 1):
            for k in range(1, min(b, deep) + 1):
                before = (forward[:, b - k] - joint[:, b, k - 1]).max(axis=1) if b > k else 0.0
                forward[:, b, k - 1] = score[:, b, k - 1] + before
        # Nodes of the search: estimate, end and size of the piece, score of the path behind it, parent node.
        room = 8 * deep
        best, path, steps = np.full((m, self.n), -np.inf), np.zeros((m, self.n, n), np.int64), np.zeros((m, self.n), np.int64)
        alive = np.arange(m)
        f, tail = np.full((m, room), -np.inf), np.zeros((m, room))
        end, size, parent = (np.zeros((m, room), np.int32) for _ in range(3))
        f[:, :deep], end[:, :deep], size[:, :deep], parent[:, :deep] = forward[:, n], n, np.arange(deep), -1
        used, found = deep, np.zeros(m, np.int64)
        while len(alive):
            r = np.arange(len(alive))
            j = f[:, :used].argmax(axis=1)
            v, b, k = f[r, j], end[r, j], size[r, j]
            f[r, j] = -np.inf
            live = (v > -np.inf) & (found < self.n)
            begin = b - k - 1
            done = np.flatnonzero(live & (begin == 0))
            if len(done):
                rank, row, slot = found[done], alive[done], j[done]
                best[row, rank] = v[done]
                for _ in range(n):
                    going = slot >= 0
                    if not going.any():
                        break
                    d, w, q, t = done[going], row[going], rank[going], slot[going]
                    path[w, q, steps[w, q]] = ids[d, end[d, t], size[d, t]]
                    steps[w, q] += 1
                    slot = np.where(going, parent[done, slot], -1)
                found[done] += 1
            grow = np.flatnonzero(live & (begin > 0))
            if used + deep > f.shape[1]:
                more = ((0, 0), (0, 8 * deep))
                f = np.pad(f, more, constant_values=-np.inf)
                tail, end, size, parent = (np.pad(x, more) for x in (tail, end, size, parent))
            gb, gk, gj, at = b[grow], k[grow], j[grow], begin[grow]
            after = (score[grow, gb, gk] + tail[grow, gj])[:, None] - joint[grow, gb, gk]
            block = slice(used, used + deep)
            f[grow, block] = forward[grow, at] + after
            end[grow, block], size[grow, block], tail[grow, block], parent[grow, block] = at[:, None], np.arange(deep), after, gj[:, None]
            used += deep
            keep = live & (found < self.n)
            if keep.sum() < 0.7 * len(keep):
                alive, found, score, ids, forward, joint, f, tail, end, size, parent = (x[keep] for x in (alive, found, score, ids, forward, joint, f, tail, end, size, parent))
        flat = path[np.arange(n) < steps[:, :, None]]
        return odd, best, flat, steps

    def units(self, texts: pa.Array) -> pa.Array:
        """Units of each text: its words with the spaces before them, as marks."""
        texts = texts.cast(pa.large_string()).fill_null("")
        spaced = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), texts, pa.scalar("", pa.large_string())))
        whole = pc.replace_substring(spaced, " ", MARK)
        if pc.any(pc.match_substring(texts, "\x00")).as_py():  # the cut sign itself is in a text
            return pa.array([_UNIT.findall(t) or [""] for t in whole.to_pylist()], pa.list_(pa.large_string()))
        # A cut sign goes before each run of marks that follows another character.
        cut = pc.replace_substring(whole, MARK, f"\x00{MARK}")
        for _ in range(2):  # joins runs again: first pairs, then the pairs with each other
            cut = pc.replace_substring(cut, f"{MARK}\x00{MARK}", MARK + MARK)
        return pc.split_pattern(pc.utf8_ltrim(cut, "\x00"), "\x00")

    def _parts(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct parts of units, the place among them of each part, unit after unit, and how many parts each unit has."""
        text = "".join(units)
        n = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        cut = np.ones(len(codes) + 1, bool)
        if len(codes) > 1:
            pair = (codes[:-1] << np.uint64(21)) | codes[1:]
            at = np.minimum(np.searchsorted(self.adjacent, pair), len(self.adjacent) - 1)
            cut[1:-1] = self.adjacent[at] != pair
        starts = np.cumsum(n) - n
        cut[starts] = True
        ends = np.flatnonzero(cut)
        parts = [text[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        count = np.diff(np.searchsorted(ends[:-1], np.append(starts, len(codes))))
        if (n == 0).any():  # only the empty text has an empty unit
            parts, place = parts + [""], len(parts)
        words = pa.array(parts, pa.large_string()).dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if (n == 0).any():
            order = np.insert(np.arange(len(parts) - 1), np.searchsorted(ends[:-1], starts[n == 0]), place)
            at, count = at[order], np.where(n == 0, 1, count)
        return words.dictionary.to_numpy(zero_copy_only=False).tolist(), at, count

    def _learn(self, units: list[str]) -> None:
        """Put the best paths of units together from those of their parts and keep them."""
        if not units:
            return
        distinct, at, count = self._parts(units)
        new = [p for p in distinct if p not in self.best_index]
        if self.best_index and len(self.best_index) + len(new) > CACHE_PARTS:
            self._clear_parts()
            new = distinct
        self.best_many(new)
        at = np.fromiter(map(self.best_index.__getitem__, distinct), np.int64, len(distinct))[at]
        p, first = self.best, np.cumsum(count) - count
        length = p.length[at, 0]
        base = len(self.index)
        self.index.update(zip(units, range(base, base + len(units)), strict=True))
        self.unit.add(p.flat[_ranges(p.start[at, 0], length)], np.add.reduceat(length, first)[:, None], np.add.reduceat(p.score[at], first), np.minimum.reduceat(p.loss[at], first))

    def _learn_all(self, units: list[str]) -> None:
        """Put the N best paths of units together from those of their parts and keep them."""
        if not units:
            return
        distinct, at, count = self._parts(units)
        new = [p for p in distinct if p not in self.part_index]
        self.search_many([p for p in new if p])
        if "" in new:
            self.part_index[""] = len(self.part_index)
            self.part.add(np.zeros(0, np.int64), np.zeros((1, self.n), np.int64), np.zeros(1), np.array([[0.0] + [np.inf] * (self.n - 1)]))
        at = np.fromiter(map(self.part_index.__getitem__, distinct), np.int64, len(distinct))[at]
        p = self.part
        first = np.cumsum(count) - count
        length, loss = np.zeros((len(units), self.n), np.int64), np.full((len(units), self.n), np.inf)
        pieces: list[np.ndarray] = []
        one = count == 1
        length[one], loss[one] = p.length[at[first[one]]], p.loss[at[first[one]]]
        two = np.flatnonzero(count == 2)
        if len(two):  # the n least of all sums of one path of each part
            left, right = at[first[two]], at[first[two] + 1]
            sums = (p.loss[left][:, :, None] + p.loss[right][:, None, :]).reshape(len(two), -1)
            best = np.argsort(sums, axis=1, kind="stable")[:, : self.n]
            i, j = best // self.n, best % self.n
            lost = np.take_along_axis(sums, best, axis=1)
            here = lost < np.inf
            loss[two] = lost
            a, b = p.length[left[:, None], i] * here, p.length[right[:, None], j] * here
            length[two] = a + b
            starts = np.stack([p.start[left[:, None], i], p.start[right[:, None], j]], axis=2)
            of_two = p.flat[_ranges(starts.ravel(), np.stack([a, b], axis=2).ravel())]
        more = np.flatnonzero(count > 2)
        for u in more:
            rows = at[first[u] : first[u] + count[u]]
            best = [p.ids(r, 0) for r in rows]
            for k, (lost, how) in enumerate(least_sums(p.loss[rows].tolist(), self.n)):
                chosen = list(best)
                for i, other in how:
                    chosen[i] = p.ids(rows[i], other)
                pieces += chosen
                length[u, k], loss[u, k] = sum(map(len, chosen)), lost
        # All ids, unit after unit and path after path: those of one part are copied from it.
        total = length.sum(axis=1)
        flat, stop = np.zeros(int(total.sum()), np.int64), np.cumsum(total)
        begin = stop - total
        flat[_ranges(begin[one], total[one])] = p.flat[_ranges(p.start[at[first[one]]].ravel(), length[one].ravel())]
        if len(two):
            flat[_ranges(begin[two], total[two])] = of_two
        flat[_ranges(begin[more], total[more])] = np.concatenate(pieces or [np.zeros(0, np.int64)])
        base = len(self.all_index)
        self.all_index.update(zip(units, range(base, base + len(units)), strict=True))
        self.all.add(flat, length, np.add.reduceat(p.score[at], first), loss)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, np.ndarray]]]]:
        """Ids of the best segmentations, where each text's ids stop, and each text's N best (score, ids)."""
        lists = self.units(texts)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [u for u in distinct if u not in self.index]
        if self.index and len(self.index) + len(new) > CACHE_UNITS:
            self._clear()
            new = distinct
        self._learn(new)
        row = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        at = row[words.indices.to_numpy(zero_copy_only=False)]
        u = self.unit
        n = u.length[at, 0]
        stop = np.cumsum(n)
        flat = u.flat[_ranges(u.start[at, 0], n)].astype(np.uint32)
        begins = np.append(0, stop)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        score, second = u.score[at], u.loss[at, 0]
        bounds = list(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True))
        chosen = [np.arange(a, b) if b - a <= self.n else np.sort(a + np.argpartition(second[a:b], self.n - 1)[: self.n]) for a, b in bounds]
        full = self._all_rows(words.indices.to_numpy(zero_copy_only=False), distinct, chosen) if self.n > 1 else {}
        out = []
        for (a, b), some in zip(bounds, chosen, strict=True):
            ids, best = flat[begins[a] : begins[b]], float(score[a:b].sum())
            found = [(best, ids)]
            rows = [full[w] for w in some.tolist()] if self.n > 1 else []
            for lost, how in least_sums(self.all.loss[rows].tolist(), self.n)[1:] if self.n > 1 else ():
                cut, parts = begins[a], []
                for i, k in how:
                    w = some[i]
                    parts += [flat[cut : begins[w]], self.all.ids(rows[i], k).astype(np.uint32)]
                    cut = begins[w + 1]
                found.append((best - lost, np.concatenate([*parts, flat[cut : begins[b]]])))
            out.append(found)
        return flat, begins[ends], out

    def _all_rows(self, word_of: np.ndarray, distinct: list[str], chosen: list[np.ndarray]) -> dict[int, int]:
        """The row of N best paths of each chosen place."""
        places = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        units = [distinct[w] for w in word_of[places].tolist()]
        wanted = list(dict.fromkeys(units))
        new = [x for x in wanted if x not in self.all_index]
        if len(self.all_index) + len(new) > CACHE_ALL or len(self.part_index) > CACHE_ALL:
            self._clear_all()
            new = wanted
        self._learn_all(new)
        return dict(zip(places.tolist(), map(self.all_index.__getitem__, units), strict=True))

    def segment(self, text: str | None, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a whole text."""
        units = self.units(pa.array([text or ""]))[0].as_py()
        paths: list[tuple[float, list[int]]] = [(0.0, [])]
        for u in units:
            found = self.search(u, n) if u else [(0.0, ())]
            paths = heapq.nlargest(n, [(a + b, p + list(q)) for a, p in paths for b, q in found], key=lambda x: x[0])
        return paths

    def strings(self) -> np.ndarray:
        """The bytes of each id; ids outside the text, such as begin and end, have none."""
        return np.array([bytes([self.byte_of[i]]) if i in self.byte_of else self.piece_of.get(i, "").encode() for i in range(self.model.get_piece_size())], dtype=object)

    def decode(self, ids) -> str:
        """The text of a sequence of ids; bytes that are not UTF-8 become the replacement character."""
        out = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.piece_of.get(i, "").encode() for i in ids)
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def segment_texts(docs: DataFrame, model: str = "piece_bpe_32k.model", n: int = 4, with_ids: bool = True) -> DataFrame:
    """The N best segmentations of each row of ``docs`` (doc_id, text), no shuffle.

    Returns ``doc_id, n_pieces, ids_crc32`` (of the best, which is the library's
    encoding), ``nbest_scores`` and ``nbest_crc32`` (at most ``n``, best first; a
    score is the sum of the pieces' scores less BREAK for each junction that the
    merges would not leave), ``round_trip`` (the best ids decode to the text, with
    word marks read as spaces) and, on demand, ``nbest``, an array of (score, ids).
    A null or empty text has no pieces and one segmentation of score zero.
    Characters without a piece become bytes.  Repeated rows and null ids give a row
    each; other columns are not read.
    """
    fields = [docs.select("doc_id").schema[0], StructField("n_pieces", LongType()), StructField("ids_crc32", LongType()), StructField("nbest_scores", ArrayType(DoubleType())), StructField("nbest_crc32", ArrayType(LongType())), StructField("round_trip", BooleanType())]
    if with_ids:
        fields.append(StructField("nbest", ArrayType(StructType([StructField("score", DoubleType()), StructField("ids", ArrayType(IntegerType()))]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pieces = lattice(model, n)
        strings = pieces.strings()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, stops, nbest = pieces.encode(part.column("text"))
                begins = np.append(0, stops[:-1])
                crc = [[zlib.crc32(x.astype("<u4").tobytes()) for _, x in found] for found in nbest]
                same = []
                for a, b, text in zip(begins.tolist(), stops.tolist(), part.column("text").to_pylist(), strict=True):
                    back = b"".join(strings[ids[a:b]].tolist()).decode("utf-8", "replace").replace(MARK, " ")
                    same.append(back[1:] == (text or "").replace(MARK, " ") if text else not back)
                out = {"doc_id": part.column("doc_id"), "n_pieces": stops - begins, "ids_crc32": [c[0] for c in crc], "nbest_scores": [[s for s, _ in found] for found in nbest], "nbest_crc32": crc, "round_trip": same}
                if with_ids:
                    out["nbest"] = [[{"score": s, "ids": x.astype(np.int32)} for s, x in found] for found in nbest]
                yield out

    return map_batches(docs.select("doc_id", docs["text"].cast("string").alias("text")), run, StructType(fields))


def decode_ids(rows: DataFrame, ids: str | Column = "ids", model: str = "piece_bpe_32k.model", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of an array of ids, no shuffle.

    Null ids give null, no ids the empty text; ids outside the vocabulary, null ones
    and control ids are passed over; bytes that are not UTF-8 become the replacement
    character.  A column of the name ``out`` is replaced.
    """
    base = rows.drop(out).withColumn("_ids_to_text", (F.col(ids) if isinstance(ids, str) else ids).cast("array<int>"))
    names = [c for c in base.columns if c != "_ids_to_text"]
    schema = StructType([f for f in base.schema if f.name != "_ids_to_text"] + [StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pieces = lattice(model)
        for batch in batches:
            texts = [None if x is None else pieces.decode(i for i in x if i is not None) for x in batch.column("_ids_to_text").to_pylist()]
            yield {c: batch.column(c) for c in names} | {out: texts}

    return map_batches(base, run, schema)
