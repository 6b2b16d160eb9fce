"""The best k documents of very many queries by a sum over shared words, exactly and with bounded memory.

Queries with the same words are one, as are documents with the same words and length in a task. Frequent words that queries
share are merged into symbols, so that a query is few of them. In blocks of documents of like length, a symbol is a row of whole
numbers that no sum of gains exceeds; queries in order of their symbols add rows to the sum of the query before as far as they
differ, and rare words by their lists. What may enter the best k is scored again exactly. A query skips a block in which its
words can't reach its k-th best score so far. Queries with a gate meet the blocks as products of frequent words instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint

#: Pairs (query, word) sent at once; documents held by a task, and their words; numbers in a matrix; queries merged together; ids of one query profile.
MOST_ASKED, CHUNK, CHUNK_WORDS, CELLS, PART, SHARED = 2_000_000, 36_000, 1_500_000, 4_000_000, 256, 4096
#: Documents and queries of a product; share of the documents from which a word is frequent.
STEP, QUERIES, OFTEN = 4096, 512, 0.004
#: Numbers in the rows of symbols; documents that bound an empty list; documents of a block; symbols made of others; places in the lists of a block of queries.
ROWS, FIRST, WIDEST, MERGED, PLACES = 32_000_000, 2048, 32_768, 1000, 3_000_000
MICRO = 1e6


class Asked:
    """A block of queries as arrays: distinct profiles (pointers, words, weights), their divisors and least words, the ids of each."""

    def __init__(self, pairs: pa.Table, words: pa.Array, weight, least=None, often=None) -> None:
        """``pairs`` (query_id, token, times, n) with tokens among ``words``; ``weight`` of each word; ``least`` words met by n (None: no gate), n divides without weights; ``often``: which words are frequent."""
        import numpy as np

        ids = pairs["query_id"].combine_chunks().dictionary_encode()
        q = ids.indices.to_numpy(zero_copy_only=False)
        code = pa.compute.index_in(pairs["token"].combine_chunks(), value_set=words).to_numpy(zero_copy_only=False).astype(np.int32)
        times, n = (pairs[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("times", "n"))
        order = np.lexsort((code, q))
        q, code, times, n = q[order], code[order], times[order], n[order]
        ends = np.append(np.flatnonzero(q[1:] != q[:-1]) + 1, len(q)) if len(q) else np.zeros(0, int)
        seen: dict = {}
        members: list[list[int]] = []
        rows = []
        for a, b in zip(np.concatenate([[0], ends[:-1]]) if len(ends) else [], ends):
            key = (code[a:b].tobytes(), times[a:b].tobytes(), int(n[a]))
            at = seen.get(key)
            if at is None or len(members[at]) >= SHARED:
                at = seen[key] = len(rows)
                rows.append((a, b))
                members.append([])
            members[at].append(int(q[a]))
        self.words, self.count = words, len(rows)
        take = np.concatenate([np.arange(a, b) for a, b in rows]) if rows else np.zeros(0, int)
        self.ptr = np.concatenate([[0], np.cumsum([b - a for a, b in rows])]).astype(np.int64)
        self.code = code[take]
        size = np.array([n[a] for a, _ in rows], dtype=float)
        self.weight = times[take] * (np.asarray(weight)[self.code] if weight is not None else 1.0)
        self.divisor = size if weight is None else None
        self.least = None if least is None else np.array([least(int(x)) for x in size], dtype=np.float32)
        self.size = size
        self.member_ptr = np.concatenate([[0], np.cumsum([len(m) for m in members])]).astype(np.int64)
        self.ids = ids.dictionary.take(pa.array([x for m in members for x in m], pa.int64()))
        if least is None:
            self._symbols(np.ones(len(words), bool) if often is None else often)

    def _symbols(self, often) -> None:
        """``atoms`` (word, weight); of each query its rare atoms (``rare_ptr``, ``rare``) and its symbols (``sym_ptr``, ``sym``): frequent atoms (``common``), or pairs of symbols (``merges``) counted on from them."""
        import numpy as np

        row = np.repeat(np.arange(self.count), np.diff(self.ptr))
        first, of = np.unique(np.rec.fromarrays([self.code, self.weight]), return_index=True, return_inverse=True)[1:]
        self.atoms = (self.code[first], self.weight[first])
        frequent = often[self.atoms[0]]
        rare = ~frequent[of]
        self.rare_ptr, self.rare = np.concatenate([[0], np.cumsum(np.bincount(row[rare], minlength=self.count))]), of[rare].astype(np.int32)
        self.common = np.flatnonzero(frequent)
        number = np.cumsum(frequent) - 1
        row, sym, v = row[~rare], number[of[~rare]], len(self.common)
        merges: list[tuple[int, int]] = []
        rng = np.random.default_rng(7)
        while len(merges) < MERGED and len(sym):
            order = np.lexsort((sym, row))
            row, sym = row[order], sym[order]
            size = np.bincount(row, minlength=self.count)
            start = np.cumsum(size) - size
            some = rng.permutation(np.flatnonzero((size > 1) & (size <= 256)))
            some = some[: np.searchsorted(np.cumsum(size[some] * (size[some] - 1) // 2), 3_000_000) + 1]
            if not len(some):
                break
            left = _spread(start[some], size[some])
            after = np.repeat(start[some] + size[some], size[some]) - left - 1
            key, n = np.unique(np.repeat(sym[left], after) * np.int64(v) + sym[_spread(left + 1, after)], return_counts=True)
            partner, taken, new = np.full(v, -1, np.int64), np.zeros(v, bool), len(merges)
            for i in np.argsort(-n, kind="stable")[:2000].tolist():
                a, b = divmod(int(key[i]), v)
                if n[i] * 2000 < len(some) or n[i] < 4 or len(merges) - new >= 200 or len(merges) >= MERGED:
                    break
                if not taken[a] and not taken[b]:
                    taken[a] = taken[b] = True
                    partner[a] = b
                    merges.append((a, b))
            if len(merges) == new:
                break
            name = np.full(v, -1, np.int64)
            name[[a for a, _ in merges[new:]]] = v + np.arange(len(merges) - new)
            key = row * np.int64(v) + sym
            at = np.flatnonzero(partner[sym] >= 0)
            want = row[at] * np.int64(v) + partner[sym[at]]
            other = np.minimum(np.searchsorted(key, want), len(key) - 1)
            met = key[other] == want
            sym[at[met]] = name[sym[at[met]]]
            keep = np.ones(len(sym), bool)
            keep[other[met]] = False
            row, sym, v = row[keep], sym[keep], v + len(merges) - new
        # symbols of many queries first, so that queries in order share the sums of their first ones
        used = np.bincount(sym, minlength=v)
        order = np.lexsort((sym, -used[sym], row))
        self.merges, self.sym = merges, sym[order].astype(np.int32)
        self.sym_ptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=self.count))])


def _spread(starts, sizes):
    """Positions of runs laid end to end."""
    import numpy as np

    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Lists:
    """The best k of each query among documents given in chunks; ties by id."""

    def __init__(self, asked: Asked, k: int, gain) -> None:
        import numpy as np

        self.asked, self.k, self.gain = asked, k, gain
        self.score = np.zeros((asked.count, k))
        self.doc = np.full((asked.count, k), -1, np.int32)
        self.met = np.zeros((asked.count, k), np.int16) if asked.least is not None else None
        self.ids = None
        self.place = np.full(len(asked.words) + 1, -1, np.int64)
        self.row = np.repeat(np.arange(asked.count), np.diff(asked.ptr))
        # queries of like frequent words lie together
        by = np.lexsort((asked.code, asked.weight, self.row))
        head = asked.code[by][np.minimum(asked.ptr[:-1], max(len(by) - 1, 0))] if len(by) else np.zeros(0, int)
        second = asked.code[by][np.minimum(asked.ptr[:-1] + 1, asked.ptr[1:] - 1)] if len(by) else head
        self.order = np.lexsort((second, head))
        if asked.least is None:
            held = asked.sym.tolist()
            self.sequences = [held[x:y] for x, y in zip(asked.sym_ptr[:-1].tolist(), asked.sym_ptr[1:].tolist())]
            self.order = np.array(sorted(range(asked.count), key=self.sequences.__getitem__), np.int64)
            self.frequent = np.full(len(asked.words) + 1, -1, np.int64)
            words = np.unique(asked.atoms[0][asked.common])
            self.frequent[words] = np.arange(len(words))

    def chunk(self, ids: pa.Array, code, amount, sizes, length) -> None:
        """Documents with their words (``code``, -1 for words nobody asks for, ``amount``, runs of ``sizes``) and lengths."""
        import numpy as np

        # indexes of documents are in the order of their ids, with those kept from earlier chunks
        kept = np.zeros(0, np.int64)
        if self.ids is not None:
            kept = np.zeros(len(self.ids), bool)
            kept[self.doc[self.doc >= 0]] = True
            kept = np.flatnonzero(kept)
            known = pa.concat_arrays([self.ids.take(pa.array(kept)), ids])
        else:
            known = ids
        order = pa.compute.sort_indices(known).to_numpy()
        index = np.empty(len(order), np.int64)
        index[order] = np.arange(len(order))
        self.ids = known.take(pa.array(order))
        if len(kept):
            held = self.doc >= 0
            self.doc[held] = index[np.searchsorted(kept, self.doc[held])]
        index = index[len(kept):]

        doc = np.repeat(np.arange(len(ids)), sizes)
        use = code >= 0
        doc, code, amount = doc[use], code[use], amount[use]
        v = len(self.asked.words)
        key, inverse = np.unique(doc * v + code, return_inverse=True)
        tf = np.bincount(inverse, weights=amount, minlength=len(key))
        doc, code = np.divmod(key, v)
        per = np.bincount(doc, minlength=len(ids))
        # documents of the same words, frequencies and length: a pair of sums of random numbers tells them apart
        rng = np.random.default_rng(7)
        marks = []
        for _ in range(2):
            mark = rng.integers(0, 1 << 63, v + 1, dtype=np.uint64)
            x = (mark[code] ^ tf.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
            ends = np.cumsum(per)
            marks.append((total[ends] - total[ends - per]) ^ (length.astype(float).view(np.uint64) * mark[v]))
        some = np.flatnonzero(per)
        some = some[np.lexsort((index[some], marks[1][some], marks[0][some]))]
        if not len(some):
            return
        new = np.append(True, (marks[0][some][1:] != marks[0][some][:-1]) | (marks[1][some][1:] != marks[1][some][:-1]))
        first = np.flatnonzero(new)
        count = np.minimum(np.diff(np.append(first, len(some))), self.k)
        members = index[some[_spread(first, count)]]
        rep = some[first]
        self.runs = (np.full(len(self.ids), -1, np.int64), np.concatenate([[0], np.cumsum(count)]), members)
        self.runs[0][index[rep]] = np.arange(len(rep))

        start = np.concatenate([[0], np.cumsum(per)])
        gains = self.gain(tf, length[doc])
        by_length = rep[np.argsort(length[rep], kind="stable")]
        flat = _spread(start[by_length], per[by_length])
        meet = self._meet if self.asked.least is not None else self._sums
        runs, code, gains, doc = np.concatenate([[0], np.cumsum(per[by_length])]), code[flat], gains[flat], None
        del use, amount, key, inverse, tf, x, total, marks, flat, start  # several times the documents themselves
        meet(runs, code, gains, index[by_length])
        self._expand()

    def _meet(self, ptr, code, gain, rep) -> None:
        """Profiles in blocks of like lengths against queries in blocks of like words."""
        import numpy as np

        a, p, v = self.asked, len(rep), len(self.asked.words)
        often = np.bincount(code, minlength=v) >= OFTEN * p
        scale = MICRO if a.divisor is None else MICRO / a.divisor
        x = 0
        while x < p:
            y = min(p, x + STEP)
            present = np.unique(code[ptr[x] : ptr[y]])
            while y - x > 64 and len(present) * (y - x) > CELLS:
                y = x + (y - x) // 2
                present = np.unique(code[ptr[x] : ptr[y]])
            part = slice(ptr[x], ptr[y])
            self.place[present] = np.arange(len(present))
            row, column = self.place[code[part]], np.repeat(np.arange(y - x), np.diff(ptr[x : y + 1]))
            dense = np.zeros((len(present) + 1, y - x))
            dense[row, column] = gain[part]
            most = np.append(dense.max(axis=1)[:-1], 0.0)
            # what the words of a query can give in this block; a query that can't reach its k-th best is left out
            place = self.place[a.code]
            bound = np.bincount(self.row, weights=a.weight * most[place], minlength=a.count)
            live = self.order[(bound * scale + 1.0 >= self._least(slice(None)))[self.order]]
            live = live[bound[live] > 0]
            by = np.argsort(row, kind="stable")
            runs = (np.searchsorted(row[by], np.arange(len(present) + 1)), column[by], gain[part][by])
            light = dense.astype(np.float32)
            for z in range(0, len(live), QUERIES):
                self._visit(live[z : z + QUERIES], bound, dense, light, place, often, runs, rep[x:y])
            self.place[present] = -1
            x = y

    def _sums(self, ptr, code, gain, rep) -> None:
        """Profiles in blocks of like lengths against queries in order of their symbols."""
        import numpy as np

        a, p, v = self.asked, len(rep), len(self.asked.words)
        atom_word, atom_weight = a.atoms
        common, rows_all = len(a.common), len(a.common) + len(a.merges)
        widest = int(max(256, min(WIDEST, ROWS // max(rows_all, 1))))
        rows = np.empty((rows_all, min(widest, p)), np.uint16)  # one table for all blocks
        own: list = []
        widest -= widest % 8
        mask = np.empty(widest + 8, bool)
        scratch = np.empty(widest, np.uint16)
        scale = MICRO if a.divisor is None else MICRO / a.divisor
        size = np.diff(a.ptr)
        x = 0
        while x < p:
            y = min(p, x + widest)
            wide = y - x
            part = slice(ptr[x], ptr[y])
            col, cd, g = np.repeat(np.arange(wide), np.diff(ptr[x : y + 1])), code[part], gain[part]
            most = np.zeros(v)
            np.maximum.at(most, cd, g)
            worth = atom_weight * most[atom_word]
            bound = np.bincount(self.row, weights=a.weight * most[a.code], minlength=a.count)
            # sums must stay below 65536; each word adds less than one unit too much
            whole = a.divisor is not None and bound.max(initial=0) < 65_000
            unit = 1.0 if whole else max(bound.max(initial=0) / max(65_000 - int(size.max(initial=0)), 1000), 1e-12)
            slack = np.zeros(a.count, np.int64) if whole else size + 1
            # rows of words, then of what is made of them
            by = np.argsort(cd, kind="stable")
            edge = np.searchsorted(cd[by], np.arange(v + 1))
            for i, atom in enumerate(a.common.tolist()):
                w = atom_word[atom]
                at = by[edge[w] : edge[w + 1]]
                rows[i, :wide] = 0
                rows[i, col[at]] = np.ceil(g[at] * (atom_weight[atom] / unit))
            for i, (left, right) in enumerate(a.merges):
                np.add(rows[left, :wide], rows[right, :wide], out=rows[common + i, :wide])
            least = self._least(slice(None))
            height = rows[:, :wide].max(axis=1).astype(np.int64) if rows_all else np.zeros(0, np.int64)
            lift = np.ceil(worth / unit).astype(np.int64)
            owner = np.repeat(np.arange(a.count), np.diff(a.sym_ptr))
            reach = np.bincount(owner, weights=height[a.sym], minlength=a.count) + np.bincount(np.repeat(np.arange(a.count), np.diff(a.rare_ptr)), weights=lift[a.rare], minlength=a.count)
            limit = np.maximum(np.floor((least - 0.75) / scale / unit - 1e-6), 1).astype(np.int64)
            live = self.order[((reach >= limit) & (bound > 0))[self.order]]
            # where a word's place in a document is
            f = self.frequent[cd]
            inside = np.arange(len(cd)) - np.repeat(ptr[x:y] - ptr[x], np.diff(ptr[x : y + 1]))
            spot = np.zeros((wide, int(self.frequent.max()) + 1), np.uint16 if inside.max(initial=0) < 65_000 else np.int32)
            spot[col[f >= 0], f[f >= 0]] = inside[f >= 0] + 1
            odd = np.flatnonzero(f < 0)
            odd_key = col[odd] * np.int64(v) + cd[odd]
            odd_order = np.argsort(odd_key)
            block = (ptr[x:y] - ptr[x], g, spot, odd_key[odd_order], g[odd][odd_order])
            lists = {}
            for atom in np.flatnonzero((most[atom_word] > 0) & (self.frequent[atom_word] < 0)).tolist():
                at = by[edge[atom_word[atom]] : edge[atom_word[atom] + 1]]
                lists[atom] = (col[at], np.ceil(g[at] * (atom_weight[atom] / unit)).astype(np.uint16))
            before: list = []
            sums: list = []
            here, over, up = mask[:wide], scratch[:wide], -(-wide // 8) * 8
            mask[wide:up] = False
            eights, by_eight = mask[:up].view(np.uint64), mask[:up].reshape(-1, 8)
            owners: list[int] = []
            hits: list = []
            held = 0
            k = self.k
            cold, first = (self.score[:, k - 1] == 0).tolist(), min(wide, max(FIRST, 8 * k))
            limits, slacks, rare_ptr, rare = limit.tolist(), slack.tolist(), a.rare_ptr.tolist(), a.rare.tolist()
            for i in live.tolist():
                now = self.sequences[i]
                same = 0
                for s, t in zip(now, before):
                    if s != t:
                        break
                    same += 1
                del sums[same:]
                for d in range(same, len(now)):
                    if d:
                        if len(own) <= d:
                            own.extend(np.empty(widest, np.uint16) for _ in range(d + 1 - len(own)))
                        sums.append(np.add(sums[d - 1], rows[now[d], :wide], out=own[d][:wide]))
                    else:
                        sums.append(rows[now[0], :wide])
                before = now
                top = sums[-1] if sums else None
                few = [lists[atom] for atom in rare[rare_ptr[i] : rare_ptr[i + 1]] if atom in lists]
                if few or top is None:
                    if top is None:
                        over[:] = 0
                    else:
                        np.copyto(over, top)
                    for c, gains in few:
                        over[c] += gains
                    top = over
                floor = limits[i]
                if cold[i] and first > k:  # the k-th best of some documents is a bound as well
                    floor = max(floor, int(np.partition(top[:first], first - k)[first - k]) - slacks[i])
                np.greater_equal(top, floor, out=here)
                eight = (eights != 0).nonzero()[0]  # few documents remain, so eight are asked at once
                if not len(eight):
                    continue
                h = by_eight[eight].ravel().nonzero()[0]
                h = eight[h >> 3] * 8 + (h & 7)
                if len(h) > k + k // 8:
                    value = top[h]
                    border = int(np.partition(value, len(h) - k)[len(h) - k]) - slacks[i]
                    if border > limits[i]:
                        h = h[value >= border]
                owners.append(i)
                hits.append(h)
                held += len(h)
                if held > 20_000:
                    self._score(owners, hits, block, rep[x:y], scale)
                    owners, hits, held = [], [], 0
            if held:
                self._score(owners, hits, block, rep[x:y], scale)
            x = y

    def _score(self, owners, hits, block, rep, scale) -> None:
        """Exact scores of documents (columns of a block) that may enter the lists of their queries."""
        import numpy as np

        a, v = self.asked, len(self.asked.words)
        start, g, spot, odd_key, odd_gain = block
        q = np.array(owners)
        r, c = np.repeat(np.arange(len(q)), [len(h) for h in hits]), np.concatenate(hits)
        n = np.diff(a.ptr)[q[r]]
        pairs, pair = _spread(a.ptr[q[r]], n), np.repeat(np.arange(len(r)), n)
        code, doc = a.code[pairs], c[pair]
        f = self.frequent[code]
        place = np.where(f >= 0, spot[doc, np.maximum(f, 0)] if spot.shape[1] else 0, 0)
        gains = np.where(place > 0, g[np.maximum(start[doc] + place.astype(np.int64) - 1, 0)], 0.0)
        odd = np.flatnonzero(f < 0)
        if len(odd) and len(odd_key):
            want = doc[odd] * np.int64(v) + code[odd]
            at = np.minimum(np.searchsorted(odd_key, want), len(odd_key) - 1)
            gains[odd] = np.where(odd_key[at] == want, odd_gain[at], 0.0)
        total = np.bincount(pair, weights=a.weight[pairs] * gains, minlength=len(r))
        found = np.floor(total * (scale if a.divisor is None else scale[q[r]]) + 0.5)
        good = found >= self._least(q)[r]
        self._add(q, r[good], rep[c[good]], found[good], None)

    def _least(self, q):
        import numpy as np

        return np.maximum(self.score[q, self.k - 1], 1.0)

    def _visit(self, q, bound, dense, light, place, often, runs, rep) -> None:
        """Queries against a block of profiles: frequent words by products in single precision, rare ones by their lists; what may enter is scored again exactly."""
        import numpy as np

        a, wide = self.asked, dense.shape[1]
        n = a.ptr[q + 1] - a.ptr[q]
        pairs = _spread(a.ptr[q], n)
        owner, at, weight = np.repeat(np.arange(len(q)), n), place[pairs], a.weight[pairs]
        slot = np.arange(len(pairs)) - np.repeat(np.cumsum(n) - n, n)
        held = at >= 0
        owner, at, weight, slot, frequent = owner[held], at[held], weight[held], slot[held], often[a.code[pairs[held]]]
        words, local = np.unique(at[frequent], return_inverse=True)
        if len(words) * len(q) > 3 * len(local):  # a product of all words would mostly multiply zeros
            s = np.zeros((len(q), wide), np.float32)
            mine, take = at[frequent], weight[frequent].astype(np.float32)
            edges = np.searchsorted(owner[frequent], np.arange(len(q) + 1))
            lines = np.empty((int(np.diff(edges).max(initial=0)), wide), np.float32)
            for i, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                if y > x:
                    np.take(light, mine[x:y], axis=0, out=lines[: y - x], mode="clip")
                    np.dot(take[x:y], lines[: y - x], out=s[i])
        else:
            weights = np.zeros((len(q), len(words)), np.float32)
            weights[owner[frequent], local] = weight[frequent]
            s = weights @ light[words]
        rare = ~frequent
        first, size = runs[0][at[rare]], runs[0][at[rare] + 1] - runs[0][at[rare]]
        flat = _spread(first, size)
        np.add.at(s.reshape(-1), np.repeat(owner[rare], size) * wide + runs[1][flat], (np.repeat(weight[rare], size) * runs[2][flat]).astype(np.float32))
        divisor = np.ones(len(q)) if a.divisor is None else a.divisor[q]
        slack = bound[q] * 1e-5 + 1e-9
        least = self._least(q)
        mask = s >= np.maximum((least - 0.75) / MICRO * divisor - slack, 1e-9).astype(np.float32)[:, None]
        if wide > self.k and np.count_nonzero(mask) > 3 * self.k * len(q):
            if a.least is not None:
                every, inverse = np.unique(at, return_inverse=True)
                has = np.zeros((len(q), len(every)), np.float32)
                has[owner, inverse] = 1.0
                mask &= has @ (light[every] > 0).astype(np.float32) >= a.least[q][:, None]
            border = -np.partition(-np.where(mask, s, 0.0), self.k - 1, axis=1)[:, self.k - 1]
            mask &= s >= (border - 2 * slack - 1e-6 * divisor)[:, None].astype(np.float32)
        r, c = np.divmod(np.flatnonzero(mask.reshape(-1)), wide)
        if not len(r):
            return
        longest = int(n.max())
        rows, exact = np.full((len(q), longest), len(dense) - 1), np.zeros((len(q), longest))
        rows[owner, slot], exact[owner, slot] = at, weight
        found, met = np.empty(len(r)), None if a.least is None else np.empty(len(r), np.int16)
        for x in range(0, len(r), 50_000):
            y = slice(x, x + 50_000)
            gains = dense[rows[r[y]], c[y, None]]
            found[y] = (exact[r[y]] * gains).sum(axis=1)
            if met is not None:
                met[y] = (gains > 0).sum(axis=1)
        found = np.floor(found / divisor[r] * MICRO + 0.5)
        good = found >= least[r]
        if met is not None:
            good &= met >= a.least[q][r]
        self._add(q, r[good], rep[c[good]], found[good], None if met is None else met[good])

    def _add(self, q, r, doc, found, met) -> None:
        import numpy as np

        if not len(r):
            return
        touched, t = np.unique(r, return_inverse=True)
        qs = q[touched]
        old_s, old_d = self.score[qs], self.doc[qs]
        x, y = np.nonzero(old_s > 0)
        m = None if met is None else np.concatenate([self.met[qs][x, y], met])
        self._set(qs, np.concatenate([x, t]), np.concatenate([old_s[x, y], found]), np.concatenate([old_d[x, y], doc]), m)

    def _set(self, qs, t, s, d, m) -> None:
        """The first k of rows (t into qs, score, document, words met) as the lists of those queries."""
        import numpy as np

        order = np.lexsort((d, -s, t))
        t = t[order]
        first = np.append(0, np.flatnonzero(t[1:] != t[:-1]) + 1)
        place = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
        keep = place < self.k
        t, place, order = t[keep], place[keep], order[keep]
        self.score[qs], self.doc[qs] = 0.0, -1
        self.score[qs[t], place], self.doc[qs[t], place] = s[order], d[order]
        if m is not None:
            self.met[qs[t], place] = m[order]

    def _expand(self) -> None:
        """Profiles as their documents."""
        import numpy as np

        profile, start, members = self.runs
        for x in range(0, self.asked.count, 512):
            qs = np.arange(x, min(x + 512, self.asked.count))
            s, d = self.score[qs], self.doc[qs]
            of = np.where(d >= 0, profile[d], -1)
            size = np.where(of >= 0, start[of + 1] - start[of], (d >= 0).astype(np.int64))
            if not (size > 1).any():
                continue
            # entries behind k documents of better scores are out
            total = np.cumsum(size, axis=1) - size
            better = np.where(np.append(np.ones((len(qs), 1), bool), s[:, 1:] != s[:, :-1], axis=1), total, -1)
            better = np.maximum.accumulate(better, axis=1)
            t, c = np.nonzero((d >= 0) & (better < self.k))
            n = size[t, c]
            own = of[t, c] >= 0
            docs = np.repeat(d[t, c].astype(np.int64), n)
            inside = np.repeat(own, n)
            docs[inside] = members[_spread(start[of[t, c][own]], n[own])]
            self._set(qs, np.repeat(t, n), np.repeat(s[t, c], n), docs, None if self.met is None else np.repeat(self.met[qs][t, c], n))

    def parts(self) -> Iterator[tuple[int, bytes]]:
        """(part, table of (q, s, d, m) as bytes): the lists of so many queries each."""
        import numpy as np

        for x in range(0, self.asked.count, PART):
            r, c = np.nonzero(self.score[x : x + PART] > 0)
            if not len(r):
                continue
            s, d = self.score[x + r, c], self.doc[x + r, c]
            m = self.met[x + r, c] if self.met is not None else np.zeros(len(r), np.int16)
            batch = pa.record_batch([pa.array(r.astype(np.int16)), pa.array(s.astype(np.int64)), self.ids.take(pa.array(d)), pa.array(m)], names=["q", "s", "d", "m"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch)
            yield x // PART, sink.getvalue().to_pybytes()


def best(docs: DataFrame, asked: DataFrame, k: int, weight=None, gain=None, least=None, then=None) -> DataFrame:
    """(query_id, doc_id, score, rank, met, n): the first k documents of each query by score, ties by id.

    ``docs`` is (doc_id, w: array of words, optionally x: what each of them counts), a table as it is read twice;
    ``asked`` (query_id, token, times, n). A score is the sum of times * weight(df) * gain(tf, length) over the shared words, or
    their number over n without ``weight``; ``least`` gives how many words must be met of n. Rounded to six digits.
    Queries are sent to the documents in blocks; a task passes on its best k per query. ``then`` is (what is made of the rows of
    some whole queries, as Arrow tables; the schema of that).
    """
    spark = docs.sparkSession
    asked = checkpoint(asked)
    words = asked.select("token").distinct()
    df = docs.select(F.explode(F.array_distinct("w")).alias("token")).join(F.broadcast(words), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    df = df.toArrow().combine_chunks()
    tokens = df["token"].combine_chunks() if df.num_rows else pa.array([], pa.string())
    weights = None if weight is None else weight(df["df"].to_numpy())
    known = asked.join(F.broadcast(spark.createDataFrame(pa.table({"token": tokens}))), "token", "left_semi").select("query_id", "token", F.col("times").cast("double"), F.col("n").cast("long"))
    often = df["df"].to_numpy() >= OFTEN * max(df["df"].to_numpy().max(initial=0), 1)
    n, q = asked.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    blocks = max(1, -(-n // MOST_ASKED), -(-q * k // PLACES))
    qtype, dtype = asked.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    weighted = "x" in docs.columns
    rows = docs.select("doc_id", "w", *["x"] * weighted)
    tasks = max(1, spark.sparkContext.defaultParallelism)
    gain = gain or (lambda tf, length: (tf > 0).astype(float))

    def against(block: int) -> DataFrame:
        few = known.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else known
        sent = spark.sparkContext.broadcast(Asked(few.toArrow(), tokens, weights, least, often))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            lists = Lists(sent.value, k, gain)
            held, n, words = [], 0, 0

            def flush() -> None:
                if held:
                    ids, code, amount, sizes, length = ([x[i] for x in held] for i in range(5))
                    lists.chunk(pa.concat_arrays(ids), *map(np.concatenate, (code, amount, sizes, length)))
                    held.clear()

            for b in batches:
                w = b.column(1)
                sizes = np.nan_to_num(pa.compute.list_value_length(w).to_numpy(zero_copy_only=False)).astype(np.int64)
                code = pa.compute.fill_null(pa.compute.index_in(pa.compute.list_flatten(w), value_set=sent.value.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                amount = pa.compute.list_flatten(b.column(2)).to_numpy(zero_copy_only=False) if weighted else np.ones(len(code))
                length = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=amount, minlength=len(sizes))
                use = code >= 0
                sizes_used = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[use], minlength=len(sizes))
                held.append((b.column(0), code[use], amount[use], sizes_used, length))
                n, words = n + b.num_rows, words + int(sizes_used.sum())
                if n >= CHUNK or words >= CHUNK_WORDS:
                    flush()
                    n = words = 0
            flush()
            out = list(lists.parts()) if lists.ids is not None else []
            for part, data in out:
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

        def merge(t: pa.Table) -> pa.Table:
            import numpy as np

            a, part = sent.value, t["part"][0].as_py()
            rows = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in t["data"].to_pylist()]).combine_chunks()
            order = pa.compute.sort_indices(rows, sort_keys=[("q", "ascending"), ("s", "descending"), ("d", "ascending")])
            rows = rows.take(order)
            q = rows["q"].to_numpy().astype(np.int64)
            first = np.append(0, np.flatnonzero(q[1:] != q[:-1]) + 1)
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            rows, q, rank = rows.filter(pa.array(rank < k)), q[rank < k] + part * PART, rank[rank < k]
            times = a.member_ptr[q + 1] - a.member_ptr[q]
            take = pa.array(np.repeat(np.arange(len(q)), times))
            who = pa.array(_spread(a.member_ptr[q], times))
            col = lambda name: rows[name].combine_chunks().take(take)
            score = np.repeat(rows["s"].to_numpy() / MICRO, times)
            out = pa.table({"query_id": a.ids.take(who), "doc_id": col("d"), "score": pa.array(score), "rank": pa.array(np.repeat(rank + 1, times).astype(np.int32)), "met": col("m").cast(pa.int32()), "n": pa.array(np.repeat(a.size[q].astype(np.int32), times))})
            return then[0](out) if then else out

        found = rows.coalesce(tasks).mapInArrow(run, "part int, data binary")
        return found.groupBy("part").applyInArrow(merge, then[1] if then else f"query_id {qtype}, doc_id {dtype}, score double, rank int, met int, n int")

    return reduce(DataFrame.unionByName, map(against, range(blocks)))
