"""Scores of ``text.fuzzy_score`` for very many pairs of texts at once, the same to the last digit, in arrays.

Words are compared once for all pairs. Upper bounds of a phrase's ratio are taken in turn: by lengths, by the bag of letters, by the
longest common subsequence (matching blocks are one). What is left gets its matching blocks as SequenceMatcher finds them, for all
pairs side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

#: Pairs and letters of their texts that are compared at once; letters told apart by the bounds; cells of a matrix of runs; windows compared at once; letters from which SequenceMatcher leaves out popular ones.
PAIRS, LETTERS, KINDS, CELLS, WINDOWS, AUTOJUNK = 32_768, 500_000, 64, 200_000, 16_384, 200


def fuzzy_scores(queries: Sequence[str], texts: Sequence[str], q, t, least: float = 0.0):
    """The scores of the pairs (queries[q], texts[t]) of normalized texts; where one is below ``least``, any number below it."""
    import numpy as np

    q, t = np.asarray(q, np.int64), np.asarray(t, np.int64)
    size = np.array([len(x) + 1 for x in texts] or [0], np.int64)
    out = np.empty(len(q))
    x = 0
    while x < len(q):
        y = min(x + PAIRS, len(q))
        while y - x > 1 and size[np.unique(t[x:y])].sum() > LETTERS:
            y = x + (y - x) // 2
        (few_q, a), (few_t, b) = (np.unique(z[x:y], return_inverse=True) for z in (q, t))
        out[x:y] = _Slice([queries[i] for i in few_q.tolist()], [texts[i] for i in few_t.tolist()]).scores(a, b, least)
        x = y
    return out


class _Slice:
    """Some texts, laid end to end, and the words of each."""

    def __init__(self, queries: list[str], texts: list[str]) -> None:
        import numpy as np

        self.asked, self.held = [x.split() for x in queries], [x.split() for x in texts]
        joined = [" ".join(x) for x in self.held]
        # texts of single spaces, as most are, need not be laid twice
        laid = [*queries, *joined, *(x for x, j in zip(texts, joined) if x != j)]
        ends = np.cumsum([len(x) for x in laid] or [0])
        starts = ends - np.array([len(x) for x in laid] or [0])
        n, m = len(queries), len(texts)
        self.flat = "".join(laid)
        letters, code, often = np.unique(np.frombuffer(self.flat.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True, return_counts=True)
        self.code = code.astype(np.uint8 if len(letters) < 254 else np.uint32)
        rank = np.empty(len(letters), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(letters))
        self.kind = (rank % KINDS)[code]  # letters that share a kind make bounds higher only
        self.q0, self.q1 = starts[:n], ends[:n]
        self.j0 = starts[n : n + m]
        self.w0, self.w1 = self.j0.copy(), ends[n : n + m].copy()
        other = np.flatnonzero([x != j for x, j in zip(texts, joined)])
        self.w0[other], self.w1[other] = starts[n + m :][: len(other)], ends[n + m :][: len(other)]
        # where words begin, of all joined texts
        self.words = np.array([len(x) for x in self.held], np.int64)
        self.first = np.cumsum(self.words) - self.words
        length = np.array([len(w) for x in self.held for w in x], np.int64)
        total = np.cumsum(length + 1) - length - 1
        base = total[np.minimum(self.first, max(len(total) - 1, 0))] if len(total) else np.zeros(m, np.int64)
        self.begin = total + np.repeat(self.j0 - base, self.words)
        self.end = self.begin + length
        # bags of letters: of queries, and of all words (and the space behind) before each word; texts that are laid again are one word
        self.bags = np.bincount(np.repeat(np.arange(n), ends[:n] - starts[:n]) * KINDS + self.kind[: self.j0[0] if m else len(code)], minlength=n * KINDS).reshape(n, KINDS).astype(np.uint16)
        self.again = np.full(m, -1, np.int64)
        self.again[other] = len(self.begin) + np.arange(len(other))
        edges = np.concatenate([self.begin, starts[n + m :], [len(code)]])
        after = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        bags = np.bincount(after * KINDS + self.kind[edges[0] :], minlength=(len(edges) - 1) * KINDS).astype(np.uint16).reshape(-1, KINDS)
        # these may wrap around: only differences count
        self.before = np.concatenate([np.zeros((1, KINDS), np.uint16), np.cumsum(bags, axis=0, dtype=np.uint16)])

    def scores(self, q, t, least: float):
        import numpy as np

        held = 0.55 * self._containment(q, t)
        # what the phrase must give; a little less, as scores are rounded before they are compared
        need = (least - held) / 0.45 - 1e-5
        phrase = np.zeros(len(q))
        some = np.flatnonzero(need < 1)
        phrase[some] = self._phrases(q[some], t[some], np.maximum(need[some], 0.0))
        return held + 0.45 * phrase

    def _containment(self, q, t):
        """See ``text.token_containment``."""
        import numpy as np

        count = np.array([len(x) for x in self.asked], np.int64)
        wanted = {w: i for i, w in enumerate(dict.fromkeys(w for x in self.asked for w in x))}
        known = {w: i for i, w in enumerate(dict.fromkeys(w for x in self.held for w in x))}
        if not wanted or not known:
            return np.zeros(len(q))
        inside = np.zeros((len(known), len(self.held)), bool)
        inside[[known[w] for x in self.held for w in x], np.repeat(np.arange(len(self.held)), self.words)] = True
        near: dict[int, list[int]] = {}
        for w, x in _near(list(wanted), list(known)):
            near.setdefault(w, []).append(x)
        rows = np.zeros((len(near) + 1, len(self.held)), bool)  # the last for words that no text has
        row = np.full(len(wanted), len(near), np.int64)
        for i, (w, xs) in enumerate(near.items()):
            row[w] = i
            np.any(inside[xs], axis=0, out=rows[i])
        first = np.cumsum(count) - count
        place = row[np.array([wanted[w] for x in self.asked for w in x], np.int64)]
        # only words that some text has need be looked up
        own, of = np.flatnonzero(place < len(near)), np.repeat(np.arange(len(count)), count)
        per = np.bincount(of[own], minlength=len(count))
        place, first = place[own], np.cumsum(per) - per
        n = per[q]
        hit = rows[place[_spread(first[q], n)], np.repeat(t, n)]
        met = np.bincount(np.repeat(np.arange(len(q)), n)[hit], minlength=len(q))
        return met / np.maximum(count[q], 1)

    def _phrases(self, q, t, need):
        """See ``text.phrase_ratio``."""
        import numpy as np

        asked = np.array([len(x) for x in self.asked], np.int64)[q]
        left: list = []
        windows = np.where((asked > 0) & (self.words[t] > 0), np.maximum(self.words[t] - asked + 1, 1), 0)
        ends = np.cumsum(windows)
        x = 0
        while x < len(q):
            y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + WINDOWS, "right")))
            n = windows[x:y]
            pair = np.repeat(np.arange(x, y), n)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            whole = self.words[t[pair]] <= asked[pair]
            again = self.again[t[pair]]
            s0 = np.where(whole & (again >= 0), again, self.first[t[pair]] + at)
            s1 = np.where(whole, np.where(again >= 0, again + 1, self.first[t[pair]] + self.words[t[pair]]), s0 + asked[pair])
            w0 = np.where(whole, self.w0[t[pair]], self.begin[np.minimum(s0, len(self.begin) - 1)])
            w1 = np.where(whole, self.w1[t[pair]], self.end[np.minimum(s1, len(self.end)) - 1])
            left.append(self._bounded(pair, q[pair], s0, s1, w0, w1, need[pair]))
            x = y
        best = np.zeros(len(q))
        if not left:
            return best
        # the window of the highest bound comes first, others only where they can give more
        pair, w0, w1, most = (np.concatenate(z) for z in zip(*left))
        order = np.lexsort((-most, pair))
        pair, w0, w1, most = (z[order] for z in (pair, w0, w1, most))
        first = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
        for some in (np.flatnonzero(first), np.flatnonzero(~first)):
            some = some[most[some] > best[pair[some]]]
            least = np.maximum(need[pair[some]], best[pair[some]])
            ratio = self._exact(q[pair[some]], w0[some], w1[some], least)
            good = ratio > least
            np.maximum.at(best, pair[some][good], ratio[good])
        return best

    def _bounded(self, pair, q, s0, s1, w0, w1, need):
        """Pairs and windows (words s0 to s1, letters w0 to w1) whose ratio may be above ``need``, and what it is at most."""
        for bound in (self._shorter, self._bag, self._subsequence):
            most = 2.0 * bound(q, s0, s1, w0, w1) / (self.q1[q] - self.q0[q] + w1 - w0)
            keep = most > need
            pair, q, s0, s1, w0, w1, need, most = (z[keep] for z in (pair, q, s0, s1, w0, w1, need, most))
        return pair, w0, w1, most

    def _exact(self, q, w0, w1, least):
        """The ratios of queries and windows; where one isn't above ``least``, it may be given as less."""
        import numpy as np

        both = self.q1[q] - self.q0[q] + w1 - w0
        enough = np.floor(least * both / 2 - 1e-9).astype(np.int64)
        matched = np.zeros(len(q), np.int64)
        odd = w1 - w0 >= AUTOJUNK
        use = np.flatnonzero(~odd)
        matched[use] = self._matched(self.q0[q][use], self.q1[q][use], w0[use], w1[use], enough[use])
        ratio = 2.0 * matched / both
        for i in np.flatnonzero(odd).tolist():
            from difflib import SequenceMatcher

            ratio[i] = SequenceMatcher(None, self.flat[self.q0[q[i]] : self.q1[q[i]]], self.flat[w0[i] : w1[i]]).ratio()
        return ratio

    def _shorter(self, q, s0, s1, w0, w1):
        import numpy as np

        return np.minimum(self.q1[q] - self.q0[q], w1 - w0)

    def _bag(self, q, s0, s1, w0, w1):
        import numpy as np

        out = np.empty(len(q), np.int64)
        for x in range(0, len(q), 2048):
            y = slice(x, x + 2048)
            part = self.before[s1[y]]
            part -= self.before[s0[y]]
            np.minimum(part, self.bags[q[y]], out=part)
            out[y] = part.sum(axis=1, dtype=np.uint16) if len(self.flat) < 65_000 else part.sum(axis=1)
        return out

    def _subsequence(self, q, s0, s1, w0, w1):
        """Length of the longest common subsequence by bits (a query's letters), letter by letter of all windows."""
        import numpy as np

        size = self.q1 - self.q0
        deep = int(-(-size.max(initial=1) // 64))
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        masks = np.zeros((deep, len(size) * KINDS), np.uint64)
        np.add.at(masks, (at // 64, row * KINDS + self.kind[_spread(self.q0, size)]), np.uint64(1) << (at % 64).astype(np.uint64))
        order = np.argsort(w0 - w1, kind="stable")
        start, base, length = w0[order], q[order] * KINDS, (w1 - w0)[order]
        v = np.full((deep, len(order)), np.uint64(0xFFFFFFFFFFFFFFFF))
        left = np.searchsorted(-length, -np.arange(length.max(initial=0)), "left")  # windows longer than so many letters
        for i, n in enumerate(left.tolist()):
            to = base[:n] + self.kind[start[:n] + i]
            carry = None
            for d in range(deep):
                now, m = v[d, :n], masks[d].take(to)
                u = now & m
                total = now + u
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                np.bitwise_and(now, ~m, out=now)
                now |= total
                carry = over.astype(np.uint64)
        out = np.empty(len(order), np.int64)
        out[order] = deep * 64 - np.bitwise_count(v).sum(axis=0, dtype=np.int64)
        return out

    def _matched(self, a0, a1, b0, b1, enough):
        """Letters in the matching blocks of a and b, as SequenceMatcher finds them; of pairs that can't have more than ``enough``, some of them."""
        import numpy as np

        total = np.zeros(len(a0), np.int64)
        owner = np.arange(len(a0))
        while len(owner):
            most = total + np.bincount(owner, np.minimum(a1 - a0, b1 - b0), len(total)).astype(np.int64)
            keep = most[owner] > enough[owner]
            owner, a0, a1, b0, b1 = (z[keep] for z in (owner, a0, a1, b0, b1))
            if not len(owner):
                break
            i, j, k = self._longest(a0, a1, b0, b1)
            total += np.bincount(owner, k, len(total)).astype(np.int64)
            owner, a0, a1, b0, b1 = (np.concatenate(z) for z in ((owner, owner), (a0, i + k), (i, a1), (b0, j + k), (j, b1)))
            keep = np.tile(k > 0, 2) & (a1 > a0) & (b1 > b0)
            owner, a0, a1, b0, b1 = (z[keep] for z in (owner, a0, a1, b0, b1))
        return total

    def _longest(self, a0, a1, b0, b1):
        """(i, j, k): the longest run of letters that a and b share, the first in a, then the first in b."""
        import numpy as np

        la, lb = a1 - a0, b1 - b0
        order = np.lexsort((la, lb // 8))
        last, long = np.zeros(len(a0), np.int64), np.zeros(len(a0), np.uint8)
        x = 0
        while x < len(order):
            # as many as keep the matrix small, none of them much shorter than the others
            y = min(len(order), x + max(1, CELLS // int(lb[order[x]] + 8)))
            y = x + int(np.searchsorted(lb[order[x:y]] // 8, lb[order[x]] // 8 + (1 if y - x > 4096 else 4), "left"))
            some = order[x:y]
            high, wide = int(la[some].max()), int(lb[some].max())
            up, across = np.arange(high)[:, None], np.arange(wide)[:, None]
            a = self.code[np.minimum(a0[some] + up, len(self.code) - 1)]
            b = self.code[np.minimum(b0[some] + across, len(self.code) - 1)]
            a[up >= la[some]], b[across >= lb[some]] = 254 if a.dtype == np.uint8 else 1 << 30, 255 if a.dtype == np.uint8 else 1 << 31
            runs, more, same = np.zeros((wide + 1, len(some)), np.uint8), np.empty((wide, len(some)), np.uint8), np.empty((wide, len(some)), bool)
            best, at = np.zeros(len(some), np.uint8), np.zeros(len(some), np.int64)
            top = np.empty(len(some), np.uint8)
            for i in range(high):
                np.equal(b, a[i], out=same)
                np.add(runs[:-1], 1, out=more)
                np.negative(same.view(np.uint8), out=runs[1:])
                runs[1:] &= more
                np.max(runs, axis=0, out=top)
                at[top > best] = i
                np.maximum(best, top, out=best)
            last[some], long[some] = at, best
            x = y
        k = long.astype(np.int64)
        i = a0 + np.where(k > 0, last - k + 1, 0)
        flat = self.flat
        j = np.array([flat.find(flat[x : x + n], y, z) for x, n, y, z in zip(i.tolist(), k.tolist(), b0.tolist(), b1.tolist())], np.int64)
        return i, j, k


def _near(wanted: list[str], known: list[str], ratio: float = 0.8) -> list[tuple[int, int]]:
    """The pairs of words that are equal or match nearly: those whose bags of letters allow it are compared."""
    import numpy as np

    from .text import alike

    places = {w: i for i, w in enumerate(known)}
    found = [(i, places[w]) for i, w in enumerate(wanted) if w in places]
    # a letter and which of its kind it is in the word: what two words share of these is the sum of the lesser numbers of each letter
    marks = {}
    bags = []
    for words in (wanted, known):
        bag = np.zeros((len(words), 2 * KINDS), np.float32)
        for i, w in enumerate(words):
            seen: dict[str, int] = {}
            for c in w:
                seen[c] = seen.get(c, 0) + 1
                bag[i, marks.setdefault((c, seen[c]), len(marks)) % (2 * KINDS)] += 1
        bags.append(bag)
    lw, lk = (np.array([len(w) for w in words]) for words in (wanted, known))
    slack = np.maximum(2, lw // 3)
    step = max(1, 4_000_000 // len(wanted))
    for x in range(0, len(known), step):
        both = lw[:, None] + lk[None, x : x + step]
        may = (2.0 * (bags[0] @ bags[1][x : x + step].T) >= (ratio - 1e-6) * both) & (np.abs(2 * lw[:, None] - both) <= slack[:, None])
        for w, k in zip(*(z.tolist() for z in np.nonzero(may))):
            if wanted[w] != known[x + k] and alike(wanted[w], known[x + k], ratio):
                found.append((w, x + k))
    return found


def _spread(starts, sizes):
    """Positions of runs laid end to end."""
    import numpy as np

    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
