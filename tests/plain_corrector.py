"""One read at a time in plain Python, to compare the Spark plan with."""

from itertools import product

BASES = "ACGT"
PATHS, FAILS, WINDOW, MARGIN = 74, 2, 4, 10


def complement(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


class Plain:
    def __init__(self, solid, k, cutoff, xlow, extension=5):
        self.known, self.k, self.cutoff, self.xlow, self.ext = solid, k, cutoff, xlow, extension

    def solid(self, kmer):
        return min(kmer, complement(kmer)) in self.known

    # regions: lists [first, last, ofirst, olast]
    def regions(self, seq, q):
        k, n = self.k, len(seq)
        low = [p for p in range(n) if q[p] < self.cutoff]
        runs, at = [], None
        for i in range(n - k + 2):
            good = i <= n - k and self.solid(seq[i:i + k])
            if good and at is None:
                at = i
            if not good and at is not None:
                runs.append([at, i - 1, at, i - 1])
                at = None

        def cut(r, least, with_tail):
            inside = [p for p in low if r[0] <= p < r[1] + k]
            if not inside:
                return [list(r)] if with_tail else []
            out, start = [], r[0]
            for p in inside:
                if p - k - start + 1 >= least:
                    out.append([start, p - k, r[2], r[3]])
                start = p + 1
            if with_tail and r[1] >= inside[-1] + k:
                out.append([start, r[1], r[2], r[3]])
            return out

        if len(runs) > 1:
            if any(b[0] - a[1] < k for a, b in zip(runs, runs[1:])):
                runs = [x for r in runs for x in cut(r, 1, True)]
        elif runs and not (runs[0][0] == 0 and runs[0][1] == n - k):
            runs = cut(runs[0], 2, False) or runs
        runs = [r for r in runs if r[1] > r[0]]
        merged = []
        for r in runs:
            if merged and r[0] - merged[-1][1] < 3:
                merged[-1][1] = r[1]
            else:
                merged.append(list(r))
        runs = merged
        for a, b in zip(runs, runs[1:]):
            if b[0] - a[1] - 1 == k - 1:
                if b[1] - b[0] + 1 > 1:
                    b[0] += 1
                if a[1] - a[0] + 1 > 1:
                    a[1] -= 1
        if len(runs) == 2:
            a, b = runs
            if b[0] - a[1] < k + 1:
                if a[0] == 0:
                    runs = [a]
                elif b[1] == n - k and b[1] - b[0] + 1 >= n * 0.1 and a[1] - a[0] + 1 < n * 0.1:
                    runs = [[b[0], b[1], a[2], a[3]]]

        def bad(p):
            return q[p] < self.cutoff

        for j, r in enumerate(runs):
            final = j == len(runs) - 1
            if r[1] - r[0] > 4 and (not final or r[1] < n - k):
                for e in range(r[1], r[1] - 4, -1):
                    if bad(e + k - 1) or (not final and bad(e)):
                        r[1] = e - 1
                        break
        if runs and runs[0][0] > 0 and runs[0][1] - runs[0][0] > 4:
            for e in range(runs[0][0], runs[0][0] + 4):
                if bad(e + k - 1):
                    runs[0][0] = e + 1
                    break
        return runs

    # walks: None when there are too many
    def walks(self, ctx, own, forced):
        out = []

        def go(done):
            if len(out) > PATHS:
                return
            if len(done) == len(own):
                out.append(done)
                return
            tail = (ctx + done)[-(self.k - 1):]
            mine = own[len(done)]
            if not forced[len(done)] and self.solid(tail + mine):
                options = [mine]
            else:
                options = [b for b in BASES if (forced[len(done)] or b != mine)
                           and self.solid(tail + b)]
            for b in options:
                go(done + b)

        go("")
        return None if len(out) > PATHS else out

    def extends(self, ctx, steps):
        return steps == 0 or any(
            self.solid(ctx + b) and self.extends((ctx + b)[1:], steps - 1) for b in BASES)

    def ends_well(self, seq_after, last, n):
        return last <= n - self.k or self.extends(
            seq_after[-(self.k - 1):], min(self.ext, self.k - (n - last)))

    def correct(self, seq, q, top, check):
        k, n = self.k, len(seq)
        regions = self.regions(seq, q)
        short = any(regions[i][0] - regions[i - 1][1] <= k for i in range(1, len(regions) - 1))
        state = {"t5": 0, "t3": 0, "edits": {}, "n": 0}
        if regions and not short:
            self.by_region(seq, q, regions, state, top, check)
        else:
            self.whole(seq, q, regions, state, top, check)
        return state["edits"], state["n"], state["t5"], state["t3"]

    def apply(self, state, edits):
        for p, b in edits:
            state["edits"][p] = b
            state["n"] += 1

    def choose(self, lists, q, state, top, check, n, crowd, partial, always=False, near5=False):
        """`crowd(list)` gives the index where too many edits follow another."""
        if not lists:
            return
        if len(lists) == 1:
            best, runner = lists[0], None
        else:
            sums = [sum(q[p] for p, _ in lst) for lst in lists]
            low = min(sums)
            best = lists[max(i for i, s in enumerate(sums) if s == low)]
            runner = sorted(sums)[1] - low
        j = crowd(best)
        cut3 = cut5 = False
        if j is not None:
            p = best[j][0]
            for side in ((5, 3) if near5 else (3, 5)):
                if side == 3 and n - p <= top:
                    state["t3"], cut3 = n - p, True
                    break
                if side == 5 and p + 1 <= top:
                    state["t5"], cut5 = p + 1, True
                    break
        if len(lists) == 1:
            if j is None:
                self.apply(state, best)
            elif partial and near5:
                self.apply(state, best[j + 2:] if cut5 else best[:j] if cut3 else [])
            elif partial:
                self.apply(state, best[:max(j - 1, 0)] if cut3 else best[j + 1:] if cut5 else [])
            return
        if j is None and runner >= MARGIN:
            self.apply(state, best)
            return
        common = [e for e in lists[0] if all(e in lst for lst in lists)]
        disputed = sorted({p for lst in lists for p, _ in lst} - {p for p, _ in common})
        lo, hi = 0, len(disputed) - 1
        while lo <= hi:
            left, right = disputed[lo] + 1, n - disputed[hi]
            if left < right:
                if left + state["t3"] > top:
                    break
                if left > state["t5"] or always:
                    state["t5"] = left
                lo += 1
            else:
                if right > top:
                    break
                if right > state["t3"] or always:
                    state["t3"] = right
                hi -= 1
        self.apply(state, [e for e in common if state["t5"] <= e[0] < n - state["t3"]])

    def by_region(self, seq, q, regions, state, top, check):
        k, n = self.k, len(seq)

        def forward(best):
            if len(best) > WINDOW:
                for j in range(len(best) - WINDOW):
                    if best[j + WINDOW][0] - best[j][0] < check:
                        return j

        def backward(best):
            for j in range(len(best) - 1, WINDOW - 1, -1):
                if best[j][0] - best[j - WINDOW][0] < check:
                    return j

        for a, b in zip(regions, regions[1:]):
            s, e = a[1] + 1, b[0] - 1
            if e - s + 1 < k or not (a[1] + k < n - state["t3"] and b[0] > state["t5"]):
                continue
            p0 = s + k - 1
            span = range(p0, e + 1)
            forced = [p == p0 or p - k + 1 in (a[3] - 1, b[2] - 1) or q[p] <= self.xlow
                      for p in span]
            found = self.walks(seq[s:p0], seq[p0:e + 1], forced) or []
            lists = [[(p, w) for p, w in zip(span, walk) if seq[p] != w] for walk in found]
            if any(not lst for lst in lists):
                continue
            good = []
            for lst in lists:
                new = list(seq)
                for p, w in lst:
                    new[p] = w
                new = "".join(new)
                weak = sum(not self.solid(new[i:i + k]) for i in range(e - k + 1, lst[-1][0] + 1))
                if lst[-1][0] <= e - k + 1 or weak <= FAILS:
                    good.append(lst)
            if not good:
                for side, size in ((3, n - p0), (5, e + 1), (3, n - (a[3] - 1 + k - 1)),
                                   (5, b[2])):
                    if size <= top:
                        state["t3" if side == 3 else "t5"] = size
                        break
                continue
            left_long = s - a[0] > WINDOW
            right_long = b[1] - e + 2 > WINDOW

            def crowd(best):
                if len(regions) != 2 or len(best) <= WINDOW:
                    return None
                if left_long and not right_long and best[-1][0] - k - s + 2 >= check:
                    return backward(best)
                if right_long and not left_long and e - best[0][0] + 1 >= check:
                    return forward(best)

            self.choose(good, q, state, top, check, n, crowd, not right_long)
        first, last = regions[0], regions[-1]
        if first[0] > 0 and first[0] > state["t5"]:
            s = first[0] - 1
            rc = complement(seq)
            span = range(s, -1, -1)
            forced = [p == s or p == first[2] - 1 or q[p] <= self.xlow for p in span]
            found = self.walks(rc[n - s - k:n - 1 - s], rc[n - 1 - s:], forced) or []
            base = rc[:n - 1 - s]
            found.sort(key=complement_order)
            pairs = [([(p, complement(w)) for p, w in zip(span, walk) if seq[p] != complement(w)],
                      base + walk) for walk in found]
            if all(lst for lst, _ in pairs):
                good = [sorted(lst) for lst, after in pairs
                        if self.ends_well(after, n - 1 - min(lst)[0], n)]
                self.choose(good, q, state, top, check, n,
                            lambda best: backward(best) if best[-1][0] + 1 >= check else None,
                            True, near5=True)
        if last[1] < n - k and last[1] + k < n - state["t3"]:
            s = last[1] + 1
            p0 = s + k - 1
            span = range(p0, n)
            forced = [p == p0 or p - k + 1 == last[3] + 1 or q[p] <= self.xlow for p in span]
            found = self.walks(seq[s:p0], seq[p0:], forced) or []
            pairs = [([(p, w) for p, w in zip(span, walk) if seq[p] != w], seq[:p0] + walk)
                     for walk in found]
            if all(lst for lst, _ in pairs):
                good = [lst for lst, after in pairs if self.ends_well(after, lst[-1][0], n)]
                self.choose(good, q, state, top, check, n,
                            lambda best: forward(best) if n - best[0][0] >= check else None, True)
        if not state["n"] and not state["t5"] and not state["t3"]:
            self.to_regions(regions, state, top, n)

    def to_regions(self, regions, state, top, n):
        state["t5"] = regions[0][0]
        for r in regions:
            if state["t5"] + n - self.k - r[1] <= top:
                state["t3"] = n - self.k - r[1]
                break

    def whole(self, seq, q, regions, state, top, check):
        k, n = self.k, len(seq)
        low = [p for p in range(k) if q[p] < self.cutoff]
        worst = sorted(range(k), key=lambda p: (q[p], p))[:3]

        def variant(edits):
            s = list(seq[:k])
            for p, b in edits:
                s[p] = b
            return "".join(s)

        def combos(spots):
            for letters in product(BASES, repeat=len(spots)):
                yield sorted((p, b) for p, b in zip(spots, letters) if seq[p] != b)

        singles = [[(p, b)] for p in range(k) for b in BASES if b != seq[p]]

        def keep(lists):
            return [e for e in lists if self.solid(variant(e))]

        if not low:
            candidates = [[]] if self.solid(seq[:k]) else keep(list(combos(worst)) + singles)
        elif len(low) <= 3:
            candidates = keep(combos(low)) or keep(singles)
        else:
            candidates = keep(list(combos(worst)) + singles + [[]])
        lists = []
        for edits in candidates if n > k else []:
            start = variant(edits)
            if edits and edits[0][0] < k - 1 and not self.extends(
                    complement(start[:k - 1]), min(self.ext, k - 1 - edits[0][0])):
                continue
            forced = [p > k and q[p] <= self.xlow for p in range(k, n)]
            found = self.walks(start[1:], seq[k:], forced)
            if found is None:
                lists = []
                break
            for walk in found:
                lst = edits + [(p, w) for p, w in zip(range(k, n), walk) if seq[p] != w]
                if lst and self.ends_well(start + walk, lst[-1][0], n):
                    lists.append(lst)

        def crowd(best):
            if len(best) > WINDOW and n - best[0][0] >= check:
                for j in range(len(best) - WINDOW):
                    if best[j + WINDOW][0] - best[j][0] < check:
                        return j

        if lists:
            self.choose(lists, q, state, top, check, n, crowd, True, always=True)
        elif regions:
            self.to_regions(regions, state, top, n)
        elif k < top:
            state["t5"] = k


def complement_order(walk):
    return walk.translate(str.maketrans("ACGT", "TGCA"))


def correct_all(rows, solid, k, offset, cutoff, xlow):
    """rows (id, seq, qual) to {id: (seq, qual, n_edits, t5, t3, rejected)}."""
    plain, out = Plain(solid, k, cutoff, xlow), {}
    for rid, raw, qual in rows:
        up = raw.upper()
        n_odd = sum(c not in BASES for c in up)
        seq = "".join(c if c in BASES else "A" for c in up)
        n = len(seq)
        top = 0 if n <= 30 else min(n * 60 // 100, n - 30)
        edits, count, t5, t3 = {}, 0, 0, 0
        if n_odd <= n * 10 // 100 and n >= k:
            q = [ord(c) - offset for c in qual]
            edits, count, t5, t3 = plain.correct(seq, q, top, n * 7 // 100)
        if t5 + t3 > top:
            t5, t3 = (0, t3) if t3 <= top else (t5, 0) if t5 <= top else (0, top)
        rejected = count * 4 > n
        if not rejected:
            new = "".join(edits.get(p, b) for p, b in enumerate(seq))
            seq, qual = new[t5:n - t3], qual[t5:n - t3]
        out[rid] = (seq, qual, count, t5, t3, rejected)
    return out
