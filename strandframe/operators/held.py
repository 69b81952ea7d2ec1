"""Rounds of merges over vectors that every task holds.

The vectors go to the tasks once.  A round sends the merges of the round before and the clusters whose
nearest one is not known; the distances of these to all others are made in tiles, and their ``LIST`` nearest
ones come back with a bound below which no other cluster can be.  A merged cluster is not nearer to a third
one than its parts were, so a list and its bound hold until they are used up, whatever merges in the meantime.

A search takes single precision, less what rounding can add: its distances are bounds from below.  Those that
decide are made again in double precision, and a search too where single precision tells too little.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np

from strandframe.operators.distance import unit_rows

LIST = 16
ROWS, COLUMNS = 256, 2_048  # a tile
PLANES = 32  # sizes up to this go member by member, larger clusters one after another
SMALL = 40_000_000  # distances that are not worth a job
PART = 512  # members of one cluster in a task
UNIT = 2.0**-24  # rounding of single precision
SUMS = 1 - 2.0**-15  # of sums in single precision, which have less than 300 terms one after another


# ------------------------------------------------------------- distances as products
def prepared(x: np.ndarray, metric: str) -> np.ndarray:
    """Left sides; with ``turned`` right sides their product is the distance, or its square (euclidean)."""
    one = np.ones((len(x), 1))
    if metric in ("correlation", "cosine"):
        return np.hstack([unit_rows(x, metric), one])
    if metric == "euclidean":
        return np.hstack([x, (x * x).sum(1, keepdims=True), one])
    if metric == "cityblock":
        return x
    raise ValueError(metric)


def turned(a: np.ndarray, metric: str) -> np.ndarray:
    if metric in ("correlation", "cosine"):
        return np.hstack([-a[:, :-1], a[:, -1:]])
    if metric == "euclidean":
        return np.hstack([-2 * a[:, :-2], a[:, -1:], a[:, -2:-1]])
    return a


def tile(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of prepared rows to turned ones."""
    if metric == "cityblock":
        d = np.zeros((len(a), len(b)))
        for i in range(a.shape[1]):
            d += np.abs(a[:, i, None] - b[None, :, i])
        return d
    d = a @ b.T
    if metric == "euclidean":
        np.sqrt(np.maximum(d, 0, out=d), out=d)
    return d


def lowered(a: np.ndarray, metric: str, center: np.ndarray) -> np.ndarray:
    """Prepared rows in single precision: products with ``turned`` ones are not over the distances."""
    less = 1 - 2 * (a.shape[1] + 6) * UNIT
    if metric == "euclidean":
        x = a[:, :-2] - center
        return np.hstack([x, less * (x * x).sum(1, keepdims=True), a[:, -1:]]).astype(np.float32)
    out = a.astype(np.float32)
    out[:, -1] = less
    return out


# ------------------------------------------------------------- clusters of a task or the driver
class Clusters:
    """Clusters of prepared rows after some rounds; a cluster is named by its first row.

    ``bounds`` are the first rows of the groups and the number of rows.  With ``mean`` a cluster is the mean
    of its rows, else all of them.
    """

    def __init__(self, rows: np.ndarray, bounds: np.ndarray, metric: str, linkage: str):
        self.rows, self.bounds, self.metric, self.linkage = rows, bounds, metric, linkage
        self.mean = linkage == "average" and metric in ("correlation", "cosine")
        self.put = np.maximum if linkage == "complete" else np.add
        self.sum = rows.copy() if self.mean else rows
        self.label, self.size = np.arange(len(rows)), np.ones(len(rows), np.int64)
        self.done, self.known = 0, {}
        self.center = rows[:, :-2].mean(0) if metric == "euclidean" else np.zeros(0)
        self.fast = metric != "cityblock" and float(np.abs(rows).max(initial=0)) < 1e15
        self.low = lowered(rows, metric, self.center) if self.fast and not self.mean else None

    def follow(self, rounds: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Rounds of merges ``(i, j)``, a cluster once a round; those that were done before are left out."""
        for i, j in rounds[self.done :]:
            if self.mean:
                self.sum[i] += self.sum[j]
            to = np.arange(len(self.label))
            to[j] = i
            self.label = to[self.label]
            self.size[i] += self.size[j]
            self.size[j] = 0
            self.known = {}
        self.done = len(rounds)

    def means(self, names: np.ndarray) -> np.ndarray:
        return self.sum[names] / self.size[names, None]

    def left(self, idx: np.ndarray, fast: bool) -> np.ndarray:
        """Left sides of members."""
        if not self.mean:
            return (self.low if fast else self.rows)[idx]
        return lowered(self.means(idx), self.metric, self.center) if fast else self.means(idx)

    def side(self, g: int, hidden: np.ndarray, fast: bool = False) -> dict:
        """Clusters of a group without the hidden ones: names, members one cluster after another, right sides in pieces."""
        lo, hi = self.bounds[g], self.bounds[g + 1]
        key = g, fast, int(hidden[lo:hi].sum())  # more are hidden between two rounds, none comes back
        if key in self.known:
            return self.known[key]
        label = self.label[lo:hi]
        if self.mean:
            names = lo + np.flatnonzero((label == np.arange(lo, hi)) & ~hidden[lo:hi])
            members, first, count = names, np.arange(len(names)), np.ones(len(names), np.int64)
        else:
            members = lo + np.lexsort((label, self.size[label]))
            members = members[~hidden[self.label[members]]]
            owner = self.label[members]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
            names = owner[first]
            count = np.diff(np.r_[first, len(owner)])
        where = np.full(hi - lo, -1)
        where[names - lo] = np.arange(len(names))
        out = {"names": names, "members": members, "first": first, "count": count, "where": where, "lo": lo, "fast": fast, "pieces": []}
        self.known = {key: out}  # one group at a time
        at = 0
        while at < len(names):
            size = count[at]
            to = int(np.searchsorted(count, size, "right"))
            if size <= PLANES and to - at >= PLANES:
                for c in range(at, to, COLUMNS):
                    e = min(c + COLUMNS, to)
                    idx = members[first[c] : first[c] + (e - c) * size].reshape(e - c, size)
                    out["pieces"].append((c, e, [turned(self.left(idx[:, p], fast), self.metric) for p in range(size)], None))
                at = to
                continue
            # few clusters of a size: some clusters one after another, or a large one alone
            e = at + 1
            while e < len(names) and first[e] + count[e] - first[at] <= COLUMNS:
                e += 1
            stop = first[e - 1] + count[e - 1]
            cuts = [turned(self.left(members[c : min(c + COLUMNS, stop)], fast), self.metric) for c in range(first[at], stop, COLUMNS)]
            out["pieces"].append((at, e, cuts, first[at:e] - first[at]))
            at = e
        return out

    def _against(self, x: np.ndarray, piece) -> np.ndarray:
        """Largest distances or sums of distances of left sides to the clusters of a piece."""
        _, _, planes, starts = piece
        if starts is not None and len(planes) == 1:
            return self.put.reduceat(tile(x, planes[0], self.metric).astype(float, copy=False), starts, axis=1).astype(x.dtype, copy=False)
        acc = None
        for p in planes:
            d = tile(x, p, self.metric)
            if starts is not None:
                d = self.put.reduce(d.astype(float, copy=False), axis=1, keepdims=True)
            acc = d if acc is None else self.put(acc, d, out=acc)
        return acc.astype(x.dtype, copy=False)

    def values(self, side: dict, todo: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
        """Distances of clusters to those of every piece: which of ``todo``, columns from and to, matrix."""
        at = side["where"][todo - side["lo"]]
        count, first, members = side["count"][at], side["first"][at], side["members"]
        order = np.argsort(count, kind="stable")
        ends = np.cumsum(count[order])
        lo = 0
        while lo < len(order):
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + ROWS, "right")))
            some = order[lo:hi]
            parts, idx = [], []
            sizes = count[some]
            for size in np.unique(sizes):
                of = some[sizes == size]
                parts.append((size, len(of)))
                idx.append((first[of][None, :] + np.arange(size)[:, None]).ravel())
            idx = members[np.concatenate(idx)]
            x = [self.left(idx[r : r + ROWS], side["fast"]) for r in range(0, len(idx), ROWS)]
            for piece in side["pieces"]:
                if len(x) > 1:  # one large cluster
                    out = None
                    for part in x:
                        v = self.put.reduce(self._against(part, piece), axis=0, keepdims=True).astype(float, copy=False)
                        out = v if out is None else self.put(out, v, out=out)
                else:
                    v, rows, start = self._against(x[0], piece), [], 0
                    for size, n in parts:
                        block = v[start : start + size * n]
                        rows.append(block if size == 1 else self.put.reduce(block.reshape(size, n, -1), axis=0))
                        start += size * n
                    out = rows[0] if len(rows) == 1 else np.concatenate(rows)
                yield some, piece[0], piece[1], out
            lo = hi

    def scaled(self, side: dict, d: np.ndarray, todo: np.ndarray, c: int, e: int) -> np.ndarray:
        """Means out of sums, and no distance of a cluster to itself."""
        at = side["where"][todo - side["lo"]]
        if self.linkage == "average" and not self.mean:
            less = SUMS if side["fast"] else 1
            d = d * (less / side["count"][at]).astype(d.dtype)[:, None] / side["count"][c:e].astype(d.dtype)[None, :]
        own = np.flatnonzero((at >= c) & (at < e))
        d[own, at[own] - c] = np.inf
        return d

    def nearest(self, g: int, todo: np.ndarray, hidden: np.ndarray, threshold: float | None, fast: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names and distances of the ``LIST`` nearest clusters of some, by distance and name, and the bound of the others."""
        side = self.side(g, hidden, fast)
        n = len(todo)
        names, dist = np.full((n, LIST), -1), np.full((n, LIST), np.inf)
        limit = np.inf if threshold is None else threshold
        bound = np.full(n, limit)
        best = _Best()
        before = None
        for some, c, e, d in self.values(side, todo):
            if before is not some:
                if before is not None:
                    best.into(before, names, dist, bound, limit)
                best, before = _Best(len(some), limit), some
            best.add(self.scaled(side, d, todo[some], c, e), side["names"][c:e])
        if before is not None:
            best.into(before, names, dist, bound, limit)
        return names, dist, bound

    def part(self, g: int, name: int, cut: tuple[int, int], hidden: np.ndarray) -> np.ndarray:
        """Sums or largest distances of some members of one cluster to all clusters."""
        side = self.side(g, hidden, self.fast)
        k = side["where"][name - side["lo"]]
        lo, hi = (side["first"][k] + at for at in cut)
        out = None
        for r in range(lo, hi, ROWS):
            x = self.left(side["members"][r : min(r + ROWS, hi)], self.fast)
            v = np.concatenate([self.put.reduce(self._against(x, piece), axis=0) for piece in side["pieces"]]).astype(float, copy=False)
            out = v if out is None else self.put(out, v, out=out)
        return out

    def matrix(self, g: int, todo: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        """Distances of some clusters to all, which stand by name."""
        side = self.side(g, hidden)
        out = np.empty((len(todo), len(side["names"])))
        for some, c, e, d in self.values(side, todo):
            out[some, c:e] = self.scaled(side, d, todo[some], c, e)
        return out[:, np.argsort(side["names"])]

    def between(self, a: np.ndarray, b: np.ndarray, members: dict) -> np.ndarray:
        """Distances of pairs of clusters; ``members`` has the rows of every cluster, one after another."""
        out = np.empty(len(a))
        if self.mean:
            for lo in range(0, len(a), ROWS * ROWS):
                x, y = self.means(a[lo : lo + ROWS * ROWS]), self.means(b[lo : lo + ROWS * ROWS])
                out[lo : lo + ROWS * ROWS] = np.einsum("ij,ij->i", x, turned(y, self.metric))
            return out
        few = self.size[b] <= 8  # too small for a product of its own
        if few.any():
            out[few] = self._element_wise(a[few], b[few], members)
        order = np.flatnonzero(~few)
        order = order[np.argsort(b[order], kind="stable")]
        if not len(order):
            return out
        of = b[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            y = turned(self.rows[members["rows"][members["first"][of[lo]] : members["first"][of[lo]] + self.size[of[lo]]]], self.metric)
            who = a[order[lo:hi]]
            size = self.size[who]
            ends = np.cumsum(size)
            idx = members["rows"][np.repeat(members["first"][who] - ends + size, size) + np.arange(ends[-1])]
            d = np.concatenate([
                self.put.reduce([self.put.reduce(tile(self.rows[idx[r : r + COLUMNS]], y[c : c + COLUMNS], self.metric), axis=1) for c in range(0, len(y), COLUMNS)], axis=0)
                for r in range(0, len(idx), COLUMNS)
            ])
            d = self.put.reduceat(d, ends - size)
            out[order[lo:hi]] = d if self.linkage == "complete" else d / (size * len(y))
        return out

    def _element_wise(self, a: np.ndarray, b: np.ndarray, members: dict) -> np.ndarray:
        found = []
        n = self.size[a] * self.size[b]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(a):
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + ROWS * ROWS, "right")))
            pair = np.repeat(np.arange(lo, hi), n[lo:hi])
            starts = ends[lo:hi] - n[lo:hi] - base
            at = np.arange(len(pair)) - starts[pair - lo]
            x = self.rows[members["rows"][members["first"][a[pair]] + at // self.size[b[pair]]]]
            y = self.rows[members["rows"][members["first"][b[pair]] + at % self.size[b[pair]]]]
            if self.metric == "cityblock":
                d = np.abs(x - y).sum(1)
            else:
                d = np.einsum("ij,ij->i", x, turned(y, self.metric))
                d = np.sqrt(np.maximum(d, 0)) if self.metric == "euclidean" else d
            d = self.put.reduceat(d, starts)
            found.append(d if self.linkage == "complete" else d / n[lo:hi])
            lo = hi
        return np.concatenate(found)

    def by_name(self) -> dict:
        order = np.argsort(self.label, kind="stable")
        first = np.zeros(len(self.label), np.int64)
        first[1:] = np.cumsum(self.size)[:-1]
        return {"rows": order, "first": first}


class _Best:
    """The least ``LIST`` and one more values of some rows, column by column."""

    def __init__(self, n: int = 0, limit: float = np.inf):
        limit = min(limit, float(np.finfo(np.float32).max))
        self.n, self.cap = n, np.full(n, np.nextafter(np.float32(limit), np.float32(np.inf)) if np.float32(limit) < limit else np.float32(limit), np.float64)
        self.row, self.dist, self.name = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.new: list = []
        self.waiting = 0

    def add(self, d: np.ndarray, names: np.ndarray) -> None:
        cap = self.cap
        if not self.waiting and not len(self.row) and d.shape[1] > 4 * LIST:
            cap = np.minimum(cap, np.partition(d, LIST, axis=1)[:, LIST])
        r, c = np.divmod(np.flatnonzero((d <= cap.astype(d.dtype)[:, None]).ravel()), d.shape[1])
        self.new.append((r, d[r, c], names[c]))
        self.waiting += len(r)
        if len(self.new) == 1 and not len(self.row) or self.waiting > 32 * self.n:
            self.sort()

    def sort(self) -> None:
        if not self.new:
            return
        row, dist, name = (np.concatenate([old, *(x[k] for x in self.new)]) for k, old in enumerate((self.row, self.dist, self.name)))
        order = np.lexsort((name, dist, row))
        row, dist, name = row[order], dist[order], name[order]
        first = np.searchsorted(row, np.arange(self.n))
        rank = np.arange(len(row)) - first[row]
        last = rank == LIST
        self.cap[row[last]] = dist[last]
        ok = rank <= LIST
        self.row, self.dist, self.name, self.rank = row[ok], dist[ok], name[ok], rank[ok]
        self.new, self.waiting = [], 0

    def into(self, some: np.ndarray, names: np.ndarray, dist: np.ndarray, bound: np.ndarray, limit: float) -> None:
        self.sort()
        if not len(self.row):
            return
        ok = self.rank < LIST
        names[some[self.row[ok]], self.rank[ok]] = self.name[ok]
        dist[some[self.row[ok]], self.rank[ok]] = self.dist[ok]
        bound[some[self.row[~ok]]] = self.dist[~ok]


# ------------------------------------------------------------- jobs
_STATE: dict[str, Clusters] = {}


def _do(state: Clusters, item: tuple, hidden: np.ndarray, threshold: float | None):
    kind, g, todo, cut = item
    if kind in ("bounds", "nearest"):
        return state.nearest(g, todo, hidden, threshold, kind == "bounds")
    return state.part(g, todo, cut, hidden) if kind == "part" else state.matrix(g, todo, hidden)


def _work(key: str, shared, turn, threshold: float | None, parts: Iterator[tuple]) -> Iterator[tuple]:
    """Items of a job, on clusters that the Python process keeps from round to round."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = Clusters(*shared.value)
    state, (rounds, out) = _STATE[key], turn.value
    state.follow(rounds)
    hidden = np.zeros(len(state.rows), bool)
    hidden[out] = True
    for n, item in parts:
        yield n, _do(state, item, hidden, threshold)


class Work:
    """Runs items on clusters that the driver follows as well: small work here, the rest in a job."""

    def __init__(self, spark, clusters: Clusters, threshold: float | None):
        self.spark, self.clusters, self.threshold = spark, clusters, threshold
        self.key, self.shared, self.rounds = uuid.uuid4().hex, None, []

    def merged(self, i: np.ndarray, j: np.ndarray) -> None:
        self.rounds.append((i, j))
        self.clusters.follow(self.rounds)

    def run(self, items: list[tuple], cost: float, hidden: np.ndarray) -> list:
        if cost <= SMALL:
            return [_do(self.clusters, item, hidden, self.threshold) for item in items]
        sc = self.spark.sparkContext
        if self.shared is None:
            c = self.clusters
            self.shared = sc.broadcast((c.rows, c.bounds, c.metric, c.linkage))
        turn = sc.broadcast((self.rounds, np.flatnonzero(hidden)))
        got = dict(sc.parallelize(list(enumerate(items)), len(items)).mapPartitions(partial(_work, self.key, self.shared, turn, self.threshold)).collect())
        turn.destroy()
        return [got[n] for n in range(len(items))]

    def close(self) -> None:
        if self.shared is not None:
            self.shared.destroy()


def _cut(todo: np.ndarray, weight: np.ndarray, parts: int) -> list[np.ndarray]:
    """``todo`` in order of weight, dealt out to parts of like weight."""
    order = np.argsort(-weight, kind="stable")
    return [todo[order[k::parts]] for k in range(min(parts, len(todo)))]


# ------------------------------------------------------------- rounds
class Rounds:
    """All merges ``(i, j, height, round)`` of clusters, by rounds of mutual nearest ones.

    ``names``, ``dist`` are the lists of every cluster, ``exact`` tells distances from bounds below them, and
    every cluster that is not in a list is at ``bound`` or beyond.
    """

    def __init__(self, work: Work, parts: int, finish: int):
        self.work, self.c, self.parts, self.finish = work, work.clusters, parts, finish
        n = len(self.c.rows)
        self.limit = np.inf if work.threshold is None else work.threshold
        self.names, self.dist, self.exact = np.full((n, LIST), -1, np.int32), np.full((n, LIST), np.inf), np.zeros((n, LIST), bool)
        self.bound, self.near, self.high = np.full(n, self.limit), np.full(n, -1), np.full(n, np.inf)
        self.hidden = self.c.size == 0
        self.group = np.repeat(np.arange(len(self.c.bounds) - 1), np.diff(self.c.bounds))
        self.found: list[tuple] = []
        self.step = 0

    def merge(self, i: np.ndarray, j: np.ndarray, height: np.ndarray) -> None:
        self.found.append((i, j, height, np.full(len(i), self.step)))
        self.work.merged(i, j)
        self.step += 1

    def alive(self) -> np.ndarray:
        return np.flatnonzero((self.c.size > 0) & ~self.hidden)

    def search(self, todo: np.ndarray, fast: bool) -> None:
        """New lists for some clusters, of bounds if ``fast``."""
        every = self.alive()
        weight = np.ones(len(self.c.size), np.int64) if self.c.mean else self.c.size
        total = np.bincount(self.group[every], weight[every], len(self.c.bounds) - 1)
        load = np.bincount(self.group[todo], weight[todo], len(self.c.bounds) - 1) * total
        cost, items, order = float(load.sum()), [], []
        for g in np.unique(self.group[todo]):
            mine = todo[self.group[todo] == g]
            large = mine[weight[mine] > 2 * PART] if cost > SMALL and fast else mine[:0]
            for name in large:
                cuts = [(at, min(at + PART, self.c.size[name])) for at in range(0, self.c.size[name], PART)]
                order += [name] * len(cuts)
                items += [("part", g, name, cut) for cut in cuts]
            rest = np.setdiff1d(mine, large)
            share = max(1, round(min(2 * self.parts, 2 * cost / SMALL) * load[g] / cost)) if cost > SMALL else 1
            for some in _cut(rest, weight[rest], share):
                order.append(some)
                items.append(("bounds" if fast else "nearest", g, some, None))
        rows: dict = {}
        taken = []
        for who, item, got in zip(order, items, self.work.run(items, cost, self.hidden)):
            if item[0] == "part":
                rows[who] = got if who not in rows else self.c.put(rows[who], got)
            else:
                taken.append((who, *got))
        for name, row in rows.items():  # before others are hidden, so that the columns are those of the job
            side = self.c.side(self.group[name], self.hidden, fast)
            best = _Best(1, self.limit)
            best.add(self.c.scaled(side, row[None, :], np.array([name]), 0, len(row)), side["names"])
            got = np.full((1, LIST), -1), np.full((1, LIST), np.inf), np.full(1, self.limit)
            best.into(np.zeros(1, int), *got, self.limit)
            taken.append((np.array([name]), *got))
        for got in taken:
            self.take(*got, fast)

    def take(self, who: np.ndarray, names: np.ndarray, dist: np.ndarray, bound: np.ndarray, fast: bool) -> None:
        self.names[who], self.dist[who], self.bound[who] = names, dist, bound
        self.exact[who] = not fast
        self.near[who], self.high[who] = names[:, 0], dist[:, 0]
        self.hidden[who[names[:, 0] < 0]] = True  # nothing under the threshold: it never merges

    def from_lists(self, todo: np.ndarray) -> np.ndarray:
        """Nearest clusters as far as the lists tell; returns those that need a search."""
        search, members = [], None
        while len(todo):
            d = self.dist[todo]
            least = d.min(1)
            out = least >= self.bound[todo]
            never = out & (self.bound[todo] >= self.limit) & np.isfinite(self.limit)
            self.hidden[todo[never]] = True
            search.append(todo[out & ~never])
            todo, d, least = todo[~out], d[~out], least[~out]
            k = np.where(d == least[:, None], self.names[todo], np.iinfo(np.int32).max).argmin(1)
            sure = self.exact[todo, k]
            self.near[todo[sure]], self.high[todo[sure]] = self.names[todo[sure], k[sure]], least[sure]
            todo, k = todo[~sure], k[~sure]
            if len(todo):
                if members is None and not self.c.mean:
                    members = self.c.by_name()
                real = self.c.between(todo, self.names[todo, k].astype(np.int64), members)
                far = real >= self.bound[todo]
                self.dist[todo, k], self.exact[todo, k] = np.where(far, np.inf, real), True
                self.names[todo[far], k[far]] = -1
        return np.concatenate(search) if search else todo

    def after(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Lists after a round of merges; ``size`` is from before it. Returns clusters whose nearest one was merged."""
        other = np.full(len(size), -1)
        other[i], other[j] = j, i
        rest = self.alive()
        rest = rest[other[rest] < 0]
        names = self.names[rest]
        r, s = np.nonzero((names >= 0) & (other[names] >= 0))
        row, p = rest[r], names[r, s]
        q = other[p]
        same = self.names[row] == q[:, None]
        both = same.any(1)
        t = same.argmax(1)
        dp, dq = self.dist[row, s], np.where(both, self.dist[row, t], self.bound[row])
        if self.c.linkage == "complete":
            new = np.maximum(dp, dq)
        else:
            new = (size[p] * dp + size[q] * dq) / (size[p] + size[q])
        exact = both & self.exact[row, s] & self.exact[row, t]
        gone = (both & (p > q)) | (new >= self.bound[row])
        self.names[row, s] = np.where(gone, -1, np.minimum(p, q))
        self.dist[row, s] = np.where(gone, np.inf, new)
        self.exact[row, s] = exact
        self.names[i] = self.names[j] = -1
        near = self.near[rest]
        return rest[(near < 0) | (other[near] >= 0)]

    def small_groups(self) -> None:
        """Groups with few clusters do the rest of their rounds on one matrix."""
        from strandframe.operators.linkage import matrix_merges

        every = self.alive()
        count = np.bincount(self.group[every], minlength=len(self.c.bounds) - 1)
        for g in np.flatnonzero((count > 0) & (count <= self.finish)):
            mine = every[self.group[every] == g]
            if len(mine) > 1:
                weight = np.ones(len(mine), np.int64) if self.c.mean else self.c.size[mine]
                cuts = _cut(mine, weight, self.parts)
                d = np.empty((len(mine), len(mine)))
                for some, got in zip(cuts, self.work.run([("matrix", g, x, None) for x in cuts], float(weight.sum()) ** 2, self.hidden)):
                    d[np.searchsorted(mine, some)] = got
                rows = matrix_merges((d + d.T) / 2, self.c.linkage, self.work.threshold, self.c.size[mine], self.step)
                if rows:
                    x, y, h, r = (np.array(v) for v in zip(*rows))
                    self.found.append((mine[x], mine[y], h, r))
            self.hidden[mine] = True

    def all(self) -> list[tuple]:
        todo = self.alive()
        while True:
            self.small_groups()
            todo = todo[~self.hidden[todo]]
            every = self.alive()
            if len(every) < 2:
                return self.found
            if len(todo) and self.c.fast:
                self.search(todo, True)
                todo = self.from_lists(todo[~self.hidden[todo]])
            if len(todo):
                self.search(todo, False)
            every = self.alive()
            near, high = self.near[every], self.high[every]
            i = every[(self.near[near] == every) & (every < near) & (high < self.limit)]
            if not len(i):
                # equal distances may differ in the last digit, so that no two clusters choose each other: the closest pair is right as well
                if not len(every) or not np.nanmin(high, initial=np.inf) < self.limit:
                    return self.found
                k = np.lexsort((np.maximum(every, near), np.minimum(every, near), high))[:1]
                i, j, h = np.minimum(every, near)[k], np.maximum(every, near)[k], high[k]
            else:
                j, h = self.near[i], self.high[i]
            size = self.c.size.copy()
            self.merge(i, j, h)
            self.hidden[i] = self.hidden[j] = False
            lost = self.after(i, j, size)
            todo = np.concatenate([i, self.from_lists(lost)])


def copies(x: np.ndarray, bounds: np.ndarray, label: np.ndarray, metric: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Rounds of pairs that join rows with equal vectors of a group, and the distance of each row to its copies."""
    own = np.zeros(len(x))
    if metric in ("correlation", "cosine"):
        own[~unit_rows(x, metric).any(1)] = 1.0  # rows without direction
    first = np.flatnonzero(label == np.arange(len(x)))
    first = first[np.bincount(label, minlength=len(x))[first] == 1]  # a name with several vectors has no copies
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(first):
        return rounds, own
    group = np.searchsorted(bounds, first, "right")
    keyed = np.ascontiguousarray(np.hstack([group[:, None].astype(float), x[first] + 0.0]))
    _, kind = np.unique(keyed.view(np.dtype((np.void, keyed.dtype.itemsize * keyed.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((first, kind))
    name, kind = first[order], kind[order]
    while True:
        begin = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
        place = np.arange(len(kind)) - np.repeat(begin, np.diff(np.r_[begin, len(kind)]))
        j = np.flatnonzero(place % 2)
        if not len(j):
            return rounds, own
        rounds.append((name[j - 1], name[j]))
        name, kind = name[place % 2 == 0], kind[place % 2 == 0]


def merges(spark, x: list[np.ndarray], bounds: np.ndarray, label: np.ndarray, metric: str, linkage: str, threshold: float | None, parts: int, finish: int) -> list[tuple]:
    """Merges ``(i, j, height, round)`` of the rows of every group; rows of one ``label`` (the first such row) are one cluster from the start.

    The matrix is taken out of the list ``x``, so that it is not kept beside the rows made of it.
    """
    same, own = copies(x[0], bounds, label, metric)
    work = Work(spark, Clusters(prepared(x.pop(), metric), bounds, metric, linkage), threshold)
    extra = np.flatnonzero(label != np.arange(len(label)))
    while len(extra):
        owner, at = np.unique(label[extra], return_index=True)
        work.merged(owner, extra[at])
        extra = np.delete(extra, at)
    rounds = Rounds(work, parts, finish)
    for i, j in same:
        ok = own[i] < rounds.limit
        rounds.merge(i[ok], j[ok], own[i[ok]])
    rounds.hidden = work.clusters.size == 0
    try:
        return rounds.all()
    finally:
        work.close()
