"""Evidence of neighbours that lasts from slide to slide: the strategies of streams, for the points of one key.

A detector holds the live points of a key by pane, oldest first, and what its strategy knows of them. A slide brings the panes
that have become complete, lets the panes that no window reaches any more go, and gives the counts of outliers. What is
compared are new points with live ones, and points whose evidence has gone; not the whole window again. Panes are q.pane
long. All strategies give the same counts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np

from panewise.config import Algorithm, QuerySet
from panewise.functions.distance import SLACK

#: Candidate pairs that are held at once.
BLOCK = 1 << 20

Counts = list["int | None"]
Arrays = dict[str, np.ndarray]


def pack(arrays: Arrays) -> bytes:
    file = io.BytesIO()
    np.savez(file, **arrays)
    return file.getvalue()


def unpack(blob: bytes) -> Arrays:
    with np.load(io.BytesIO(blob)) as file:
        return {name: file[name] for name in file.files}


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, then the same of the next."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def neighbours_by_layer(ids: np.ndarray, values: np.ndarray, other_ids: np.ndarray, others: np.ndarray, ranges: tuple[float, ...]) -> tuple[np.ndarray, int]:
    """For each point how many of the others, but those of its own id, are in each layer (the smallest range that holds them); how many pairs were compared.

    Distances are taken between different values. On a line others within a range follow each other by value, so that they
    are counted by their places and not one by one.
    """
    counts, reach = np.zeros((len(values), len(ranges)), dtype=np.int64), ranges[-1] * (1 + SLACK)
    if not len(values) or not len(others):
        return counts, 0
    a, at = np.unique(values, axis=0, return_inverse=True) if values.shape[1] > 1 else np.unique(values[:, 0], return_inverse=True)
    b, n = np.unique(others, axis=0, return_counts=True) if values.shape[1] > 1 else np.unique(others[:, 0], return_counts=True)
    a, b = a.reshape(len(a), -1), b.reshape(len(b), -1)
    found, x, at = np.zeros((len(a), len(ranges)), dtype=np.int64), b[:, 0], at.reshape(-1)
    if values.shape[1] == 1:
        real = int((~np.isnan(x)).sum())
        x, total = x[:real], np.append(0, np.cumsum(n[:real]))
        far = lambda i, r: np.sqrt((a[:, 0] - np.append(x, np.nan)[i]) ** 2) <= r
        for i, r in enumerate(ranges):
            low, high = np.searchsorted(x, a[:, 0] - r, "left"), np.searchsorted(x, a[:, 0] + r, "right")
            # Rounding may put an end some values off.
            while (more := (low > 0) & far(low - 1, r)).any():
                low[more] -= 1
            while (less := (low < high) & ~far(low, r)).any():
                low[less] += 1
            while (more := (high < real) & far(high, r)).any():
                high[more] += 1
            while (less := (low < high) & ~far(high - 1, r)).any():
                high[less] -= 1
            found[:, i] = total[high] - total[low]
        found[:, 1:] -= found[:, :-1].copy()
        compared = int(found[at].sum())
    else:
        low, high = np.searchsorted(x, a[:, 0] - reach, "left"), np.searchsorted(x, a[:, 0] + reach, "right")
        sizes, start, compared = high - low, 0, int((high - low).sum())
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(BLOCK, sizes.sum() + BLOCK, BLOCK), "left")
        for cut in np.unique(np.append(cuts + 1, len(a))):
            i = np.repeat(np.arange(start, min(cut, len(a))), sizes[start:cut])
            j = spread(low[start:cut], sizes[start:cut])
            distance = np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1))
            near = distance <= ranges[-1]
            np.add.at(found, (i[near], np.searchsorted(ranges, distance[near], "left")), n[j[near]])
            start = cut
    counts += found[at]
    order = np.argsort(other_ids, kind="stable")
    low, high = (np.searchsorted(other_ids[order], ids, side) for side in ("left", "right"))
    i, j = np.repeat(np.arange(len(ids)), high - low), order[spread(low, high - low)]
    distance = np.sqrt(((values[i] - others[j]) ** 2).sum(axis=1))
    near = distance <= ranges[-1]
    np.subtract.at(counts, (i[near], np.searchsorted(ranges, distance[near], "left")), 1)
    return counts, compared


class Detector:
    """Live points of a key; subclasses keep evidence about them in `slide`."""

    def __init__(self, q: QuerySet):
        self.q, self.compared = q, 0
        self.pane = self.ids = self.arrival = np.zeros(0, dtype=np.int64)
        self.flag, self.value = np.zeros(0, dtype=np.int8), np.zeros((0, 1))

    def __len__(self) -> int:
        return len(self.pane)

    def near(self, a: np.ndarray, b: np.ndarray, r: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in a, places in b, distances) of the live points a and b (given by place) within r, other than by the same id.

        Only points whose first components are near are compared.
        """
        if not len(a) or not len(b):
            return
        order = np.argsort(self.value[b, 0], kind="stable")
        x, reach = self.value[b[order], 0], r * (1 + SLACK)
        low, high = np.searchsorted(x, self.value[a, 0] - reach, "left"), np.searchsorted(x, self.value[a, 0] + reach, "right")
        sizes = high - low
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(BLOCK, sizes.sum() + BLOCK, BLOCK), "left")
        start = 0
        for cut in np.unique(np.append(cuts + 1, len(a))):
            n = sizes[start:cut]
            i = np.repeat(np.arange(start, min(cut, len(a))), n)
            j = order[spread(low[start:cut], n)]
            self.compared += len(i)
            distance = np.sqrt(((self.value[a[i]] - self.value[b[j]]) ** 2).sum(axis=1))
            found = (distance <= r) & (self.ids[a[i]] != self.ids[b[j]])
            yield i[found], j[found], distance[found]
            start = cut

    def first_pane(self, end: int, w: int) -> int:
        """The oldest pane of the window of length w before `end`."""
        return (end - w) // self.q.pane

    def expire(self, first: int) -> int:
        """Lets points of panes before `first` go; how many."""
        gone = int(np.searchsorted(self.pane, first, "left"))
        if gone:
            for name in ("pane", "ids", "arrival", "flag", "value"):
                setattr(self, name, getattr(self, name)[gone:])
        return gone

    def append(self, points: Arrays) -> np.ndarray:
        """Adds points of newer panes; their places."""
        order = np.argsort(points["arrival"], kind="stable")
        start, pane = len(self), points["arrival"][order] // self.q.pane
        self.value = np.concatenate([self.value if start else np.zeros((0, points["value"].shape[1])), points["value"][order]])
        self.pane = np.concatenate([self.pane, pane])
        for name in ("ids", "arrival", "flag"):
            setattr(self, name, np.concatenate([getattr(self, name), points[name][order]]))
        return np.arange(start, len(self))

    def points(self, pane: int) -> Arrays:
        """The points of a pane."""
        low, high = np.searchsorted(self.pane, [pane, pane + 1])
        return {name: getattr(self, name)[low:high] for name in ("ids", "arrival", "flag", "value")}

    def evidence(self) -> Arrays:
        """What else is to be kept."""
        return {}

    def load(self, points: list[Arrays], evidence: Arrays) -> None:
        """The state that points() and evidence() gave."""
        for part in points:
            self.append(part)

    def slide(self, end: int, points: Arrays | None, due: bool) -> Counts | None:
        """Counts of the windows before `end`, for each window length, range and k in this order, if they are due.

        points: those of the panes since the last slide, in columns ids, arrival, flag, value. A window length without points has None.
        """
        raise NotImplementedError

    def report(self, end: int, few: np.ndarray, neighbours) -> Counts:
        """Counts from the places of the points that may be outliers, and from neighbours(first pane, range's place) -> numbers of all."""
        out: Counts = []
        for w in self.q.windows:
            first = self.first_pane(end, w)
            if not len(self) or self.pane[-1] < first:
                out += [None] * (len(self.q.ranges) * len(self.q.ks))
                continue
            own = few[(self.pane[few] >= first) & (self.flag[few] == 0)]
            for i in range(len(self.q.ranges)):
                n = neighbours(first, i)[own]
                out += [int((n < k).sum()) for k in self.q.ks]
        return out


class Recount(Detector):
    """All points of a window against each other, at every due slide."""

    def slide(self, end, points, due):
        self.expire(self.first_pane(end, self.q.max_window))
        if points is not None:
            self.append(points)
        if not due:
            return None

        def neighbours(first: int, i: int) -> np.ndarray:
            live, n = np.flatnonzero(self.pane >= first), np.zeros(len(self), dtype=np.int64)
            for a, _, _ in self.near(live, live, self.q.ranges[i]):
                n[live] += np.bincount(a, minlength=len(live))
            return n

        return self.report(end, np.arange(len(self)), neighbours)


class Slicing(Detector):
    """For one query: a point looks for neighbours slice by slice and stops at k; it looks again when a slice that it counted on goes.

    A new point looks at its own pane, then at older ones, newest first. Panes in which it found some get it on their trigger
    lists. When a pane expires, its list loses these neighbours; who then has fewer than k looks on at the panes that came
    since it last looked. Who still has fewer is watched: it looks at each new pane, until it has k. The outliers are the
    watched points.
    """

    def __init__(self, q: QuerySet):
        super().__init__(q)
        self.known, self.checked = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.watched = np.zeros(0, dtype=bool)
        #: By pane: points (by number, from the first ever) and how many neighbours they counted there.
        self.triggers: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.base = 0

    def evidence(self) -> Arrays:
        flat = [(np.full(len(i), p), i, n) for p, parts in self.triggers.items() for i, n in parts]
        columns = [np.concatenate(c) for c in zip(*flat)] if flat else [np.zeros(0, dtype=np.int64)] * 3
        return {"known": self.known, "checked": self.checked, "watched": self.watched, "base": np.array(self.base), "at": columns[0], "who": columns[1], "n": columns[2]}

    def load(self, points, evidence):
        super().load(points, evidence)
        if evidence:
            self.known, self.checked, self.watched, self.base = evidence["known"], evidence["checked"], evidence["watched"], int(evidence["base"])
            for p in np.unique(evidence["at"]).tolist():
                here = evidence["at"] == p
                self.triggers[p] = [(evidence["who"][here], evidence["n"][here])]

    def _count(self, who: np.ndarray, pane: int) -> np.ndarray:
        """Neighbours of some points in a pane."""
        low, high = np.searchsorted(self.pane, [pane, pane + 1])
        n = np.zeros(len(who), dtype=np.int64)
        for a, _, _ in self.near(who, np.arange(low, high), self.q.max_range):
            n += np.bincount(a, minlength=len(who))
        return n

    def slide(self, end, points, due):
        k, first = self.q.ks[0], self.first_pane(end, self.q.max_window)
        gone = self.expire(first)
        self.base += gone
        self.known, self.checked, self.watched = self.known[gone:], self.checked[gone:], self.watched[gone:]
        for pane in sorted(p for p in self.triggers if p < first):
            for who, n in self.triggers.pop(pane):
                who, n = who[who >= self.base] - self.base, n[who >= self.base]
                self.known[who] -= n
                self.watched[who[self.known[who] < k]] = True
        new = self.append(points) if points is not None else np.zeros(0, dtype=np.int64)
        self.known = np.append(self.known, np.zeros(len(new), dtype=np.int64))
        self.checked = np.append(self.checked, self.pane[new])
        self.watched = np.append(self.watched, np.zeros(len(new), dtype=bool))
        panes = np.unique(self.pane)
        for pane in np.unique(self.pane[new]).tolist():
            asking = new[(self.pane[new] == pane) & (self.flag[new] == 0)]
            self.known[asking] += self._count(asking, pane)
            for older in panes[panes < pane][::-1].tolist():
                asking = asking[self.known[asking] < k]
                if not len(asking):
                    break
                n = self._count(asking, older)
                self.known[asking] += n
                if n.any():
                    self.triggers.setdefault(older, []).append((asking[n > 0] + self.base, n[n > 0]))
            self.watched[asking[self.known[asking] < k]] = True
        for pane in panes.tolist():
            asking = np.flatnonzero(self.watched & (self.checked < pane))
            self.known[asking] += self._count(asking, pane)
            self.checked[asking] = pane
            self.watched[asking[self.known[asking] >= k]] = False
        if not due:
            return None
        return [int(self.watched.sum())] if len(self) else [None]


class Layers(Detector):
    """Evidence by layer: for each undecided point how many neighbours it has by pane and layer (the smallest range that holds them), newest first.

    Of these only those are kept that a query can tell from none. `cumulative`: a neighbour goes when the largest k others
    are no older and in no larger layer (the skyband); else when they are no older and in its own layer. A point with the
    largest k neighbours of the smallest layer that came with it or later is decided: it is an inlier for as long as it lives.

    `lazy`: a point searches pane by pane, newest first, until it has the largest k of the smallest layer.

    `clusters`: points within half the smallest range of a centre are neighbours of each other. A cluster with more than the
    largest k members in the shortest window decides all its members. New points join the nearest centre, or else look for
    neighbours; those with the largest k undecided ones around found a cluster. Members of a cluster that has become too
    small look for neighbours as if new: `clusters` says whether clusters are looked at after points have expired ("expiry")
    or, with the new points, before reporting ("report").
    """

    def __init__(self, q: QuerySet, cumulative: bool = True, lazy: bool = True, clusters: str | None = None):
        super().__init__(q)
        self.cumulative, self.lazy, self.clusters = cumulative, lazy, clusters
        self.cluster, self.safe = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.who = self.at = self.n = np.zeros(0, dtype=np.int64)
        self.layer = np.zeros(0, dtype=np.int16)
        self.names, self.centres, self.next = np.zeros(0, dtype=np.int64), np.zeros((0, 1)), 0

    def evidence(self) -> Arrays:
        return {"cluster": self.cluster, "safe": self.safe, "who": self.who, "at": self.at, "layer": self.layer, "n": self.n, "names": self.names, "centres": self.centres, "next": np.array(self.next)}

    def load(self, points, evidence):
        super().load(points, evidence)
        for name, found in evidence.items():
            setattr(self, name, int(found) if name == "next" else found)

    def _keep(self, kept: np.ndarray) -> None:
        self.who, self.at, self.layer, self.n = self.who[kept], self.at[kept], self.layer[kept], self.n[kept]

    def _add(self, who: np.ndarray, pane: int) -> np.ndarray:
        """Notes how many neighbours some points have in a pane, by layer; how many are in the first."""
        low, high = np.searchsorted(self.pane, [pane, pane + 1])
        counts, compared = neighbours_by_layer(self.ids[who], self.value[who], self.ids[low:high], self.value[low:high], self.q.ranges)
        self.compared += compared
        i, layer = np.nonzero(counts)
        self.who, self.at = np.append(self.who, who[i]), np.append(self.at, np.full(len(i), pane))
        self.layer, self.n = np.append(self.layer, layer.astype(np.int16)), np.append(self.n, counts[i, layer])
        return counts[:, 0]

    def _search(self, asking: np.ndarray) -> None:
        """All evidence that some points need, from all live points."""
        first = np.zeros(len(asking), dtype=np.int64)
        for pane in np.unique(self.pane)[::-1].tolist():
            first += self._add(asking, pane)
            if self.lazy:
                asking, first = asking[first < self.q.ks[-1]], first[first < self.q.ks[-1]]
            if not len(asking):
                return

    def _trim(self) -> None:
        """Decides points and drops needless evidence."""
        k = self.q.ks[-1]
        later = (self.layer == 0) & (self.at >= self.pane[self.who])
        self.safe |= np.bincount(self.who[later], self.n[later], minlength=len(self)) >= k
        self._keep(~self.safe[self.who] & (self.cluster[self.who] < 0))
        order = np.lexsort((self.layer, -self.at, self.who))
        self._keep(order)
        kept = np.ones(len(self.who), dtype=bool)
        start = np.searchsorted(self.who, self.who, "left")
        for i in range(len(self.q.ranges)):
            rivals = np.where(self.layer <= i if self.cumulative else self.layer == i, self.n, 0)
            before = np.cumsum(rivals) - rivals
            mine = self.layer == i
            kept[mine] = (before - before[start])[mine] < k if len(start) else kept[mine]
        self._keep(kept)

    def _dissolved(self, first: int) -> np.ndarray:
        """Members of the clusters that are too small, which are clusters no more."""
        inside = self.cluster[(self.cluster >= 0) & (self.pane >= first)]
        named, n = np.unique(inside, return_counts=True)
        alive = np.isin(self.names, named[n > self.q.ks[-1]])
        gone = np.flatnonzero(np.isin(self.cluster, self.names[~alive]))
        self.names, self.centres = self.names[alive], self.centres[alive]
        self.cluster[gone] = -1
        return gone[~self.safe[gone]]

    def _joined(self, new: np.ndarray) -> np.ndarray:
        """New points that no cluster takes."""
        half = self.q.ranges[0] / 2 * (1 - SLACK)
        if not len(self.names) or not len(new):
            return new
        best, name = np.full(len(new), np.inf), np.full(len(new), -1)
        order = np.argsort(self.centres[:, 0], kind="stable")
        x = self.centres[order, 0]
        low, high = np.searchsorted(x, self.value[new, 0] - half, "left"), np.searchsorted(x, self.value[new, 0] + half, "right")
        i, c = np.repeat(np.arange(len(new)), high - low), order[spread(low, high - low)]
        self.compared += len(i)
        distance = np.sqrt(((self.value[new[i]] - self.centres[c]) ** 2).sum(axis=1))
        np.minimum.at(best, i, distance)
        take = (distance == best[i]) & (distance <= half)
        name[i[take]] = self.names[c[take]]
        self.cluster[new] = name
        return new[name < 0]

    def _founded(self, asking: np.ndarray, first: int) -> None:
        """Clusters around points that have enough undecided ones near."""
        asking = asking[(self.cluster[asking] < 0) & (self.pane[asking] >= first)]
        free, half, k = np.flatnonzero((self.cluster < 0) & (self.pane >= first)), self.q.ranges[0] / 2 * (1 - SLACK), self.q.ks[-1]
        if not len(asking):
            return
        # Points of a value have the same points around: they found a cluster once.
        values, at = np.unique(self.value[free], axis=0, return_inverse=True)
        by_value = np.argsort(at.reshape(-1), kind="stable")
        starts = np.searchsorted(at.reshape(-1)[by_value], np.arange(len(values) + 1))
        left = np.diff(starts)
        centres = np.unique(self.value[asking], axis=0)
        low, high = np.searchsorted(values[:, 0], centres[:, 0] - half, "left"), np.searchsorted(values[:, 0], centres[:, 0] + half, "right")
        for centre, i, j in zip(centres, low.tolist(), high.tolist()):
            if left[i:j].sum() <= k:
                continue
            self.compared += j - i
            near = i + np.flatnonzero((np.sqrt(((values[i:j] - centre) ** 2).sum(axis=1)) <= half) & (left[i:j] > 0))
            if left[near].sum() <= k or not (values[near] == centre).all(axis=1).any():
                continue
            left[near] = 0
            self.cluster[free[by_value[spread(starts[near], starts[near + 1] - starts[near])]]] = self.next
            self.names = np.append(self.names, self.next)
            self.centres = np.concatenate([self.centres, centre[None, :]]) if len(self.names) > 1 else centre[None, :]
            self.next += 1

    def slide(self, end, points, due):
        gone = self.expire(self.first_pane(end, self.q.max_window))
        self.cluster, self.safe = self.cluster[gone:], self.safe[gone:]
        self._keep(self.who >= gone)
        self.who = self.who - gone
        if len(self):
            self._keep(self.at >= self.pane[0])
        first = self.first_pane(end, self.q.windows[0])
        again = self._dissolved(first) if self.clusters == "expiry" else np.zeros(0, dtype=np.int64)
        undecided = np.setdiff1d(np.flatnonzero((self.cluster < 0) & ~self.safe), again)
        new = self.append(points) if points is not None else np.zeros(0, dtype=np.int64)
        self.cluster, self.safe = np.append(self.cluster, np.full(len(new), -1)), np.append(self.safe, np.zeros(len(new), dtype=bool))
        fresh = self._joined(new) if self.clusters else new
        if self.clusters == "report":
            again = self._dissolved(first)
            fresh = np.flatnonzero(np.isin(np.arange(len(self)), fresh))
        for pane in np.unique(self.pane[new]).tolist():
            self._add(undecided, pane)
        fresh = np.union1d(fresh, again)
        self._search(fresh)
        if self.clusters:
            self._founded(fresh, first)
        self._trim()
        if not due:
            return None

        def neighbours(oldest: int, i: int) -> np.ndarray:
            near = (self.at >= oldest) & (self.layer <= i)
            return np.bincount(self.who[near], self.n[near], minlength=len(self))

        return self.report(end, np.flatnonzero((self.cluster < 0) & ~self.safe), neighbours)


def detector(algorithm: Algorithm, q: QuerySet) -> Detector:
    """The streams' plan of a strategy."""
    kinds = {
        Algorithm.NAIVE: lambda: Recount(q),
        Algorithm.ADVANCED: lambda: Layers(q, lazy=False),
        Algorithm.ADVANCED_EXTENDED: lambda: Layers(q, lazy=False),
        Algorithm.SLICING: lambda: Slicing(q),
        Algorithm.PMCOD: lambda: Layers(q, clusters="expiry"),
        Algorithm.PMCOD_NET: lambda: Layers(q, clusters="report"),
        Algorithm.AMCOD: lambda: Layers(q, clusters="expiry"),
        Algorithm.SOP: lambda: Layers(q),
        Algorithm.PSOD: lambda: Layers(q, cumulative=False, lazy=False),
        Algorithm.PMCSKY: lambda: Layers(q, clusters="expiry"),
        Algorithm.BY_VALUE: lambda: Recount(q),
    }
    return kinds[algorithm]()
