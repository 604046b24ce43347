"""Most similar vectors for every vector.

Inverted file with product-quantised residuals:
1. A bounded sample of the distinct vectors of each dimension fits the coarse centroids and, on their residuals, one codebook
   per few components. Where LISTS centroids would make lists longer than LIST, a second level divides every list by one set of
   residual centroids. Centroids are bisected along their principal directions into groups of lists of equal weight, so that a
   vector's probed lists lie in few groups; a list heavier than a group is divided over several groups by hash.
2. Every vector is sent once to the group of its own list, as member and query, and once to each other group that holds lists it
   probes, as query. Where a lowest cosine c is asked for, it probes only lists that can hold such a vector: one at that cosine in a
   random direction is nearer to another centroid than its own with a margin that is normal, and lists ASK_SIGMAS standard errors
   away are left out. Vectors travel as 16-bit fixed point (an error of a cosine below 1e-5); equal vectors of a batch
   travel once, so copies of one vector don't pile up in a group.
3. One task per group: members are coded, and each list scores its queries with asymmetric distance tables (a codebook entry's
   product with the query's components, summed over the codes). The best by table are reranked with the vectors themselves. Where
   a lowest cosine c is asked for, only members are reranked whose table score reaches c (1 - e^2) less SIGMAS standard errors
   of e ((1 - c^2) / dimensions)^0.5, e being the length of the member's coding error: what is lost by that is part of the
   accepted loss, and far below one pair in a million for errors without a direction.
4. The best of a query from its groups are merged, and vectors are given back their keys: keys with the same vector are found by
   the vector's hash, and each is among the most similar of the others. Keys of 64 hex digits travel as 32 bytes.

Defined cases: a vector counts only with a key and exactly `dimensions` finite 32-bit values, not all zero; rows with one key are
one vector, of unlike usable ones that with the smallest hash; other rows are left out; ties go by hash, then key, those of 64 hex
digits last; fewer than k others give fewer rows; an empty table gives none. Sample and model are bounded by SAMPLE, LISTS and SUB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.runtime import written

#: Vectors of one dimension that a model is fitted on, at most.
SAMPLE = 65_536
#: Vectors per inverted list, the most centroids of one dimension, and the most lists that each is divided into.
LIST, LISTS, SUB = 512, 4096, 1024
#: Vectors per group of lists; groups are at least FEW where there are four lists for each.
GROUP, FEW = 150_000, 8
#: Components per code, and codes per codebook. With a lowest cosine coarser codes do.
PART, COARSE, CODES = 4, 8, 256
#: Members per query and list that are reranked.
RERANK = 40
#: Standard errors of a table score that a member may be below what a lowest cosine makes likely.
SIGMAS = 6.0
#: Standard errors between the margin of a list's centroid and that of a vector at the lowest cosine, for the list to be probed.
ASK_SIGMAS = 4.0
#: Queries scored against a list at a time.
BLOCK = 128


# ---- the model


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        label = _nearest(x, c)
        count = np.bincount(label, minlength=k).astype(np.float32)
        for j in range(x.shape[1]):
            c[:, j] = np.bincount(label, x[:, j], k) / np.maximum(count, 1)
        bare = count == 0
        c[bare] = x[rng.choice(len(x), bare.sum())]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _steps(x: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """x in pieces whose products with c are at most 8 MB."""
    n = max(64, 2_000_000 // len(c))
    return [x[i : i + n] for i in range(0, len(x), n)]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(p @ c.T - half).argmax(1) for p in _steps(x, c)]])


def _bisect(c: np.ndarray, weight: np.ndarray, lists: np.ndarray, parts: int) -> list[np.ndarray]:
    if parts == 1 or len(lists) == 1:
        return [lists]
    left = parts // 2
    w = weight[lists]
    y = (c[lists] - np.average(c[lists], axis=0, weights=w)) * np.sqrt(w)[:, None]
    order = lists[np.argsort(y @ np.linalg.svd(y, full_matrices=False)[2][0] / np.sqrt(w), kind="stable")]
    filled = np.cumsum(weight[order])
    cut = int(np.clip(np.searchsorted(filled, filled[-1] * left / parts), 1, len(order) - 1))
    return _bisect(c, weight, order[:cut], left) + _bisect(c, weight, order[cut:], parts - left)


class Model:
    """Centroids, lists, groups and codebooks of one dimension, fitted on unit vectors of which there are n in all. List l is the
    (l % sub)-th part of centroid l // sub."""

    def __init__(self, sample: np.ndarray, n: int, first_group: int, part: int = PART, floor: float | None = None, seed: int = 1):
        self.dim, self.part, self.floor = sample.shape[1], part, floor
        k = int(np.clip(n // LIST, 1, min(LISTS, len(sample))))
        self.centroids = _kmeans(sample, k, 8, seed, True)
        label = _nearest(sample, self.centroids)
        weight = np.bincount(label, minlength=k) + 0.5
        # Lists are found by their directions; residuals are taken from their means.
        self.means = self.centroids * (np.bincount(label, (sample * self.centroids[label]).sum(1), k) / weight)[:, None].astype(np.float32)
        rest = sample - self.means[label]
        self.sub = int(np.clip(round(n / LIST / k), 1, min(SUB, len(rest))))
        self.fine = _kmeans(rest, self.sub, 6, seed, False) if self.sub > 1 else np.zeros((1, self.dim), np.float32)
        self._group(weight, n, first_group)
        # So many lists, more of them where no lowest cosine narrows the search; beyond LISTS, more by the fourth root.
        self.probes = int(min(k * self.sub, max(12, round((1.4 if floor is None else 0.9) * k**0.5 * self.sub**0.25))))
        self.parts = -(-self.dim // part)
        lists = self.lists(sample, label)
        rest = self.pad(sample - self.centre(lists))[:32_768]
        codes = min(CODES, len(rest))
        self.books = np.stack([_kmeans(np.ascontiguousarray(rest[:, m * part : (m + 1) * part]), codes, 6, seed + m, False) for m in range(self.parts)])

    def _group(self, weight: np.ndarray, n: int, first: int) -> None:
        """The first group of every centroid, and over how many its members are divided by hash."""
        members = weight / weight.sum() * n
        self.split = np.maximum(1, np.ceil(members / GROUP)).astype(np.int64)
        light = np.flatnonzero(self.split == 1)
        self.group = np.zeros(len(weight), np.int64)
        self.groups = 0
        if len(light):
            parts = _bisect(self.centroids, weight, light, int(max(-(-members[light].sum() // GROUP), min(FEW, len(light) // 4), 1)))
            for lists in parts:
                self.group[lists] = first + self.groups
                self.groups += 1
        for c in np.flatnonzero(self.split > 1):
            self.group[c] = first + self.groups
            self.groups += int(self.split[c])

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.means[lists // self.sub] + self.fine[lists % self.sub]

    def lists(self, x: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The list of each vector, given its centroid."""
        return label * self.sub + (_nearest(x - self.means[label], self.fine) if self.sub > 1 else 0)

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.parts * self.part - self.dim)))

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list) of the lists to probe, in the rows' order, and the list of each row."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        wide, done = min(len(self.centroids), self.probes), 0
        for p in _steps(x, self.centroids):
            score = p @ self.centroids.T
            near = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
            score = np.take_along_axis(score, near, 1)
            order = np.argsort(-score, axis=1, kind="stable")
            near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
            fits = self._can_hold(near, score)
            own = self.lists(p, near[:, 0])
            if self.sub == 1:
                row, at = np.nonzero(fits)
                out.append((row + done, near[row, at], own))
            else:
                for a in range(0, len(p), max(1, 4_000_000 // (wide * self.sub))):
                    z = min(len(p), a + max(1, 4_000_000 // (wide * self.sub)))
                    row, lists = self._parts(p[a:z], near[a:z], fits[a:z], own[a:z])
                    out.append((row + done + a, lists, own[a:z]))
            done += len(p)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _can_hold(self, near: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Which of the centroids, from the nearest on, can be nearest to a vector at the lowest cosine: its margin between the two is
        c times this vector's, give or take a normal error, which no direction exceeds."""
        if self.floor is None or self.floor <= 0:
            return np.ones(near.shape, bool)
        margin = score[:, :1] - score
        apart = ((self.centroids[near[:, 0]][:, None] - self.centroids[near]) ** 2).sum(2) - margin**2
        z = min(1.0, ASK_SIGMAS / max(self.dim - 1, 1) ** 0.5)
        return self.floor * margin <= z * np.sqrt((1 - self.floor**2) * np.maximum(apart, 0)) + 1e-6

    def _parts(self, x, near, fits, own):
        """Of all parts of the centroids, the own list and the nearest ones."""
        rest = x[:, None] - self.means[near]
        far = (rest**2).sum(2)[:, :, None] - 2 * rest @ self.fine.T + (self.fine**2).sum(1)
        far[~fits] = np.inf
        lists = (near[:, :, None] * self.sub + np.arange(self.sub)).reshape(len(x), -1)
        far = np.where(lists == own[:, None], -np.inf, far.reshape(len(x), -1))
        n = min(self.probes, far.shape[1])
        best = np.argpartition(far, n - 1, axis=1)[:, :n]
        row, at = np.nonzero(np.take_along_axis(far, best, 1) < np.inf)
        return row, lists[row, best[row, at]]

    def coded(self, x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they miss."""
        rest = self.pad(x - self.centre(label))
        codes = np.empty((len(x), self.parts), np.uint8)
        miss = np.zeros(len(x), np.float32)
        for m in range(self.parts):
            part = np.ascontiguousarray(rest[:, m * self.part : (m + 1) * self.part])
            codes[:, m] = _nearest(part, self.books[m])
            miss += ((part - self.books[m][codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(miss)


# ---- rows to vectors and back


def _values(column: pa.Array, dims: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Which rows of a batch are usable, and the unit vectors of the usable rows by dimension."""
    column = column.cast(pa.large_binary())
    offset = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    usable, units = np.zeros(len(dims), bool), {}
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        x = raw[offset[rows][:, None] + np.arange(4 * d)].view("<f4").astype(np.float64)
        fine = np.isfinite(x).all(1) & (x != 0).any(1)
        x = x[fine]
        usable[rows[fine]] = True
        x /= np.abs(x).max(1, keepdims=True)
        units[int(d)] = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return usable, units


def _packed(key: Column) -> Column:
    """A key as bytes: 64 hex digits as 1 and 32 bytes, any other as 0 and itself."""
    return F.when(key.rlike("^[0-9a-f]{64}$"), F.concat(F.lit(b"\x01"), F.unhex(key))).otherwise(F.concat(F.lit(b"\x00"), key.cast("binary")))


def _unpacked(key: Column) -> Column:
    rest = F.substring(key, 2, 2**31 - 1)
    return F.when(F.substring(key, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def _sized(rows: DataFrame) -> DataFrame:
    """Rows with a key and as many bytes as their dimensions need, with two hashes of the vector."""
    fits = rows.where(F.col("key").isNotNull() & (F.col("dimensions") > 0) & (F.octet_length("vector") == F.col("dimensions") * 4))
    return fits.select(_packed(F.col("key")).alias("key"), F.col("dimensions").cast("int").alias("d"), "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2"))


_CHECKED = pa.schema([("key", pa.binary()), ("d", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _usable(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        keep = pa.array(_values(b.column("vector"), b.column("d").to_numpy())[0])
        yield pa.RecordBatch.from_arrays([b.column(c).cast(_CHECKED.field(c).type).filter(keep) for c in _CHECKED.names], schema=_CHECKED)


def owners(rows: DataFrame) -> DataFrame:
    """(key, d, h1, h2): the one vector of every key that has a usable one; keys are packed."""
    each = _sized(rows).mapInArrow(_usable, "key binary, d int, h1 bigint, h2 bigint")
    # By the first hash, so the partial aggregation stays a hash aggregation.
    return each.groupBy("key").agg(F.min_by("d", "h1").alias("d"), F.min_by("h2", "h1").alias("h2"), F.min("h1").alias("h1")).select("key", "d", "h1", "h2")


def _unit_bytes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        dims, h2 = b.column("d").to_numpy(), b.column("h2").to_numpy()
        usable, units = _values(b.column("vector"), dims)
        for d, x in units.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(len(x), d, np.int32)), "h2": pa.array(h2[usable & (dims == d)]), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def fit(rows: DataFrame, own: DataFrame, floor: float | None = None) -> dict[int, Model]:
    """A model for each dimension. own: owners(rows)."""
    sizes = {r["d"]: r["n"] for r in own.groupBy("d").agg(F.approx_count_distinct("h1", 0.02).alias("n")).collect()}
    models, first = {}, 0
    # A share of the hashes' range, so copies of a vector are in the sample together and count once.
    share = {d: min(1.0, SAMPLE / n) for d, n in sizes.items()}
    if not sizes:
        return {}
    limit = F.element_at(F.create_map(*[F.lit(v) for d, s in share.items() for v in (d, int(s * (2**62 - 1)))]), F.col("d"))
    drawn = _sized(rows).where(F.col("d").isin(list(sizes)) & (F.pmod(F.col("h2"), F.lit(2**62 - 1)) <= limit))
    drawn = drawn.dropDuplicates(["h1", "h2"]).select("d", "h2", "vector").mapInArrow(_unit_bytes, "d int, h2 bigint, x binary").toArrow()
    dims, order = drawn["d"].to_numpy(), drawn["h2"].to_numpy()
    for d in sorted(sizes):
        rows = np.flatnonzero(dims == d)
        if not len(rows):
            continue
        # By hash, so the fit doesn't depend on how rows arrive.
        rows = rows[np.argsort(order[rows], kind="stable")]
        x = np.frombuffer(b"".join(drawn["x"].take(pa.array(rows)).to_pylist()), np.float32).reshape(-1, d)
        models[d] = Model(x, max(sizes[d], len(x)), first, PART if floor is None else COARSE, floor)
        first += models[d].groups
    return models


# ---- sending vectors to groups

_SENT = "g int, role int, d int, body binary"
_SENT_ARROW = pa.schema([("g", pa.int32()), ("role", pa.int32()), ("d", pa.int32()), ("body", pa.binary())])
#: Body: two hashes, the list or -1, the largest value, the values as 16-bit shares of it, then the probed lists (32-bit each).
_HEAD = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("list", "<i4"), ("scale", "<f4")])


def _send(models) -> callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            dims = b.column("d").to_numpy()
            usable, units = _values(b.column("vector"), dims)
            h1, h2 = b.column("h1").to_numpy(), b.column("h2").to_numpy()
            for d, x in units.items():
                model = models.value.get(d)
                rows = np.flatnonzero(usable & (dims == d))
                if model is None or not len(rows):
                    continue
                _, first = np.unique(np.stack([h1[rows], h2[rows]], 1), axis=0, return_index=True)
                rows, x = rows[first], x[first]
                row, lists, own = model.probed(x)
                scale = np.abs(x).max(1)
                short = np.rint(x / scale[:, None] * 32767).astype("<i2")
                head = np.zeros(len(x), _HEAD)
                head["h1"], head["h2"], head["scale"] = h1[rows], h2[rows], scale
                split, first = model.split[lists // model.sub], model.group[lists // model.sub]
                home = model.group[own // model.sub] + head["h1"] % model.split[own // model.sub]
                # A divided list is asked in all its groups.
                each = np.repeat(np.arange(len(row)), split)
                group = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(split) - split, split)
                row, lists = row[each], lists[each].astype("<i4")
                order = np.lexsort((group, row))
                row, lists, group = row[order], lists[order], group[order]
                cuts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(group) != 0), True])
                member = group[cuts[:-1]] == home[row[cuts[:-1]]]
                g_out, role_out, body = group[cuts[:-1]].astype(np.int32), (~member).astype(np.int32), []
                for a, z, m in zip(cuts[:-1].tolist(), cuts[1:].tolist(), member.tolist(), strict=True):
                    i = row[a]
                    head["list"][i] = own[i] if m else -1
                    body.append(head[i].tobytes() + short[i].tobytes() + lists[a:z].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(g_out), pa.array(role_out), pa.array([d] * len(body), pa.int32()), pa.array(body, pa.binary())], schema=_SENT_ARROW)

    return run


def _read(bodies: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    head = np.frombuffer(b"".join(x[: _HEAD.itemsize] for x in bodies), _HEAD)
    end = _HEAD.itemsize + 2 * dim
    short = np.frombuffer(b"".join(x[_HEAD.itemsize : end] for x in bodies), "<i2").reshape(-1, dim)
    x = short.astype(np.float32) * (head["scale"] / 32767)[:, None]
    return head, x / np.linalg.norm(x, axis=1, keepdims=True), [np.frombuffer(b, "<i4", offset=end) for b in bodies]


class Group:
    """The members of one group, by list, and the scoring of queries against them."""

    def __init__(self, model: Model, head: np.ndarray, x: np.ndarray):
        _, first = np.unique(np.stack([head["h1"], head["h2"]], 1), axis=0, return_index=True) if len(head) else (None, np.zeros(0, np.int64))
        order = first[np.argsort(head["list"][first], kind="stable")]
        self.model, self.h1, self.h2, self.label, self.x = model, head["h1"][order], head["h2"][order], head["list"][order], x[order]
        codes, self.miss = model.coded(self.x, self.label)
        self.codes = np.ascontiguousarray(codes.T).astype(np.intp)

    def table_scores(self, of: int, a: int, z: int, q: np.ndarray) -> np.ndarray:
        """Members of a list, from the a-th to before the z-th, x queries: what the codes say their products are."""
        wide, part = self.model.pad(q), self.model.part
        total = np.empty((z - a, len(q)), np.float32)
        total[:] = q @ self.model.centre(of)
        taken = np.empty_like(total)
        wide = np.ascontiguousarray(wide.T)
        for m in range(self.model.parts):
            np.take(self.model.books[m] @ wide[m * part : (m + 1) * part], self.codes[m, a:z], axis=0, out=taken, mode="clip")
            total += taken
        return total

    def search(self, head: np.ndarray, q: np.ndarray, lists: list[np.ndarray], k: int, floor: float | None):
        """(query, member, cosine) of at most k members per query."""
        flat = np.concatenate(lists)
        who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], who[order]
        out = []
        if floor is not None:
            least = floor * (1 - self.miss**2) - SIGMAS * self.miss * ((1 - floor**2) / self.model.dim) ** 0.5
        for of in np.unique(flat):
            a, z = np.searchsorted(self.label, of, "left"), np.searchsorted(self.label, of, "right")
            if a == z:
                continue
            asking = who[np.searchsorted(flat, of, "left") : np.searchsorted(flat, of, "right")]
            for i in range(0, len(asking), BLOCK):
                part = asking[i : i + BLOCK]
                score = self.table_scores(int(of), a, z, q[part])
                columns = np.arange(len(part))
                if floor is not None:
                    rows, cols = np.divmod(np.flatnonzero(score >= least[a:z, None]), len(part))
                    many = np.bincount(cols, minlength=len(part)) > RERANK
                    few = ~many[cols]
                    if few.any():
                        out.append(self._exact(q, part[cols[few]], a + rows[few]))
                    columns = np.flatnonzero(many)
                if len(columns):
                    # The query itself may be among the members, hence one more.
                    n = min(RERANK + 1, z - a)
                    best = np.argpartition(-score[:, columns].T, n - 1, axis=1)[:, :n] if n < z - a else np.tile(np.arange(z - a), (len(columns), 1))
                    out.append(self._exact(q, np.repeat(part[columns], n), a + best.ravel()))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        i, j, cos = (np.concatenate(c) for c in zip(*out, strict=True))
        keep = (self.h1[j] != head["h1"][i]) | (self.h2[j] != head["h2"][i])
        if floor is not None:
            keep &= cos >= floor
        i, j, cos = i[keep], j[keep], cos[keep]
        order = np.lexsort((self.h1[j], -cos, i))
        i, j, cos = i[order], j[order], cos[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        return i[place < k], j[place < k], cos[place < k]

    def _exact(self, q, i, j):
        cos = np.empty(len(i), np.float32)
        for s in range(0, len(i), 65_536):
            cos[s : s + 65_536] = np.einsum("ij,ij->i", q[i[s : s + 65_536]], self.x[j[s : s + 65_536]])
        return i, j, cos


_FOUND = "d int, h1 bigint, h2 bigint, g1 bigint, g2 bigint, cosine float"
_FOUND_ARROW = pa.schema([("d", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("cosine", pa.float32())])


def _search(models, k: int, floor: float | None) -> callable:
    """Rows come sorted by group and role, so a group's members are complete when its first foreign query comes; the members ask
    before that."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, members = None, None, []

        def ask(head, x, lists):
            for s in range(0, len(head), 8192):
                i, j, cos = group.search(head[s : s + 8192], x[s : s + 8192], lists[s : s + 8192], k, floor)
                h = head[s : s + 8192][i]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), group.model.dim, np.int32)), pa.array(h["h1"]), pa.array(h["h2"]), pa.array(group.h1[j]), pa.array(group.h2[j]), pa.array(cos)], schema=_FOUND_ARROW)

        def close():
            nonlocal group, members
            if members:
                head, x, lists = (np.concatenate([m[0] for m in members]), np.concatenate([m[1] for m in members]), [p for m in members for p in m[2]])
                group, members = Group(models.value[x.shape[1]], head, x), []
                # Copies of a member sent by several batches ask once.
                _, first = np.unique(np.stack([head["h1"], head["h2"]], 1), axis=0, return_index=True)
                yield from ask(head[first], x[first], [lists[i] for i in first])

        for b in parts:
            g, role, d = (b.column(c).to_numpy() for c in ("g", "role", "d"))
            body = b.column("body")
            turn = np.flatnonzero(np.diff(g * 2 + role)) + 1
            for a, z in zip([0, *turn], [*turn, len(g)], strict=True):
                if z <= a:
                    continue
                if g[a] != now:
                    yield from close()
                    now, group = g[a], None
                head, x, lists = _read(body.slice(a, z - a).to_pylist(), int(d[a]))
                if role[a] == 0:
                    members.append((head, x, lists))
                else:
                    yield from close()
                    if group is not None:
                        yield from ask(head, x, lists)
        yield from close()

    return run


def search(rows: DataFrame, models: dict[int, Model], k: int = 10, floor: float | None = None) -> DataFrame:
    """(d, h1, h2, g1, g2, cosine): for each distinct vector its k most similar other ones, or those of them with at least that
    cosine."""
    spark = rows.sparkSession
    if not models:
        return spark.createDataFrame([], _FOUND)
    shared = spark.sparkContext.broadcast(models)
    groups = sum(m.groups for m in models.values())
    sent = _sized(rows).select("d", "vector", "h1", "h2").mapInArrow(_send(shared), _SENT)
    placed = sent.repartitionById(groups, "g").sortWithinPartitions("g", "role")
    near = placed.mapInArrow(_search(shared, k, floor), _FOUND)
    rank = F.row_number().over(Window.partitionBy("d", "h1", "h2").orderBy(F.desc("cosine"), "g1", "g2"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _neighbours(rows: DataFrame, own: DataFrame, k: int, floor: float | None) -> DataFrame:
    """neighbours() with packed keys. own: owners(rows)."""
    near = written(search(rows, fit(rows, own, floor), k, floor)).df
    vector = ["d", "h1", "h2"]
    # Of the keys of one vector only the first k + 1 can be among anyone's k most similar; one more tells whether there are others.
    first = own.withColumn("place", F.row_number().over(Window.partitionBy(*vector).orderBy("key"))).where(F.col("place") <= k + 2)
    keyed = first.groupBy(*vector).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    target = keyed.select("d", F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.slice("keys", 1, k + 1).alias("keys"))
    others = near.join(target, ["d", "g1", "g2"]).groupBy(*vector).agg(F.collect_list(F.struct("cosine", "keys")).alias("others"))
    both = keyed.join(others, vector, "left").where(F.col("others").isNotNull() | (F.size("keys") > 1))
    entry = lambda cos, key: F.struct((-cos).cast("double").alias("c"), key.alias("key"))
    listed = F.flatten(F.transform(F.coalesce("others", F.array().cast("array<struct<cosine:float,keys:array<binary>>>")), lambda o: F.transform(o["keys"], lambda x: entry(o["cosine"], x))))
    same = F.when(F.size("keys") > 1, F.transform(F.slice("keys", 1, k + 1), lambda x: entry(F.lit(1.0), x))).otherwise(F.array().cast("array<struct<c:double,key:binary>>"))
    ordered = written(both.select(*vector, "keys", F.slice(F.array_sort(F.concat(same, listed)), 1, k + 1).alias("near"))).df
    each = ordered.where(F.size("keys") <= k + 1).select(F.explode("keys").alias("key"), "d", "near")
    crowded = ordered.where(F.size("keys") > k + 1)
    if not crowded.isEmpty():
        each = each.unionByName(own.join(crowded.select(*vector, "near"), vector).select("key", "d", "near"))
    mine = F.slice(F.filter("near", lambda e: e["key"] != F.col("key")), 1, k)
    flat = each.select("key", "d", F.posexplode(mine).alias("at", "e"))
    return flat.select("key", (F.col("at") + 1).cast("long").alias("rank"), F.col("e.key").alias("neighbour"), (-F.col("e.c")).alias("cosine"), "d")


def neighbours(rows: DataFrame, k: int = 10, floor: float | None = None) -> DataFrame:
    """(key, rank, neighbour, cosine, d): for each key its k most similar others, or those of them with at least that cosine."""
    near = _neighbours(rows, written(owners(rows)).df, k, floor)
    return near.select(_unpacked(F.col("key")).alias("key"), "rank", _unpacked(F.col("neighbour")).alias("neighbour"), "cosine", "d")


#: How far a cosine from 16-bit values may be off.
SLACK = 2e-5


def similar_pairs(rows: DataFrame, k: int = 10, floor: float = 0.90) -> DataFrame:
    """(key_a, key_b): pairs with at least that cosine of which one is among the k most similar of the other."""
    own = written(owners(rows)).df
    near = _neighbours(rows, own, k, floor - SLACK)
    first = _unpacked(F.col("key")) < _unpacked(F.col("neighbour"))
    a, b = F.when(first, F.col("key")).otherwise(F.col("neighbour")), F.when(first, F.col("neighbour")).otherwise(F.col("key"))
    pairs = written(near.select(a.alias("a"), b.alias("b"), "cosine").groupBy("a", "b").agg(F.min("cosine").alias("cosine"))).df
    names = [_unpacked(F.col("a")).alias("key_a"), _unpacked(F.col("b")).alias("key_b")]
    sure = pairs.where(F.col("cosine") >= floor + SLACK).select(*names)
    close = pairs.where(F.col("cosine") < floor + SLACK).select("a", "b")
    n = close.count()
    if not n:
        return sure
    # The few on the border are compared by the stored values.
    small = F.broadcast if n <= 20_000 else lambda x: x
    wanted = own.join(small(close.select(F.explode(F.array("a", "b")).alias("key")).distinct()), "key", "left_semi").select("key", "h1", "h2")
    values = _sized(rows).join(small(wanted), ["key", "h1", "h2"], "left_semi").groupBy("key").agg(F.first("vector").alias("v"))
    met = close.join(values.select(F.col("key").alias("a"), F.col("v").alias("va")), "a").join(values.select(F.col("key").alias("b"), F.col("v").alias("vb")), "b")
    met = met.select(*names, "va", "vb")

    def exact(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fine = []
            for va, vb in zip(b.column("va").to_pylist(), b.column("vb").to_pylist(), strict=True):
                x, y = np.frombuffer(va, "<f4").astype(float), np.frombuffer(vb, "<f4").astype(float)
                fine.append(len(x) == len(y) and float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) >= floor)
            yield b.select(["key_a", "key_b"]).filter(pa.array(fine, pa.bool_()))

    return sure.unionByName(met.mapInArrow(exact, "key_a string, key_b string"))
