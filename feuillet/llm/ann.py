"""The k most similar vectors of every vector: inverted lists with an adaptive dimension scan.

Unit vectors are put into lists of near ones, which hold some LIST_SIZE vectors however many there are: a few coarse
lists by centres fitted on a bounded sample, then fine ones inside each, fitted where the coarse list's own sample lies.
The lists are written once to the shared folder, a coarse list as a folder of files in the order of its fine ones. A task
takes the vectors of neighbouring fine lists as queries, and reads the lists nearest to each query from the folder, piece
by piece, so no vector is shuffled twice. Within a list, vectors are turned by a random rotation and compared in blocks of
columns: after each block a hypothesis test on the partial distance abandons candidates that can hardly come under the
k-th best (the test of ADSampling). What is left is scored in double precision on the vectors as stored. Equal vectors of
a batch are one row with all its ids, so a vector that stands very often costs little more than one that stands once.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feuillet.plans.shared import new_table_path, write_shared
from feuillet.plans.threads import one_thread, release_memory

LIST_SIZE = 512  # vectors a fine list is meant to hold
FAN = 64  # fine lists a coarse list is meant to hold
MOST_COARSE = 2000
PER_LIST = 40  # sampled vectors a list, of either kind
SAMPLE_ROWS = MOST_COARSE * PER_LIST  # bound of the sample of the coarse lists, and of the sample of one coarse list
PART_IDS = 16_384  # vectors that one step of a task searches for
FILE_ROWS = 98_304  # rows a file of a coarse list is meant to hold
BLOCKS = (64, 160)  # columns after which candidates are tested
FIRST = 64  # candidates that a query without any neighbour yet is compared with in full
EPSILON = 2.1  # of the test; the chance to lose a true neighbour falls with it exponentially


def to_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, float32 rows) of the usable vectors: exactly `dim` finite numbers, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    fit = np.nonzero(np.nan_to_num(lengths, nan=-1) == dim)[0]
    if not len(fit):
        return fit, np.zeros((0, dim), np.float32)
    taken = column.take(pa.array(fit))
    rows = taken.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return fit[good], rows[good]


def unit(rows: np.ndarray) -> np.ndarray:
    out = np.empty(rows.shape, np.float32)
    for at in range(0, len(rows), 2048):
        wide = rows[at : at + 2048].astype(np.float64)
        out[at : at + 2048] = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    return out


def pack(row: np.ndarray) -> bytes:
    """Two bytes a number where that loses nothing, else four."""
    half = row.astype(np.float16)
    return half.tobytes() if (half.astype(np.float32) == row).all() else row.tobytes()


def unpack(data: list[bytes], dim: int) -> np.ndarray:
    """The vectors again, with two bytes a number in memory too if all of them have."""
    if data and all(len(d) == 2 * dim for d in data):
        return np.frombuffer(b"".join(data), np.float16).reshape(-1, dim)
    out = np.empty((len(data), dim), np.float32)
    for k, d in enumerate(data):
        out[k] = np.frombuffer(d, np.float16 if len(d) == 2 * dim else np.float32)
    return out


def fit_lists(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres (unit length) of at most `count` lists, none of them empty, each followed by one near it."""
    rng = np.random.default_rng(11)
    count = max(1, min(count, len(sample)))
    centres = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[s : s + 4096] @ centres.T).argmax(axis=1) for s in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.bincount(own, minlength=count) == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centres = sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))
    own = np.concatenate([(sample[s : s + 4096] @ centres.T).argmax(axis=1) for s in range(0, len(sample), 4096)])
    centres = centres[np.unique(own)].astype(np.float32)
    chain, left, here = [0], np.ones(len(centres), bool), 0
    left[0] = False
    while left.any():
        near = centres @ centres[here]
        near[~left] = -9
        here = int(near.argmax())
        left[here] = False
        chain.append(here)
    return centres[chain]


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(3).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


class Lists:
    """Lists read from the shared folder, row group by row group; the last used groups are kept."""

    def __init__(self, uri: str, dim: int, k: int, most_mb: int = 64) -> None:
        from pyarrow import fs

        if "://" in uri or uri.startswith("file:"):
            self.fs, self.path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))
        else:
            self.fs, self.path = fs.LocalFileSystem(), uri
        self.dim, self.k, self.turn, self.kept, self.most = dim, k, rotation(dim), OrderedDict(), most_mb << 20
        self.files: dict[int, list[tuple]] = {}

    def _files(self, coarse: int) -> list[tuple]:
        """(path, first and last fine list of each row group) of the files of a coarse list."""
        if coarse not in self.files:
            import pyarrow.parquet as pq
            from pyarrow import fs

            out = []
            for info in sorted(self.fs.get_file_info(fs.FileSelector(f"{self.path}/coarse={coarse}", allow_not_found=True)), key=lambda x: x.path):
                if info.path.endswith(".parquet"):
                    with self.fs.open_input_file(info.path) as f:
                        meta = pq.ParquetFile(f).metadata
                    at = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == "fine")
                    stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
                    out.append((info.path, [(x.min, x.max) for x in stats]))
            self.files[coarse] = out
        return self.files[coarse]

    def _group(self, path: str, number: int) -> tuple[np.ndarray, ...]:
        """fine, first ids (k + 1 at most, then the largest long), vectors as stored, rotated unit vectors, squared partial norms."""
        key = path, number
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        import pyarrow.parquet as pq

        with self.fs.open_input_file(path) as f:
            table = pq.ParquetFile(f).read_row_group(number, columns=["fine", "top", "vector"])
        stored = unpack(table["vector"].to_pylist(), self.dim)
        turned = unit(stored) @ self.turn
        top = table["top"].combine_chunks()
        many = top.value_lengths().to_numpy(zero_copy_only=False)
        ids = np.full((len(many), self.k + 1), np.iinfo(np.int64).max)
        ids[np.repeat(np.arange(len(many)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] = top.flatten().to_numpy()
        norms = np.stack([(turned[:, :b] ** 2).sum(axis=1) for b in BLOCKS])
        self.kept[key] = table["fine"].to_numpy(), ids, stored, turned, norms
        while len(self.kept) > 1 and sum(x[2].nbytes + x[3].nbytes for x in self.kept.values()) > self.most:
            self.kept.popitem(last=False)
        return self.kept[key]

    def __call__(self, coarse: int, fine: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(first ids, stored, rotated, norms) of a list, in pieces. A row that a file of another task has too stands once."""
        seen = np.zeros(0, np.int64)
        pieces = [(path, g) for path, groups in self._files(coarse) for g, (low, high) in enumerate(groups) if low <= fine <= high]
        for path, g in pieces:
            own, ids, stored, turned, norms = self._group(path, g)
            a, b = np.searchsorted(own, [fine, fine + 1])
            if a == b:
                continue
            # An id sent twice may have a row in the files of two tasks, or two in one.
            alone = np.nonzero(ids[a:b, 1] == np.iinfo(np.int64).max)[0]
            twice = np.ones(len(alone), bool)
            twice[np.unique(ids[a:b, 0][alone], return_index=True)[1]] = False
            if 1 < len(pieces) < 64:
                twice |= np.isin(ids[a:b, 0][alone], seen)
                seen = np.concatenate([seen, ids[a:b, 0][alone[~twice]]])
            fresh = np.setdiff1d(np.arange(b - a), alone[twice]) + a
            yield ids[fresh], stored[fresh], turned[fresh], norms[:, fresh]

    def queries(self, coarse: int, low: int, high: int, part: int, parts: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(fine list, all ids, vectors as stored) of every `parts`-th row of the lists low to high."""
        import pyarrow.parquet as pq

        fine, ids, rows, n = [], [], [], 0
        for path, groups in self._files(coarse):
            for g, (first, last) in enumerate(groups):
                if first > high or last < low:
                    continue
                with self.fs.open_input_file(path) as f:
                    table = pq.ParquetFile(f).read_row_group(g, columns=["fine", "top", "rest", "vector"])
                own = table["fine"].to_numpy()
                a, b = np.searchsorted(own, [low, high + 1])
                at = np.arange(a + (part - n) % parts, b, parts)
                n += b - a
                taken = table.take(pa.array(at))
                fine.append(own[at])
                rows.append(unpack(taken["vector"].to_pylist(), self.dim))
                ids += [np.array(t + (r or []), np.int64) for t, r in zip(taken["top"].to_pylist(), taken["rest"].to_pylist())]
        return (np.concatenate(fine), ids, np.concatenate(rows)) if rows else (np.zeros(0, np.int64), [], np.zeros((0, self.dim), np.float32))


def scan(queries: np.ndarray, q_norms: np.ndarray, data: np.ndarray, d_norms: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the candidates that pass every test. `least` is the k-th best cosine of each query so far. A query
    that has none is compared with the first few candidates in full, and gets one by that."""
    fresh = np.nonzero(least <= -1)[0]
    if len(fresh):
        whole = queries[fresh] @ data[:FIRST].T
        found = [(fresh[q], x, s) for q, x, s in [_best_of(whole, least[fresh], k)]]
        if len(data) > FIRST:
            bar = np.partition(whole, -k, axis=1)[:, -k] if whole.shape[1] >= k else np.full(len(fresh), -0.999, np.float32)
            q, x, s = _tested(queries[fresh], q_norms[:, fresh], data[FIRST:], d_norms[:, FIRST:], bar)
            found.append((fresh[q], x + FIRST, s))
        known = np.nonzero(least > -1)[0]
        if len(known):
            q, x, s = _tested(queries[known], q_norms[:, known], data, d_norms, least[known])
            found.append((known[q], x, s))
        return tuple(np.concatenate(c) for c in zip(*found))
    return _tested(queries, q_norms, data, d_norms, least)


def _tested(queries: np.ndarray, q_norms: np.ndarray, data: np.ndarray, d_norms: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dim = queries.shape[1]
    limit = np.maximum(0, 2 - 2 * least)  # squared distance of the k-th best
    bar = lambda d, at: limit[at] * (d / dim) * (1 + EPSILON / math.sqrt(d)) ** 2
    first, second = BLOCKS
    every = slice(None)
    # partial distance <= limit * (d / D) * (1 + eps / sqrt(d))^2, written as one product that is then only compared with 0
    left = np.concatenate([2 * queries[:, :first], (bar(first, every) - q_norms[0])[:, None], np.full((len(queries), 1), -1.0)], axis=1, dtype=np.float32)
    right = np.concatenate([data[:, :first], np.ones((len(data), 1)), d_norms[0][:, None]], axis=1, dtype=np.float32)
    mask = left @ right.T >= 0
    # Where many candidates of a query are left, the next block is one product over all of them; it costs less than one by one.
    wide = np.nonzero(np.count_nonzero(mask, axis=1) > 0.12 * mask.shape[1])[0]
    a, b, so_far = [], [], []
    if len(wide):
        part = queries[wide, :second] @ data[:, :second].T
        keep = mask[wide] & (part >= (q_norms[1][wide][:, None] + d_norms[1][None, :] - bar(second, wide)[:, None]) / 2)
        q, x = np.divmod(np.flatnonzero(keep), keep.shape[1])
        if len(q) > 0.3 * keep.size:
            part += queries[wide, second:] @ data[:, second:].T
            a.append(wide[q]), b.append(x), so_far.append(part[q, x])
        else:
            for at in range(0, len(q), 40_000):
                i, j = q[at : at + 40_000], x[at : at + 40_000]
                a.append(wide[i]), b.append(j), so_far.append(part[i, j] + np.einsum("ij,ij->i", queries[wide[i], second:], data[j, second:]))
        mask[wide] = False
    q, x = np.divmod(np.flatnonzero(mask), mask.shape[1])
    del mask
    for at in range(0, len(q), 40_000):
        i, j = q[at : at + 40_000], x[at : at + 40_000]
        part = np.einsum("ij,ij->i", queries[i, :second], data[j, :second])
        keep = q_norms[1][i] + d_norms[1][j] - 2 * part <= bar(second, i)
        i, j = i[keep], j[keep]
        a.append(i), b.append(j), so_far.append(part[keep] + np.einsum("ij,ij->i", queries[i, second:], data[j, second:]))
    if not a:
        return q, x, np.zeros(0, np.float32)
    a, b, so_far = np.concatenate(a), np.concatenate(b), np.concatenate(so_far)
    keep = so_far >= least[a] - 2e-6
    return a[keep], b[keep], so_far[keep]


def _best_of(full: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates of a full comparison that reach the k-th best of the block and of before; ties stay."""
    bar = least if full.shape[1] <= k else np.maximum(least, np.partition(full, -k, axis=1)[:, -k])
    at = np.flatnonzero(full >= (bar - 2e-6)[:, None])
    q, x = np.divmod(at, full.shape[1])
    return q, x, full.reshape(-1)[at]


class Centres:
    """Centres of the coarse lists, and those of the fine ones of a coarse list, read when they are needed."""

    def __init__(self, coarse: np.ndarray, uri: str, dim: int) -> None:
        self.coarse, self.lists, self.fine = coarse, Lists(uri, dim, 0), {}

    def of(self, coarse: int) -> np.ndarray:
        if coarse not in self.fine:
            if len(self.fine) > 64:
                self.fine.clear()
            self.fine[coarse] = self._read(coarse)
        return self.fine[coarse]

    def _read(self, coarse: int) -> np.ndarray:
        import pyarrow.parquet as pq

        rows = []
        for path, groups in self.lists._files(coarse):
            with self.lists.fs.open_input_file(path) as f:
                table = pq.ParquetFile(f).read(columns=["fine", "centre"])
            rows += list(zip(table["fine"].to_pylist(), table["centre"].to_pylist()))
        return np.stack([np.frombuffer(c, np.float32) for _, c in sorted(rows)]) if rows else np.zeros((0, self.lists.dim), np.float32)


def search_part(lists: Lists, centres: Centres, coarse: int, low: int, high: int, part: int, parts: int, k: int, probes: int) -> pd.DataFrame:
    """The k nearest of the vectors of some neighbouring fine lists."""
    fine, members, stored = lists.queries(coarse, low, high, part, parts)
    if not len(fine):
        return pd.DataFrame({"chunk": np.zeros(0, np.int64), "neighbour": np.zeros(0, np.int64), "cosine": np.zeros(0)})
    plain = unit(stored)
    turned = plain @ lists.turn
    norms = np.stack([(turned[:, :b] ** 2).sum(axis=1) for b in BLOCKS])
    near = plain @ centres.coarse.T
    width = min(4, near.shape[1])
    union = sorted({coarse, *np.unique(np.argpartition(-near, width - 1, axis=1)[:, :width]).tolist()})
    names = [(c, f) for c in union for f in range(len(centres.of(c)))]
    near = plain @ np.concatenate([centres.of(c) for c in union]).T
    del plain
    width = min(probes, near.shape[1])
    probing = np.zeros(near.shape, bool)
    np.put_along_axis(probing, np.argpartition(-near, width - 1, axis=1)[:, :width], True, axis=1)
    begin = names.index((coarse, 0))
    probing[np.arange(len(fine)), begin + fine] = True
    own = (begin + np.unique(fine)).tolist()
    # Own lists first, which give near neighbours; the others as they lie in their files, so that each piece is read once.
    order = own + [c for c in np.nonzero(probing.any(axis=0))[0].tolist() if c not in set(own)]
    best = np.full((len(fine), k), -1.0, np.float32)
    alone = np.array([m[0] if len(m) == 1 else -1 for m in members])
    copied = np.array([len(m) > 1 for m in members])
    length = np.concatenate([np.linalg.norm(x.astype(np.float64), axis=1) for x in np.array_split(stored, len(stored) // 2048 + 1)])
    left = lambda i: stored[i].astype(np.float64) / length[i, None]
    pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle(q: np.ndarray, x: np.ndarray, s: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Raise the k-th bests and score in double precision what reaches them; a row with the query's id alone is left out."""
        keep = copied[q] | (ids[x, 0] != alone[q]) | (ids[x, 1] != np.iinfo(np.int64).max)
        q, x, s = q[keep], x[keep], s[keep]
        if not len(q):
            return
        place = np.lexsort((-s, q))
        q, x, s = q[place], x[place], s[place]
        start = np.concatenate([[True], q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
        who, at = np.unique(q, return_inverse=True)
        fresh = np.full((len(who), k), -1.0, np.float32)
        fresh[at[rank < k], rank[rank < k]] = s[rank < k]
        best[who] = np.sort(np.concatenate([best[who], fresh], axis=1), axis=1)[:, -k:]
        keep = s >= best[q, 0] - 2e-6
        q, x = q[keep], x[keep]
        for at in range(0, len(q), 8192):
            i, j = q[at : at + 8192], x[at : at + 8192]
            right = rows[j].astype(np.float64)
            cosine = np.einsum("ij,ij->i", left(i), right) / np.linalg.norm(right, axis=1)
            filled = ids[j] != np.iinfo(np.int64).max
            many = filled.sum(axis=1)
            pool.append((np.repeat(i, many), np.repeat(cosine, many), ids[j][filled]))
        if sum(len(c[0]) for c in pool[1:]) > 500_000:  # the k-th bests have risen since
            i, cosine, own = (np.concatenate(c) for c in zip(*pool))
            keep = cosine >= best[i, 0].astype(np.float64) - 4e-6
            pool[:] = [(i[keep], cosine[keep], own[keep])]

    for number in order:
        who = np.nonzero(probing[:, number])[0]
        for ids, rows, other, other_norms in lists(*names[number]):
            for at in range(0, len(ids), 4096):
                for piece in np.array_split(who, max(1, len(who) // 1024)):
                    end = at + 4096
                    q, x, s = scan(turned[piece], norms[:, piece], other[at:end], other_norms[:, at:end], best[piece, 0], k + 1)
                    settle(piece[q], x, s, ids[at:end], rows[at:end])
    to_copies = np.zeros(len(fine))
    at = np.nonzero(copied)[0]
    to_copies[at] = np.einsum("ij,ij->i", left(at), stored[at].astype(np.float64)) / length[at]
    return _ranked(pool, best, members, to_copies, k)


def _ranked(pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]], best: np.ndarray, members: list[np.ndarray], to_copies: np.ndarray, k: int) -> pd.DataFrame:
    """The k best ids of every member of the queries' rows, ties to the smaller id, no id its own neighbour."""
    q, cosine, ids = (np.concatenate(c) for c in zip(*pool)) if pool else (np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64))
    keep = cosine >= best[q, 0].astype(np.float64) - 4e-6
    frame = pd.DataFrame({"q": q[keep], "neighbour": ids[keep], "cosine": cosine[keep]})
    many = np.array([len(m) for m in members])
    copied = np.nonzero(many > 1)[0]
    if len(copied):  # copies of one vector are each other's neighbours
        inside = [np.sort(members[c])[: k + 1] for c in copied]
        frame = pd.concat([frame, pd.DataFrame({"q": np.repeat(copied, [len(i) for i in inside]), "neighbour": np.concatenate(inside), "cosine": np.repeat(to_copies[copied], [len(i) for i in inside])})])
    frame = frame.sort_values(["q", "cosine", "neighbour"], ascending=[True, False, True]).drop_duplicates(["q", "neighbour"])
    frame = frame[frame.groupby("q").cumcount() <= k]
    out = frame.merge(pd.DataFrame({"q": np.repeat(np.arange(len(members)), many), "chunk": np.concatenate(members)}), on="q", sort=False)
    out = out[out["chunk"] != out["neighbour"]]
    return out[out.groupby("chunk").cumcount() < k][["chunk", "neighbour", "cosine"]]


def _usable(rows: DataFrame, share: float, dim: int) -> DataFrame:
    """The unit vectors of a share of the usable rows, chosen by a hash of the id: h, vector."""
    h = F.xxhash64("chunk")
    picked = rows.where(F.size("vector") == dim)
    picked = picked.where(h <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)))) if share < 1 else picked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = to_matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in unit(found)], pa.binary())], names=["h", "vector"])

    return picked.select(h.alias("h"), "vector").mapInArrow(run, "h long, vector binary")


def _matrix(column: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dim)


def _fit(rows: DataFrame, total: int, dim: int) -> tuple[np.ndarray, str, np.ndarray] | None:
    """(centres of the coarse lists, folder of those of the fine ones, files that each coarse list is to have)."""
    spark = rows.sparkSession
    n_coarse = max(1, min(MOST_COARSE, math.ceil(total / LIST_SIZE / FAN)))
    taken = _usable(rows, min(1.0, 1.3 * n_coarse * PER_LIST / max(1, total)), dim).orderBy("h").limit(n_coarse * PER_LIST).toArrow().column(1).to_pylist()
    if not taken:
        taken = _usable(rows, 1.0, dim).limit(PER_LIST).toArrow().column(1).to_pylist()
        if not taken:
            return None
    coarse = fit_lists(_matrix(taken, dim), n_coarse)
    share = min(1.0, PER_LIST / LIST_SIZE)
    if total * share < 4 * PER_LIST:
        share = 1.0
    model = spark.sparkContext.broadcast(coarse)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            own = (_matrix(batch.column(1).to_pylist(), dim) @ model.value.T).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), *batch.columns], names=["coarse", "h", "vector"])

    sample = write_shared(_usable(rows, share, dim).mapInArrow(assign, "coarse int, h long, vector binary"), "sample")
    number = np.zeros(len(coarse))
    for c, n in sample.groupBy("coarse").count().collect():  # a row for each coarse list
        number[c] = n / share
    bounded = sample.withColumn("r", F.row_number().over(Window.partitionBy("coarse").orderBy("h"))).where(F.col("r") <= SAMPLE_ROWS).select("coarse", "vector")

    def fit(table: pa.Table) -> pa.Table:
        one_thread()
        own = table["coarse"][0].as_py()
        centres = fit_lists(_matrix(table["vector"].to_pylist(), dim), math.ceil(number[own] / LIST_SIZE))
        return pa.table({"coarse": pa.array(np.full(len(centres), own), pa.int32()), "fine": pa.array(np.arange(len(centres)), pa.int32()), "centre": pa.array([c.tobytes() for c in centres], pa.binary())})

    path = new_table_path(spark, "centres")
    bounded.groupBy("coarse").applyInArrow(fit, "coarse int, fine int, centre binary").write.option("compression", "none").partitionBy("coarse").parquet(path)
    return coarse, path, np.maximum(1, np.ceil(number / FILE_ROWS)).astype(np.int64)


def _write_lists(rows: DataFrame, coarse: np.ndarray, centres_path: str, files: np.ndarray, dim: int, k: int) -> str:
    spark = rows.sparkSession
    model = spark.sparkContext.broadcast((coarse, files, np.concatenate([[0], np.cumsum(files)])))
    ids_type = pa.list_(pa.int64())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal vectors of a batch become one row; `key` is a file of the vector's coarse list, by a hash of the vector."""
        one_thread()
        own_coarse, own_files, first = model.value
        for whole in batches:
            at, found = to_matrix(whole.column(1), dim)
            packed = [pack(r) for r in found]
            hashes = [xxhash.xxh64_intdigest(p) - (1 << 63) for p in packed]
            if whole.column(2).null_count < whole.num_rows:  # of the vectors of an id, the one with the smallest hash
                fit = [n for n, (h, least) in enumerate(zip(hashes, whole.column(2).take(pa.array(at)).to_pylist())) if least is None or h == least]
                at, found, packed, hashes = at[fit], found[fit], [packed[n] for n in fit], [hashes[n] for n in fit]
            if not len(at):
                continue
            ids = whole.column(0).to_numpy(zero_copy_only=False)[at]
            same: dict[bytes, int] = {}
            row = np.array([same.setdefault(p, len(same)) for p in packed], np.int64)
            packed = list(same)
            first_of = np.unique(row, return_index=True)[1]
            own = np.concatenate([(unit(found[first_of[s : s + 4096]]) @ own_coarse.T).argmax(axis=1) for s in range(0, len(first_of), 4096)])
            hashes = np.array(hashes, np.int64)[first_of]
            key = first[own] + hashes % own_files[own]
            groups: list[list[int]] = [[] for _ in packed]
            for r, i in zip(row.tolist(), ids.tolist()):
                groups[r].append(i)
            groups = [sorted(set(g)) if len(g) > 1 else g for g in groups]
            yield pa.RecordBatch.from_arrays([
                pa.array(key), pa.array(own, pa.int32()), pa.array(hashes), pa.array([g[: k + 1] for g in groups], ids_type), pa.array([g[k + 1 :] or None for g in groups], ids_type), pa.array(packed, pa.binary()),
            ], names=["key", "coarse", "hash", "top", "rest", "vector"])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        centres = Centres(model.value[0], centres_path, dim)
        for batch in batches:
            own, fine = batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int32)
            vectors = unit(unpack(batch.column(4).to_pylist(), dim)) if batch.num_rows else np.zeros((0, dim))
            for c in np.unique(own).tolist():
                at = np.nonzero(own == c)[0]
                if len(centres.of(c)):  # a coarse list without a sampled vector is one fine list
                    fine[at] = (vectors[at] @ centres.of(c).T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine), *batch.columns[1:]], names=["coarse", "fine", "hash", "top", "rest", "vector"])

    path = new_table_path(spark, "lists")
    placed = rows.where(F.size("vector") == dim).mapInArrow(place, "key long, coarse int, hash long, top array<long>, rest array<long>, vector binary")
    n = max(3 * int(files.sum()), spark.sparkContext.defaultParallelism)  # so that few files share a partition
    fine = placed.repartition(n, "key").drop("key").mapInArrow(refine, "coarse int, fine int, hash long, top array<long>, rest array<long>, vector binary").sortWithinPartitions("coarse", "fine")
    fine.write.option("compression", "none").option("parquet.enable.dictionary", "false").option("parquet.block.size", str(1 << 20)).partitionBy("coarse").parquet(path)
    return path


def _conflicts(spark: SparkSession, path: str) -> DataFrame:
    """chunk, least: ids that stand in rows with different vectors, and the hash of the one to keep. Few bytes an id are shuffled."""
    stored = spark.read.parquet(path).select("hash", "top", "rest")
    own = stored.select("hash", F.explode(F.when(F.col("rest").isNull(), F.col("top")).otherwise(F.concat("top", "rest"))).alias("chunk"))
    return own.groupBy("chunk").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least <> most").select("chunk", "least")


def nearest_vectors(df: DataFrame, vector_col: str = "chunk_vectors", id_col: str = "chunk_id", dim: int = 384, k: int = 5, probes: int = 12) -> DataFrame:
    """`id_col`, neighbour, cosine: the k most similar other vectors of each usable vector, over the whole collection.

    Usable are vectors of exactly `dim` finite numbers, not all zero; others (null, empty, short, NaN) neither ask nor
    answer. A repeated id counts once (of differing vectors, the one with the smallest hash); a null id not at all. The
    cosine is in double precision, ties go to the smaller id. Which neighbours are found depends on the lists probed; a
    small share may be missed. Other columns, whatever their names, play no part. Of the rows only bounded samples reach the
    driver (SAMPLE_ROWS vectors at most).
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].cast("long").alias("chunk"), df[vector_col].cast("array<float>").alias("vector")).where("chunk is not null")
    rename = lambda out: out.withColumnRenamed("chunk", id_col)
    fitted = _fit(rows, df.count(), dim)
    if fitted is None:
        return rename(spark.createDataFrame([], "chunk long, neighbour long, cosine double"))
    coarse, centres_path, files = fitted
    path = _write_lists(rows.withColumn("least", F.lit(None).cast("long")), coarse, centres_path, files, dim, k)
    conflicts = _conflicts(spark, path)
    if not conflicts.isEmpty():
        path = _write_lists(rows.join(write_shared(conflicts, "conflicts"), "chunk", "left").select("chunk", "vector", "least"), coarse, centres_path, files, dim, k)

    # Steps of some PART_IDS vectors: neighbouring fine lists of one coarse list; a larger list is searched in several steps.
    sizes = spark.read.parquet(path).groupBy(F.col("coarse").cast("int").alias("coarse"), "fine").agg(F.sum(F.size("top") + F.greatest(F.lit(0), F.coalesce(F.size("rest"), F.lit(0)))).alias("n"))
    before = F.sum("n").over(Window.partitionBy("coarse").orderBy("fine")) - F.col("n")
    whole = F.sum("n").over(Window.partitionBy("coarse"))
    steps = sizes.withColumn("step", F.floor(before * F.ceil(whole / PART_IDS) / whole)).groupBy("coarse", "step").agg(F.min("fine").alias("low"), F.max("fine").alias("high"), F.ceil(F.sum("n") / (2 * PART_IDS)).cast("int").alias("parts"))
    steps = write_shared(steps.select("coarse", "low", "high", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts"), "steps")
    n_steps = steps.count()
    slots = max(1, min(n_steps, max(spark.sparkContext.defaultParallelism * 3, n_steps // 32)))
    work = steps.repartitionByRange(slots, "coarse", "low", "part").sortWithinPartitions("coarse", "low", "part")
    model = spark.sparkContext.broadcast(coarse)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        lists, centres = Lists(path, dim, k), Centres(model.value, centres_path, dim)
        for batch in batches:
            for step in zip(*(batch.column(c).to_pylist() for c in ("coarse", "low", "high", "part", "parts"))):
                out = search_part(lists, centres, *step, k, probes)
                release_memory()
                yield pa.RecordBatch.from_arrays([pa.array(out["chunk"].to_numpy(np.int64)), pa.array(out["neighbour"].to_numpy(np.int64)), pa.array(out["cosine"].to_numpy(np.float64))], names=["chunk", "neighbour", "cosine"])

    # An id sent twice may stand in two rows, each with its own neighbours.
    found = work.mapInArrow(search, "chunk long, neighbour long, cosine double").repartition("chunk").dropDuplicates(["chunk", "neighbour"])
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("cosine"), "neighbour"))
    return rename(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
