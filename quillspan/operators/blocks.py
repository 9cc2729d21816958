"""A batch of queries against whole documents, in blocks: the best documents and the candidates, without a row per pair of query and document in between."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents and queries of a block; a task holds one matrix of this size.
DOCS, QUERIES = 2048, 2048
#: A term goes into the matrix product when it has more than one in SPARSE of the block's cells.
SPARSE = 250
#: Terms of one matrix product, and cells of rarer terms that are added at once.
TERMS, CELLS = 512, 1 << 21
#: Cells this much below the last place are rounded and compared.
MARGIN = 1e-5


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


@dataclass
class Chunk:
    """Some queries of a batch: weights that count, by term, and all terms, by query; queries are numbered from ``first``."""

    first: int
    size: int
    t: np.ndarray
    q: np.ndarray
    w: np.ndarray
    all_t: np.ndarray
    all_q: np.ndarray


@dataclass
class Batch:
    """``(query, term, weight)`` of a batch by query; ``terms`` are its distinct terms."""

    query_ids: np.ndarray
    terms: pa.Array
    q: np.ndarray
    t: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Batch:
        """From ``(query_id, lkey, _w)``."""
        coded = rows.column("lkey").combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        ids, q = np.unique(rows.column("query_id").to_numpy(), return_inverse=True)
        order = np.argsort(q, kind="stable")
        t, w = coded.indices.to_numpy(zero_copy_only=False), rows.column("_w").to_numpy()
        return cls(ids, coded.dictionary, q[order].astype(np.int32), t[order].astype(np.int32), w[order])

    def chunks(self) -> list[Chunk]:
        out = []
        for first in range(0, len(self.query_ids), QUERIES):
            size = min(QUERIES, len(self.query_ids) - first)
            at = slice(*np.searchsorted(self.q, [first, first + size]))
            q, t, w = self.q[at] - first, self.t[at], self.w[at]
            counts = np.flatnonzero(w != 0)
            by_term = counts[np.argsort(t[counts], kind="stable")]
            out.append(Chunk(first, size, t[by_term], q[by_term], w[by_term], t, q))
        return out


@dataclass
class Block:
    """Postings of some documents with the terms of the batch: by term, ``u`` the distinct terms, with their places."""

    doc_ids: np.ndarray
    u: np.ndarray
    start: np.ndarray
    count: np.ndarray
    d: np.ndarray
    x: np.ndarray


def blocks(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[Block]:
    """Of ``(doc_id, terms array<string>, impacts array<double>)``."""
    for rows in batches:
        doc_ids = rows.column("doc_id").to_numpy()
        held, x = rows.column("terms"), rows.column("impacts").flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
        t = pc.fill_null(pc.index_in(held.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
        d = np.repeat(np.arange(len(doc_ids)), np.diff(ends, prepend=0))
        for a in range(0, len(doc_ids), DOCS):
            b = min(a + DOCS, len(doc_ids))
            at = slice(ends[a - 1] if a else 0, ends[b - 1])
            own = np.flatnonzero(t[at] >= 0)
            own = own[np.argsort(t[at][own], kind="stable")]
            u, start, count = np.unique(t[at][own], return_index=True, return_counts=True)
            yield Block(doc_ids[a:b], u, start, count, d[at][own] - a, x[at][own])


def product(block: Block, chunk: Chunk) -> np.ndarray:
    """The sum of weight x impact of every query of the chunk and document of the block: common terms by matrix product, others cell by cell."""
    size = len(block.doc_ids)
    out = np.zeros((chunk.size, size))
    lo, hi = np.searchsorted(chunk.t, block.u, "left"), np.searchsorted(chunk.t, block.u, "right")
    asked = hi - lo
    cells = asked * block.count
    common = np.flatnonzero(cells * SPARSE > out.size)
    for a in range(0, len(common), TERMS):
        own = common[a : a + TERMS]
        n = len(own)
        at, to = _ranges(block.start[own], block.count[own]), np.repeat(np.arange(n), block.count[own])
        held = np.bincount(to * size + block.d[at], block.x[at], n * size).reshape(n, size)
        at, to = _ranges(lo[own], asked[own]), np.repeat(np.arange(n), asked[own])
        out += np.bincount(chunk.q[at] * n + to, chunk.w[at], chunk.size * n).reshape(chunk.size, n) @ held
    rare = np.flatnonzero((cells > 0) & (cells * SPARSE <= out.size))
    at = _ranges(block.start[rare], block.count[rare])
    first, times = np.repeat(lo[rare], block.count[rare]), np.repeat(asked[rare], block.count[rare])
    piece = np.cumsum(times) // CELLS
    flat = out.reshape(-1)
    for a, b in zip(*(np.searchsorted(piece, range(int(piece[-1]) + 1), side) for side in ("left", "right"))) if len(piece) else ():
        of, own = _ranges(first[a:b], times[a:b]), np.repeat(at[a:b], times[a:b])
        flat += np.bincount(chunk.q[of].astype(np.int64) * size + block.d[own], chunk.w[of] * block.x[own], flat.size)
    return out


def present(block: Block, chunk: Chunk) -> np.ndarray:
    """Whether a document of the block holds any term of a query of the chunk, as bits of each term's documents that are united."""
    size = len(block.doc_ids)
    out = np.zeros((chunk.size, size), bool)
    if not len(block.u):
        return out
    bits = []
    for a in range(0, len(block.u), TERMS):
        count = block.count[a : a + TERMS]
        some = np.zeros((len(count), size), bool)
        some[np.repeat(np.arange(len(count)), count), block.d[block.start[a] : block.start[a] + int(count.sum())]] = True
        bits.append(np.packbits(some, axis=1))
    bits = np.concatenate(bits)
    row = np.minimum(np.searchsorted(block.u, chunk.all_t), len(block.u) - 1)
    held = block.u[row] == chunk.all_t
    row, q = row[held], chunk.all_q[held]
    for a in range(0, chunk.size, 256):
        at = slice(*np.searchsorted(q, [a, a + 256]))
        own, start = np.unique(q[at], return_index=True)
        if len(own):
            out[own] = np.unpackbits(np.bitwise_or.reduceat(bits[row[at]], start, axis=0), axis=1, count=size)
    return out


def best(batches: Iterator[pa.RecordBatch], asked: Batch, k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """``(query_id, doc_id, score)``: the ``k`` best of a task's documents for each query, scores rounded, equal ones by doc_id.

    Documents without any term of a query are left out; while a query's last place isn't above 0 they are told apart by :func:`present`.
    """
    top = np.full((len(asked.query_ids), k), -np.inf)
    docs = np.full(top.shape, np.iinfo(np.int64).max)
    chunks = asked.chunks()
    for block in blocks(batches, asked.terms):
        for c in chunks:
            at = slice(c.first, c.first + c.size)
            last, last_doc = top[at, -1], docs[at, -1]
            score = product(block, c)
            low = np.flatnonzero(last <= 0)
            if len(low):
                some = np.where(present(block, c)[low], score[low], -np.inf)
                if some.shape[1] > k:
                    least = np.partition(some, -k, axis=1)[:, -k] - MARGIN
                    some[some < least[:, None]] = -np.inf
                score[low] = some
            q, d = np.nonzero((score >= (last - MARGIN)[:, None]) & (score > -np.inf))
            s, d = np.round(score[q, d], digits) + 0.0, block.doc_ids[d]
            better = (s > last[q]) | ((s == last[q]) & (d < last_doc[q]))
            q, s, d = q[better], s[better], d[better]
            if len(q):
                own = np.unique(q)
                q = np.concatenate([np.repeat(own, k), q])
                s, d = np.concatenate([top[at][own].ravel(), s]), np.concatenate([docs[at][own].ravel(), d])
                order = np.lexsort((d, -s, q))
                q, s, d = q[order], s[order], d[order]
                place = np.arange(len(q)) - np.repeat(np.searchsorted(q, own), np.diff(np.searchsorted(q, own), append=len(q)))
                kept = place < k
                top[c.first + q[kept], place[kept]] = s[kept]
                docs[c.first + q[kept], place[kept]] = d[kept]
    q, place = np.nonzero(top > -np.inf)
    yield pa.RecordBatch.from_arrays(
        [pa.array(asked.query_ids[q], pa.int64()), pa.array(docs[q, place], pa.int64()), pa.array(top[q, place], pa.float64())],
        names=["query_id", "doc_id", "score"],
    )


def candidates(batches: Iterator[pa.RecordBatch], asked: Batch) -> Iterator[pa.RecordBatch]:
    """``(query_id, docs array<bigint>)``: for each block and query the documents that hold a term of it."""
    chunks = asked.chunks()
    for block in blocks(batches, asked.terms):
        for c in chunks:
            held = present(block, c)
            q = np.flatnonzero(held.any(axis=1))
            _, d = np.nonzero(held[q])
            ends = np.cumsum(held[q].sum(axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(block.doc_ids[d], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(asked.query_ids[c.first + q], pa.int64()), lists], names=["query_id", "docs"])
