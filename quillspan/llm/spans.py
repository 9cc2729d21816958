"""Long exact spans shared between records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.winnow import anchors, window_hashes
from quillspan.runtime import written

#: Shortest span, in characters exactly as stored.
LEAST = 200
#: Characters of an anchor. Longer ones are fewer by chance, but stand closer together.
ANCHOR = 64
#: Occurrences of an anchor that are compared with each other in one task; the windows of more frequent ones are grouped instead.
COMPARED = 200
_CHARS_AT_ONCE = 4_000_000


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a batch in pieces of bounded size; a longer text comes alone."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        t = t.as_py()
        if ids and size + len(t) > _CHARS_AT_ONCE:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    if ids:
        yield ids, texts


# --- The method named: lines or paragraphs, normalised, their digests grouped globally -------------

def line_units(documents: DataFrame, least: int = 40) -> DataFrame:
    """``(doc_id, start, length, digest)`` of the lines of at least ``least`` characters after normalisation.

    Normalised: small letters, runs of white space read as one blank, trimmed. ``start`` and
    ``length`` are characters of the text as stored. Null texts give no line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = re.compile(r"[^\n]+")
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for m in line.finditer(text):
                    unit = " ".join(m[0].lower().split())
                    if len(unit) >= least:
                        out.append((doc, m.start(), len(m[0]), xxhash.xxh3_128_digest(unit.encode("utf-8", "surrogatepass"))))
            cols = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "digest"])

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, digest binary")


def repeated_lines(documents: DataFrame, least: int = 40) -> DataFrame:
    """``(doc_id, start, length, first_doc_id, first_start, repeated)`` of every line that occurs more than once.

    The earliest occurrence (doc_id, then start) of a digest is kept, ``repeated`` is true for
    the rest, which may be removed by their offsets. Digests have 128 bits. The group of a digest
    is aggregated before the shuffle and never collected; the join back splits hot digests.
    """
    units = written(line_units(documents, least), "lines")
    firsts = units.groupBy("digest").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "start")).alias("_first")
    ).where("_n > 1")
    first = (F.col("doc_id") == F.col("_first.doc_id")) & (F.col("start") == F.col("_first.start"))
    return units.join(firsts, "digest").select(
        "doc_id", "start", "length", F.col("_first.doc_id").alias("first_doc_id"), F.col("_first.start").alias("first_start"),
        (~first).alias("repeated"),
    )


# --- The same with units cut by content, which finds runs that lines cannot -----------------------

def anchor_units(documents: DataFrame, least: int = LEAST, k: int = ANCHOR) -> DataFrame:
    """``(hash, doc_id, pos)``: the anchors of all texts of at least ``least`` characters (:func:`~quillspan.llm.winnow.anchors`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for ids, texts in _batches(batch):
                owner, pos, h = anchors(texts, k, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.array(ids, dtype=np.int64)[owner]), pa.array(pos.astype(np.int32))],
                    ["hash", "doc_id", "pos"],
                )

    rows = documents.where((F.length("text") >= least) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    return rows.mapInArrow(run, "hash long, doc_id long, pos int")


_CONTEXT = "hash long, n long, doc_id long, pos int, left string, middle string, right string"


def _contexts(least: int, k: int, compared: int):
    """The text around every anchor that documents share: what a run of ``least`` characters across it can reach."""
    reach = least - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "n", "doc_id", "pos", "left", "middle", "right"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            out: list[tuple] = []
            for doc, text, own in zip(*(batch.column(c).to_pylist() for c in range(3))):
                for a in own:
                    p = a["pos"]
                    middle = text[p : p + k] if a["n"] > compared else ""
                    out.append((a["hash"], a["n"], doc, p, text[max(0, p - reach) : p], middle, text[p + k : p + k + reach]))
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return run


def _agree(a: str, b: str) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] does not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


_PAIRS = "doc_id_a long, doc_id_b long"
_COVERED = "doc_id long, start int, length int, repeated boolean"


def _compared(least: int, k: int, covered: bool):
    """Compares the occurrences of every anchor; the stretch must be sorted by hash.

    Occurrences of the same surroundings are one class, and classes are compared. Gives the pairs of documents or, ``covered``, what is
    shared around each occurrence, without pairs: all runs of an occurrence hold its anchor, so together they are one stretch, and whether an
    earlier or later document has part in a class shows in its smallest and greatest doc_id. At most two rows per occurrence.
    """

    def classes_of(group: list[tuple]) -> list[tuple[tuple[str, str], list[tuple[int, int]]]]:
        own: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for doc, pos, left, right in group:
            own.setdefault((left[::-1], right), []).append((doc, pos))
        return list(own.items())

    def pairs(group: list[tuple]) -> Iterator[tuple]:
        classes = [(around, sorted({doc for doc, _ in own})) for around, own in classes_of(group)]
        seen: set[tuple[int, int]] = set()
        for i, ((left, right), docs) in enumerate(classes):
            for (left2, right2), docs2 in classes[i:]:
                if _agree(left, left2) + k + _agree(right, right2) >= least:
                    seen.update((x, y) if x < y else (y, x) for x in docs for y in docs2 if x != y)
        yield from seen

    def stretches_of(group: list[tuple]) -> Iterator[tuple]:
        classes = classes_of(group)
        ends = [(min(own)[0], max(own)[0]) for _, own in classes]
        reach: dict[tuple[int, int, bool], tuple[int, int]] = {}
        for i, ((left, right), own) in enumerate(classes):
            for j, ((left2, right2), _) in enumerate(classes):
                back, on = _agree(left, left2), _agree(right, right2)
                if back + k + on < least:
                    continue
                for doc, pos in own:
                    for repeated, has_part in ((True, ends[j][0] < doc), (False, ends[j][1] > doc)):
                        if has_part:
                            b, o = reach.get((doc, pos, repeated), (0, 0))
                            reach[doc, pos, repeated] = max(b, back), max(o, on)
        for (doc, pos, repeated), (back, on) in reach.items():
            yield doc, pos - back, back + k + on, repeated

    runs = stretches_of if covered else pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "repeated"] if covered else ["doc_id_a", "doc_id_b"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_()] if covered else [pa.int64(), pa.int64()]
        out: list[tuple] = []

        def block() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        group: list[tuple] = []
        now = None
        for batch in batches:
            for h, *row in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if h != now:
                    for r in runs(group):
                        out.append(r)
                        if len(out) >= 50_000:
                            yield block()
                    group, now = [], h
                group.append(tuple(row))
        out.extend(runs(group))
        yield block()

    return run


_WINDOWS = "w1 long, w2 long, doc_id long, start int"


def _windows(least: int):
    """Every window of ``least`` characters around a very frequent anchor, by two independent 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            w1, w2, docs, starts = [], [], [], []
            for doc, pos, left, middle, right in zip(*(batch.column(c).to_pylist() for c in range(5))):
                chars = np.frombuffer((left + middle + right).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                a = window_hashes(chars, least)
                w1.append(a)
                w2.append(window_hashes(chars, least, 0x5BD1E995))
                docs.append(np.full(len(a), doc))
                starts.append(pos - len(left) + np.arange(len(a)))
            join = lambda x, t: np.concatenate(x).astype(t, copy=False) if x else np.empty(0, t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(join(w1, np.uint64).view(np.int64)), pa.array(join(w2, np.uint64).view(np.int64)),
                 pa.array(join(docs, np.int64)), pa.array(join(starts, np.int32))],
                ["w1", "w2", "doc_id", "start"],
            )

    return run


class SharedSpans:
    """Spans of at least ``least`` characters that stand verbatim in more than one document.

    1. Units are cut by content: anchors, of which any two equal stretches of ``least``
       characters share one. Their hashes are the digests that are grouped globally; digests of one document only are dropped.
    2. The text around each shared anchor, as far as a run of ``least`` characters can reach, is
       taken from the whole text (documents without shared anchor drop out in the join).
    3. Exact check: occurrences of an anchor are compared character by character. Anchors with
       more than ``compared`` occurrences take another way, exact but for collisions of 128-bit hashes: all their windows of ``least``
       characters are hashed and grouped, so no task holds a hot group.

    Null texts and texts shorter than ``least`` share nothing. Several spans of a pair, overlapping spans
    and spans repeated inside a document are all found; a repetition within one document only is not shared.
    Repeated rows of one doc_id count as one document. Rows with null doc_id are left out.
    """

    def __init__(self, documents: DataFrame, least: int = LEAST, k: int = ANCHOR, compared: int = COMPARED):
        if not 0 < k <= least:
            raise ValueError("the anchor must not be longer than the span")
        self.documents, self.least = documents, least
        units = written(anchor_units(documents, least, k), "anchors")
        shared = units.groupBy("hash").agg(
            F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")
        ).where("_a < _b").select("hash", "n")
        own = units.join(shared, "hash").groupBy("doc_id").agg(F.collect_list(F.struct("hash", "n", "pos")).alias("own"))
        texts = documents.where(F.length("text") >= least).select("doc_id", "text")
        around = written(
            texts.join(own, "doc_id").select("doc_id", "text", "own").mapInArrow(_contexts(least, k, compared), _CONTEXT), "contexts"
        )
        some = around.where(F.col("n") <= compared).repartition("hash").sortWithinPartitions("hash")
        some = some.select("hash", "doc_id", "pos", "left", "right")
        self._pairs = some.mapInArrow(_compared(least, k, False), _PAIRS)
        self._covered = some.mapInArrow(_compared(least, k, True), _COVERED)
        hot = around.where(F.col("n") > compared).select("doc_id", "pos", "left", "middle", "right")
        windows = hot.mapInArrow(_windows(least), _WINDOWS).distinct()
        both = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b")
        self.windows = windows.join(both, ["w1", "w2"]).select("w1", "w2", "doc_id", "start", F.col("_a").alias("first"))

    def pairs(self) -> DataFrame:
        """``(doc_id_a, doc_id_b)``, doc_id_a < doc_id_b: every pair that shares a span. As many rows as there are such pairs.

        A passage gives as many windows as it has characters beyond ``least``, nearly all in the same documents. Of windows with the same
        set of documents (their number and 128 bits of the xor of their hashes) one is kept, so a set is paired once.
        """
        held = written(self.windows.select("w1", "w2", "doc_id").distinct(), "windows")
        sets = held.groupBy("w1", "w2").agg(
            F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("doc_id")).alias("_x"), F.bit_xor(F.xxhash64("doc_id", F.lit(7))).alias("_y")
        )
        kept = sets.groupBy("_n", "_x", "_y").agg(F.min(F.struct("w1", "w2")).alias("_w")).select("_w.w1", "_w.w2")
        once = held.join(kept, ["w1", "w2"])
        a = once.select("w1", "w2", F.col("doc_id").alias("doc_id_a"))
        b = once.select("w1", "w2", F.col("doc_id").alias("doc_id_b"))
        far = a.join(b, ["w1", "w2"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
        return self._pairs.unionByName(far).distinct()

    def spans(self) -> DataFrame:
        """``(doc_id, start, length, repeated)``: the shared stretches of every document, disjoint, merged where they overlap or touch.

        ``repeated`` stretches stand in an earlier document (smaller doc_id) too and can be removed by their
        offsets; the others are the earliest occurrence, less what repeated stretches of the same document cover (so they may be
        shorter than ``least``). Both ways of comparing give the same rows.
        """
        far = self.windows.select("doc_id", "start", F.lit(self.least).alias("length"), (F.col("doc_id") > F.col("first")).alias("repeated"))
        return stretches(self._covered.unionByName(far))

    def report(self) -> DataFrame:
        """``(doc_id, n_chars, shared_chars, repeated_chars, shared_part)``, one row per document; 0 where nothing is shared."""
        chars = self.spans().groupBy("doc_id").agg(
            F.sum("length").alias("shared_chars"), F.sum(F.when(F.col("repeated"), F.col("length"))).alias("repeated_chars")
        )
        n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
        rows = self.documents.select("doc_id", n.alias("n_chars")).join(chars, "doc_id", "left")
        rows = rows.fillna(0, ["shared_chars", "repeated_chars"])
        return rows.withColumn("shared_part", F.coalesce(F.col("shared_chars") / F.nullif("n_chars", F.lit(0)), F.lit(0.0)))


def linked_classes(documents: DataFrame, least: int = LEAST, k: int = ANCHOR) -> DataFrame:
    """``(doc_id, class_id, copies, n_links)``, one row per document.

    Documents of exactly the same text (128-bit digest) are one class, named by its smallest doc_id; ``copies`` is
    its size. Only representatives are compared, so copies are never paired with each other; ``n_links`` is the number of
    other classes that share a span of at least ``least`` characters. Null texts and null doc_ids are classes of their own without links.
    """
    digests = documents.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.md5("text")).alias("_d"))
    known = digests.where("_d is not null")
    known = known.distinct()
    classes = written(known.groupBy("_d").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "text-classes")
    member = known.join(classes, "_d").select("doc_id", "class_id", "copies")
    member = member.unionByName(digests.where("_d is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies")))
    member = written(member, "classes")
    firsts = classes.select(F.col("class_id").alias("doc_id"))
    pairs = SharedSpans(documents.select("doc_id", "text").join(firsts, "doc_id", "left_semi"), least, k).pairs()
    ends = pairs.select(F.col("doc_id_a").alias("class_id")).union(pairs.select("doc_id_b"))
    links = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return member.join(links, "class_id", "left").select("doc_id", "class_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def stretches(spans: DataFrame) -> DataFrame:
    """Disjoint ``(doc_id, start, length, repeated)``: what repeated spans cover, and what only the others cover.

    A sweep over the ends of a document's spans, which are added up per position before the shuffle.
    """
    ends = spans.select("doc_id", "repeated", F.explode(F.array(
        F.struct(F.col("start").alias("start"), F.lit(1).alias("step")),
        F.struct((F.col("start") + F.col("length")).alias("start"), F.lit(-1).alias("step")),
    )).alias("_end")).select("doc_id", "repeated", "_end.*")
    steps = ends.groupBy("doc_id", "start").agg(
        F.sum(F.when(F.col("repeated"), F.col("step")).otherwise(0)).alias("_again"), F.sum(F.when(F.col("repeated"), 0).otherwise(F.col("step"))).alias("_first")
    )
    along = Window.partitionBy("doc_id").orderBy("start")
    open_ = along.rowsBetween(Window.unboundedPreceding, 0)
    covered = F.when(F.sum("_again").over(open_) > 0, True).when(F.sum("_first").over(open_) > 0, False)  # null: by none
    points = steps.select("doc_id", "start", covered.alias("repeated"))
    changes = points.withColumn("_same", F.lag("repeated").over(along).eqNullSafe(F.col("repeated"))).where(~F.col("_same"))
    lengths = changes.select("doc_id", "start", (F.lead("start").over(along) - F.col("start")).alias("length"), "repeated")
    return lengths.where("repeated is not null")
