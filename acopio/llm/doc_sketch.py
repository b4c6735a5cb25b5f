"""Document fingerprints: invertible Bloom lookup sketches of a text's passages.

A text is cut into passages (behind line feeds and sentence ends); each is hashed, and the hash goes into one
cell of each of three tables: a count, the exclusive or of the hashes, and of a check on them. Two versions'
sketches are subtracted cell by cell, so that common passages cancel; a cell left with one hash gives it away,
and taking it out of its other cells lays further ones bare, until the difference is known hash by hash. Where the
peeling gets stuck, the two versions are sketched anew with four times the cells. Likeness is what two texts have
in common of all their passages, counted with repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import table
from .registry import query

TABLES = 3
CELLS = 12           # of a fingerprint, over its three tables
GROW = 4             # by which a sketch grows when peeling fails
HELD = 1 << 21       # cells that are peeled at once; more are worked off in parts
SLICE = 2 << 20      # characters of documents that are compared at once; a longer text goes alone
_PASSAGE = re.compile(rb"[^.!?\n]+[.!?\n ]*|[.!?\n ]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)
_CHECK, _REPEAT = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xBF58476D1CE4E5B9)
_CELL = np.dtype([("count", ">i4"), ("key", ">u8"), ("check", ">u4")])


def digests(text: str) -> np.ndarray:
    """A 64-bit hash for each passage of a text; the k-th repeat of one passage has a hash of its own."""
    h = xxhash.xxh64_intdigest
    out = np.array([h(p) for p in _PASSAGE.findall(text.encode("utf-8", "surrogatepass"))], dtype=np.uint64)
    if len(out) > 1:
        order = np.argsort(out, kind="stable")
        new = np.concatenate([[True], out[order][1:] != out[order][:-1]])
        if not new.all():
            at = np.arange(len(out))
            nth = np.empty(len(out), dtype=np.uint64)
            nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
            mixed = (out + nth * _REPEAT) * _MIX[0]
            out = np.where(nth > 0, mixed ^ (mixed >> np.uint64(31)), out)
    return out


def places(found: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each hash in each of the three tables."""
    size = np.uint64(cells // TABLES)
    spread = (found[None, :] * _MIX[:, None]) >> np.uint64(29)
    return (spread % size).astype(np.int64) + np.arange(TABLES)[:, None] * (cells // TABLES)


def check_of(found: np.ndarray) -> np.ndarray:
    return (found * _CHECK) >> np.uint64(32)


class Cells:
    """Sketches of ``n`` texts, ``cells`` cells each, side by side."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, dtype=np.int64)
        self.key, self.check = np.zeros(n * cells, dtype=np.uint64), np.zeros(n * cells, dtype=np.uint64)

    def change(self, owner: np.ndarray, found: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Count hash ``found`` of text ``owner`` ``by`` times more; the cells it went into."""
        at, check = places(found, self.cells) + owner * self.cells, check_of(found)
        for row in at:
            np.add.at(self.count, row, by)
            np.bitwise_xor.at(self.key, row, found)
            np.bitwise_xor.at(self.check, row, check)
        return at

    @classmethod
    def of(cls, sets: list[np.ndarray], cells: int) -> Cells:
        out = cls(len(sets), cells)
        flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
        out.change(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), flat, np.ones(len(flat), dtype=np.int64))
        return out

    def take(self, rows: np.ndarray) -> Cells:
        out = Cells(len(rows), self.cells)
        for name in ("count", "key", "check"):
            setattr(out, name, getattr(self, name).reshape(self.n, self.cells)[rows].ravel())
        return out

    def minus(self, other: Cells) -> Cells:
        out = Cells(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def pack(self, sizes: list[int]) -> list[bytes]:
        """The texts' fingerprints: the number of passages, then the cells."""
        flat = np.empty(len(self.count), dtype=_CELL)
        flat["count"], flat["key"], flat["check"] = self.count, self.key, self.check
        width = self.cells * _CELL.itemsize
        raw = flat.tobytes()
        return [n.to_bytes(4, "big") + raw[i * width:(i + 1) * width] for i, n in enumerate(sizes)]


def peel(left: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, sign, whole) of a difference of sketches, which is used up: each hash laid bare, 1 if the
    first version has it and -1 if the second; and per text whether nothing else is left in its cells."""
    owners, hashes, signs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    look = np.flatnonzero(left.count)
    for _ in range(4 * left.cells):     # each pass takes a hash out; only a false check could go on longer
        look = look[np.abs(left.count[look]) == 1]
        look = look[left.check[look] == check_of(left.key[look])]
        if not len(look):
            break
        found, owner, sign = left.key[look], look // left.cells, left.count[look]
        order = np.lexsort((found, owner))
        found, owner, sign = found[order], owner[order], sign[order]
        once = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])
        found, owner, sign = found[once], owner[once], sign[once]
        look = np.unique(left.change(owner, found, -sign))
        owners.append(owner)
        hashes.append(found)
        signs.append(sign)
    rest = (left.count != 0) | (left.key != 0) | (left.check != 0)
    return np.concatenate(owners), np.concatenate(hashes), np.concatenate(signs), ~rest.reshape(left.n, left.cells).any(axis=1)


def differing(a: list[np.ndarray], b: list[np.ndarray], first: Cells | None = None) -> Iterator[tuple]:
    """(owner, hash, sign) arrays that together hold the hashes which only one of ``a[i]`` and ``b[i]`` has.

    ``first``: the difference of their fingerprints, if at hand. What it cannot give away is sketched again, larger.
    """
    pending, cells = np.arange(len(a)), CELLS
    while len(pending):
        failed = []
        step = max(1, HELD // cells)
        for i in range(0, len(pending), step):
            part = pending[i:i + step]
            if first is not None and cells == first.cells:
                left = first.take(part)
            else:
                left = Cells.of([a[k] for k in part], cells).minus(Cells.of([b[k] for k in part], cells))
            owner, found, sign, whole = peel(left)
            good = whole[owner]
            yield part[owner[good]], found[good], sign[good]
            failed.append(part[~whole])
        pending, cells = np.concatenate(failed), cells * GROW


def likeness(a: list[np.ndarray], b: list[np.ndarray], first: Cells | None = None) -> np.ndarray:
    """Per pair, the passages in common as a share of all; 1 for two without any."""
    only = np.zeros(len(a), dtype=np.int64)
    both = np.array([len(x) for x in a], dtype=np.int64)
    size = both + np.array([len(x) for x in b], dtype=np.int64)
    for owner, _, sign in differing(a, b, first):
        np.add.at(only, owner, sign > 0)
    common = both - only
    return np.where(size > 0, common / np.maximum(size - common, 1), 1.0)


def fingerprint(text: Column) -> Column:
    """A text's sketch as binary; a null text counts as empty. Equal texts have equal ones."""
    @F.arrow_udf("binary")
    def fp(texts: pa.Array) -> pa.Array:
        out: list[bytes] = []
        for part in _slices([x.as_py() or "" for x in texts]):
            sets = [digests(t) for t in part]
            out += Cells.of(sets, CELLS).pack([len(s) for s in sets])
        return pa.array(out, pa.binary())
    return fp(text)


def recovered(a: Column, b: Column) -> Column:
    """struct(only_a, only_b): the passages' hashes that only one of two texts has; null texts count as empty."""
    @F.arrow_udf("struct<only_a:array<bigint>,only_b:array<bigint>>")
    def both(one: pa.Array, two: pa.Array) -> pa.Array:
        sets = [[digests(x.as_py() or "") for x in side] for side in (one, two)]
        only: list[list[list[int]]] = [[[] for _ in one], [[] for _ in one]]
        for owner, found, sign in differing(*sets):
            for o, h, s in zip(owner.tolist(), found.view(np.int64).tolist(), sign.tolist()):
                only[s < 0][o].append(h)
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array([sorted(x) for x in side], kind) for side in only], ["only_a", "only_b"])
    return both(a, b)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as many of the first code points of ``after``, or all."""
    k = len(text) // 2
    return text[:len(text) - k] + after[:k]


_DONE, _FIRST, _OPEN = 0, 1, 2
_FIELDS = [("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()),
           ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
           ("text", pa.string())]
_ROWS = ("part int, kind int, doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
         "near_edited double, near_next double, text string")


def _compared(part: int, ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
    """Finished rows of documents and the ones after them."""
    known: dict[str, np.ndarray] = {}
    own, then = ([known[t] if t in known else known.setdefault(t, digests(t)) for t in side] for side in (texts, after))
    changed = [edited(t, a) for t, a in zip(texts, after)]
    new = [digests(t) for t in changed]
    mine, theirs, next_ = (Cells.of(s, CELLS) for s in (own, new, then))
    columns = [[part] * len(ids), [_DONE] * len(ids), ids, [len(t) for t in texts],
               [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in changed],
               mine.pack([len(s) for s in own]), theirs.pack([len(s) for s in new]),
               likeness(own, new, mine.minus(theirs)), likeness(own, then, mine.minus(next_)), [None] * len(ids)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [n for n, _ in _FIELDS])


def _kept(part: int, kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
    row = [part, kind, doc_id, *[None] * 6, text]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _FIELDS)], [n for n, _ in _FIELDS])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the documents of one range, in order, each with the one after it. The first of the range is passed
    on for the range before, and the last for the one behind."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
        done = 0
        for piece in _slices(texts):
            these = ids[done:done + len(piece)]
            done += len(piece)
            if held is None:
                yield _kept(part, _FIRST, these[0], piece[0])
                before, texts_ = [], []
            else:
                before, texts_ = [held[0]], [held[1]]
            before, texts_ = before + these, texts_ + piece
            held = before[-1], texts_[-1]
            if len(before) > 1:
                yield _compared(part, before[:-1], texts_[:-1], texts_[1:])
    if held is not None:
        yield _kept(part, _OPEN, *held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            part, doc_id, text, after = (c[i].as_py() for c in batch.columns)
            yield _compared(part, [doc_id], [text], [after])


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of ``docs``
    (doc_id BIGINT, text; the rest stays out); hashes and fingerprints as lowercase hex.

    The next document is the one behind in order of doc_id; rows without id stand first, rows of one id in order of
    a hash of their text, equal rows behind each other; the one after the last is the first. A null text counts as
    empty; two texts without passages are alike; a table of one row has itself as next; an empty one stays empty.

    Texts move once, into ranges of the order. A task walks through its range and holds one document besides the
    slice at hand; first and last documents of ranges, one of each per range, meet in a join.
    """
    order = ["doc_id", "h", "row"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    walked = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_walk, _ROWS), "versions")
    first = walked.where(F.col("kind") == _FIRST).select(F.col("part").alias("next"), F.col("text").alias("after"))
    last = walked.where(F.col("kind") == _OPEN).select("part", "doc_id", "text")
    # one number per range
    behind = last.select("part").withColumn("next", F.lead("part").over(Window.orderBy("part")))
    behind = behind.withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy(F.lit(1)))))
    met = last.join(behind, "part").join(first, "next").select("part", "doc_id", "text", "after").mapInArrow(_meet, _ROWS)
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return walked.where(F.col("kind") == _DONE).union(met).select(
        "doc_id", "n_chars", hexed("edited_sha256"), hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")


@query("op12_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(table(spark, sf_dir, "documents"))
