"""Token counts without ids: the pieces of each distinct pre-token are counted once, joined to the
documents' pre-token frequencies and summed.

The most widespread pre-tokens, a fixed number of bounded ones, are looked up in the task that splits
the document; the others meet their counts in a join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .common import table
from .registry import query

HEAD = 200_000          # pre-tokens looked up in the splitting task ...
HEAD_BYTES = 48         # ... none longer than this: under 20 MB in all
FLUSH = 400_000         # distinct pre-tokens a task gathers before it passes their counts on
LIMIT = 512


class Splitter:
    """Pre-tokens of a text by the tokenizer file's own rules.

    A text is cut into words with the space before them and what is left of white-space runs; each
    distinct cut is split once, by the library unless it is a plain word with or without a stop behind
    it. A text with other than ASCII white space is split whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self.pre, self.model = t.pre_tokenizer, t.model
        self.special = [x.content for x in t.get_added_tokens_decoder().values() if x.special]
        self._mark = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._cut = re.compile(r" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]")
        self._odd = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")
        self._plain = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+)([.,;:!?]+)?")

    def cuts(self, text: str) -> list[str]:
        """Parts that are split apart from each other: special strings and the cuts between them."""
        marked = self._mark.split(text) if self._mark and any(s in text for s in self.special) else [text]
        out: list[str] = []
        for part in marked:
            if part in self.special or not part.isprintable() and self._odd.search(part):
                out.append(part)
            else:
                out += self._cut.findall(part)
        return out

    def split(self, cut: str) -> list[str]:
        plain = self._plain.fullmatch(cut)
        if plain:
            return [cut] if plain[2] is None else [plain[1], plain[2]]
        if cut in self.special:
            return [cut]
        return [cut[a:b] for _, (a, b) in self.pre.pre_tokenize_str(cut)]

    def pieces(self, pretoken: str) -> int:
        """The model reads a pre-token's bytes as the library shows them."""
        if pretoken in self.special:
            return 1
        return len(self.model.tokenize("".join(p for p, _ in self.pre.pre_tokenize_str(pretoken))))


@lru_cache(2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def counted(cuts: Counter, s: Splitter) -> pa.RecordBatch:
    seen: Counter = Counter()
    for cut, n in cuts.items():
        for p in s.split(cut):
            seen[p] += n
    return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                      ["pretoken", "n"])


def lexicon(docs: DataFrame, path: str) -> DataFrame:
    """(pretoken, spread, pieces) of every distinct pre-token of all texts, each tokenized once; ``spread`` counts
    the documents of each distinct cut it stands in."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, seen = splitter(path), Counter()
        for batch in batches:
            for x in batch.column(0):
                seen.update(set(s.cuts(x.as_py() or "")))
                if len(seen) >= FLUSH:
                    yield counted(seen, s)
                    seen = Counter()
        yield counted(seen, s)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = splitter(path)
        for batch in batches:
            n = pa.array([s.pieces(p) for p in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], ["pretoken", "spread", "pieces"])

    seen = docs.select("text").mapInArrow(gather, "pretoken string, n bigint")
    distinct = seen.groupBy("pretoken").agg(F.sum("n").alias("spread"))
    return stage(distinct.mapInArrow(count, "pretoken string, spread bigint, pieces int"), "lexicon")


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text; the rest stays out).

    A null or empty text has no bytes and no tokens; rows that repeat and null ids are counted each.
    """
    known = lexicon(docs, path)
    common = known.where(F.octet_length("pretoken") <= HEAD_BYTES).orderBy(F.desc("spread"), "pretoken").limit(HEAD)
    head = docs.sparkSession.sparkContext.broadcast({r.pretoken: r.pieces for r in common.select("pretoken", "pieces").toLocalIterator()})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, of = splitter(path), head.value
        kept: dict[str, tuple[int, list[str]]] = {}

        def priced(cut: str) -> tuple[int, list[str]]:
            got = kept.get(cut)
            if got is None:
                parts = s.split(cut)
                got = sum(of.get(p, 0) for p in parts), [p for p in parts if p not in of]
                if len(cut) <= 64:
                    if len(kept) >= FLUSH // 2:
                        kept.clear()
                    kept[cut] = got
            return got

        for batch in batches:
            size, sums, names, freqs, ends = [], [], [], [], [0]
            for x in batch.column("text"):
                text, total = x.as_py() or "", 0
                for cut, n in Counter(s.cuts(text)).items():
                    k, rare = priced(cut)
                    total += k * n
                    for p in rare:
                        names.append(p)
                        freqs.append(n)
                size.append(len(text.encode("utf-8", "surrogatepass")))
                sums.append(total)
                ends.append(len(names))
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(freqs, pa.int64())], ["pretoken", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(sums, pa.int64()), rare],
                                             ["doc_id", "n_bytes", "head", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(
        split, f"doc_id {kind}, n_bytes bigint, head bigint, rare array<struct<pretoken:string,n:bigint>>")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    rare = rows.select("row", F.inline("rare"))
    rest = rare.join(known.select("pretoken", "pieces"), "pretoken").groupBy("row").agg(
        F.sum(F.col("n") * F.col("pieces")).alias("tail"))
    total = (F.col("head") + F.coalesce("tail", F.lit(0))).alias("n_tokens")
    return rows.select("row", "doc_id", "n_bytes", "head").join(rest, "row", "left").select(
        "doc_id", "n_bytes", total).withColumn("over_limit", F.col("n_tokens") > limit)


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), byte_vocabulary())
