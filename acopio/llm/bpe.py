"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

From the merge list follows how many symbols behind a token can still change it (``lookahead``). A long
run is encoded window by window: tokens that end before the window's last ``lookahead`` symbols are
final and leave, the rest waits for the next window, so memory stays constant. White space ends every
pre-token of a word vocabulary, so words are encoded on their own and the frequent ones kept.
Decoding turns ids back one at a time, holding at most an unfinished character.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query

KEPT = 24 << 20         # bytes, as reckoned, of one of two generations of words, and of pre-tokens, that a worker keeps
ENTRY = 200             # bytes that a kept word takes besides its letters and ids
LONG_WORD = 64          # longer words and pre-tokens are not kept
STEP = 4096             # ids that are decoded together
CHUNK = 1 << 16         # bytes of a text that are split into words together
PART = 1 << 20          # bytes of texts whose results leave a task together; a longer text goes alone


class Merges:
    """A merge list over the numbers of ``vocab``: the rank of each pair, what it becomes, and the lookahead
    that settles a token."""

    def __init__(self, pairs: list[tuple[str, str]], vocab: dict[str, int], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.symbol = {i: s for s, i in vocab.items()}
        self.rank = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.becomes = [vocab[a + b] for a, b in pairs]
        made: dict[str, tuple[str, str]] = {}
        reach: dict[str, int] = {}      # symbol -> symbols that the rules so far look at beyond it
        self.lookahead, self.longest, self.proper = 0, 1, True
        for a, b in pairs:
            if any(len(self._plain(x)) > 1 and x not in made for x in (a, b)):
                self.proper = False     # a rule before its parts: nothing bounds what can follow
            ahead, part = reach.get(b, 0), b
            while part in made:         # the right edge of b, where an earlier rule could take it apart
                part = made[part][1]
                ahead = max(ahead, reach.get(part, 0))
            size = len(self._plain(b)) + ahead
            reach[a] = max(reach.get(a, 0), size)
            made.setdefault(a + b, (a, b))
            self.lookahead = max(self.lookahead, size)
            self.longest = max(self.longest, len(self._plain(a + b)))

    def _plain(self, symbol: str) -> str:
        return symbol[:-len(self.suffix)] if self.suffix and symbol.endswith(self.suffix) else symbol

    def _join(self, parts: list[int]) -> list[int]:
        """The lowest ranked pair first, from the left, until no pair is left."""
        rank, becomes, none = self.rank.get, self.becomes, len(self.becomes)
        ranks = [rank(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] = new = becomes[best]
            del ranks[i], parts[i + 1]
            if i < len(ranks):
                ranks[i] = rank(new << 32 | parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | new, none)
        return parts

    def ids(self, run: str) -> Iterable[int]:
        """Ids of one pre-token, emitted once nothing that follows can change them."""
        if len(run) > self.lookahead:
            return self._stream(run)
        return self._join(self._symbols(run, True))

    def tokens(self, run: str) -> list[str]:
        return [self.symbol[i] for i in self.ids(run)]

    def _merge(self, parts: list[str]) -> list[str]:
        return [self.symbol[i] for i in self._join([self.vocab[p] for p in parts])]

    def _symbols(self, part: str, ends: bool) -> list[int]:
        vocab = self.vocab
        parts = [vocab[c] for c in part]
        if ends and self.suffix:
            parts[-1] = vocab[part[-1] + self.suffix]
        return parts

    def _stream(self, run: str) -> Iterator[int]:
        at, window = 0, self.lookahead + 4 * self.longest
        while self.proper and len(run) - at > window:
            done, limit = 0, window - self.lookahead
            for i in self._join(self._symbols(run[at:at + window], False)):
                size = len(self._plain(self.symbol[i]))
                if done + size > limit:
                    break
                done += size
                yield i
            at += done
        yield from self._join(self._symbols(run[at:], True))


class Kept(dict):
    """What ``make`` gives for a short key, kept for two generations of ``KEPT`` bytes, so that frequent ones stay; longer
    ones are made anew."""

    def __init__(self, make: Callable):
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, key: str | bytes) -> bytes:
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= LONG_WORD:
            self.held += ENTRY + len(key) + len(made)
            if self.held > KEPT:
                self.old = dict(self)
                self.clear()
                self.held = ENTRY + len(key) + len(made)
            self[key] = made
        return made


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _split(raw: bytes) -> Iterator[bytes]:
    """The words of a text; no more than a chunk of them is held, or one long word."""
    at, n = 0, len(raw)
    while at < n:
        stop = _BLANK.search(raw, at + CHUNK) if at + CHUNK < n else None
        end = stop.start() if stop else n
        yield from raw[at:end].split()
        at = end


class Codec:
    """A tokenizer file's encoder and decoder. Its own rules for normal forms and pre-tokens apply."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self._pre, self._norm = (lambda t: (t.pre_tokenizer, t.normalizer))(Tokenizer.from_file(path))
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(pairs, self.vocab, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pieces = {i: p for p, i in self.vocab.items()} | {i: p for p, i in self.special.items()}
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        # ids are kept as 4-byte numbers end to end
        self._runs = Kept(lambda run: array("i", self.merges.ids(run)).tobytes())
        self._words = Kept(lambda word: self._word(word.decode("utf-8", "replace")))
        self._shown = {b: c for c, b in byte_of_char().items()}
        # words whose lower case is their normal form and whose pre-tokens are the word and the stop behind it;
        # left to the library where the file has other rules
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self._plain = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0132-\u0148\u014a-\u017f]+)([.,;:!?*%&$#|]*)") if kinds == [
            "NFC", "Replace", "Lowercase"] and self.merges.suffix else None

    def _word(self, word: str) -> bytes:
        plain = self._plain.fullmatch(word) if self._plain else None
        if not plain:
            return array("i", self._ids(word)).tobytes()
        shown, letters = self._shown, plain[1].lower()
        ids = self._runs[letters if letters.isascii() else "".join([shown[b] for b in letters.encode()])]
        return ids + self._runs[plain[2]] if plain[2] else ids

    def _ids(self, segment: str) -> Iterator[int]:
        for part in self._special.split(segment):
            if part in self.special:
                yield self.special[part]
            elif part:
                text = self._norm.normalize_str(part) if self._norm else part
                for run, _ in self._pre.pre_tokenize_str(text):
                    yield from self.merges.ids(run)

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as 4-byte numbers, a word at a time. ASCII white space always ends a pre-token here and leaves none itself."""
        return map(self._words.__getitem__, _split(text.encode("utf-8", "surrogatepass")))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text, an id at a time; an id outside the vocabulary says nothing."""
        if not self.byte_level:
            gap, ids, piece = "", iter(ids), self.pieces.get
            while part := list(islice(ids, STEP)):
                if known := [p for p in map(piece, part) if p is not None]:
                    yield gap + " ".join(known)
                    gap = " "
            return
        state, of = codecs.getincrementaldecoder("utf-8")("replace"), byte_of_char()
        for i in ids:
            piece = self.pieces.get(i, "")
            yield state.decode(piece.encode() if piece in self.special else bytes(of[c] for c in piece))
        yield state.decode(b"", True)


@lru_cache(1)
def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies show printable Latin-1 bytes as themselves and the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        shown[chr(0x100 + k)] = b
    return shown


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(texts: pa.Array, path: str) -> pa.Array:
    c, flat, ends = codec(path), bytearray(), [0]
    for x in texts:
        for word in c.encode(x.as_py() or ""):
            flat += word
        ends.append(len(flat) // 4)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32), pa.int32()))


def _decoded(lists: pa.Array, path: str) -> pa.Array:
    c = codec(path)
    flat, ends = lists.flatten().to_numpy(), [0]
    for n in lists.value_lengths():
        ends.append(ends[-1] + (n.as_py() or 0))
    return pa.array(["".join(c.decode(flat[a:b].tolist())) for a, b in zip(ends, ends[1:])], pa.string())


def encode(text: Column, path: str) -> Column:
    """array<int> of ids; a null text counts as empty and has none."""
    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _encoded(texts, path)
    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids; a null array gives an empty text."""
    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        return _decoded(lists, path)
    return texts(ids)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for each row of ``docs`` (doc_id, text; other columns stay out).

    Null and empty texts have no ids and an empty decoded text; rows that repeat and null ids are kept;
    a text of any length is encoded whole.
    """
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pa.default_memory_pool().release_unused()     # what the last batch, or the worker's last task, left
            at = 0
            sizes = [n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()]
            while at < batch.num_rows:
                end, held = at + 1, sizes[at]
                while end < batch.num_rows and held + sizes[end] <= PART:
                    held += sizes[end]
                    end += 1
                part = batch.slice(at, end - at)
                ids = _encoded(part.column(1), path)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, _decoded(ids, path)], ["doc_id", "ids", "decoded"])
                at = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(both, f"doc_id {kind}, ids array<int>, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents"), word_vocabulary()))
