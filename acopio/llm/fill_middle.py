"""Fill-in-middle: a text is cut at two unit ends into prefix, middle and suffix and laid out anew.

Units are lines. The cuts are found on the UTF-8 bytes of a whole batch, eight to a 64-bit word: the bytes that
end a unit are marked by arithmetic on the words, marks are counted per word, the k-th mark's word is found in
the running counts, and the mark inside its word by clearing the ones before it. Code points are counted the
same way. The seeded choice and the layout are columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .registry import query

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PART = 8 << 20     # bytes whose words are held at once; a longer text is a part of its own
_LOW7, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_ENDS, _ONE = np.uint64(0x0A0A0A0A0A0A0A0A), np.uint64(1)


@dataclass(frozen=True)
class Rates:
    """Production parameters: the seed, and the shares of texts that are cut and of cut texts laid out suffix first."""

    seed: int = 7
    cut: int = 100
    spm: int = 50


def words_of(raw: np.ndarray) -> np.ndarray:
    """The bytes as little-endian words, the last one filled with zeros."""
    full = np.zeros((len(raw) + 7) // 8 * 8, dtype=np.uint8)
    full[:len(raw)] = raw
    return full.view("<u8")


def unit_marks(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is a line feed; no carry leaves a byte, so there are no false marks."""
    x = words ^ _ENDS
    return ~(((x & _LOW7) + _LOW7) | x) & _HIGH


def later_bytes(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that continues a character (10xxxxxx)."""
    return words & ~(words << _ONE) & _HIGH


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes stand before byte ``at``."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        inside = np.append(self.marks, np.uint64(0))[word] & ((_ONE << (byte << np.uint64(3))) - _ONE)
        return self.before[word] + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the ``k``-th mark, from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        m, left = self.marks[word], k - self.before[word]
        for _ in range(7):
            more = left > 0
            m = np.where(more, m & (m - _ONE), m)
            left = left - more
        lowest = m & (~m + _ONE)
        return (word << 3) + (np.bitwise_count(lowest - _ONE).astype(np.int64) >> 3)


def cuts_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(units, prefix code points, middle code points) of the texts at bytes ``starts`` to ``ends`` of ``raw``."""
    words = words_of(raw)
    stop, later = Marks(unit_marks(words)), Marks(later_bytes(words))
    first, full = stop.rank(starts), ends > starts
    stops = stop.rank(ends) - first
    closed = np.zeros(len(starts), dtype=bool)
    closed[full] = raw[ends[full] - 1] == 0x0A
    n = stops + (full & ~closed)
    a, b = h1 % (n + 1), h2 % (n + 1)

    def byte_after(units: np.ndarray) -> np.ndarray:
        at = np.where(units > stops, ends, starts)
        inner = (units > 0) & (units <= stops)
        at[inner] = stop.select(first[inner] + units[inner] - 1) + 1
        return at

    lo, hi = byte_after(np.minimum(a, b)), byte_after(np.maximum(a, b))
    chars = lambda x, y: y - x - (later.rank(y) - later.rank(x))
    return n, chars(starts, lo), chars(lo, hi)


_CUT = "struct<n:bigint,prefix:bigint,middle:bigint>"


def cut(text: Column, h1: Column, h2: Column) -> Column:
    """struct(n, prefix, middle): lines of a text, and the code points of its prefix and middle, which end after
    the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) lines."""
    @F.arrow_udf(_CUT)
    def found(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        h = one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)
        parts, i = [(np.zeros(0, dtype=np.int64),) * 3], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + PART, side="right")) - 1)
            at = ends[i:j + 1] - ends[i]
            parts.append(cuts_of(raw[ends[i]:ends[j]], at[:-1], at[1:], h[0][i:j], h[1][i:j]))
            i = j
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["n", "prefix", "middle"])
    return found(text, h1, h2)


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def transform(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of ``docs`` (doc_id, text; the rest stays out).

    The draws follow from the seed and the decimal doc_id (empty for a null id), so rows of one id are cut by the
    same draws. A null text counts as empty; empty texts, texts that hold a sentinel, and those not drawn stay
    plain, with null prefix_chars and middle_chars. Repeated rows are kept; a text of any length is cut whole;
    an empty table gives an empty result.
    """
    digest = F.sha2(F.concat(F.lit(f"{rates.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.select("doc_id", "text", *[_draw(F.col("digest"), k).alias(f"h{k}") for k in (1, 2, 3, 4)])
    rows = rows.withColumn("c", cut(F.col("text"), F.col("h1"), F.col("h2")))
    marked = F.lit(False)
    for s in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("text"), F.lit(s))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rates.cut)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < rates.spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "c.n", form.alias("form"), F.col("c.prefix").cast("int").alias("p"),
                       F.col("c.middle").cast("int").alias("m"))
    rest = F.substr("text", F.col("p") + F.col("m") + 1, F.length("text"))
    prefix, middle = F.substr("text", F.lit(1), F.col("p")), F.substr("text", F.col("p") + 1, F.col("m"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), rest, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), rest, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    chars = lambda c: F.when(F.col("form") != "plain", F.col(c).cast("bigint"))
    return rows.select("doc_id", "n", "form", chars("p").alias("prefix_chars"), chars("m").alias("middle_chars"),
                       output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No part holds a sentinel, so splitting at them is exact."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second))
            .otherwise(F.concat(second, third, first)))


_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || substr(g, 1, 8) AS BIGINT) AS h1,
  CAST('0x' || substr(g, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(g, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(g, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256 FROM p
"""


@query("op13_fill_middle", _SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
