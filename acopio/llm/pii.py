"""Personal data: exact patterns, then terms that reveal what the patterns found.

Protected entities are the pattern matches. A term reveals an entity to the degree that the corpus shows the two in
the same texts: their pointwise mutual information as a share of the entity's information content. Everything is
counted in different texts, so copies weigh as one. Terms from a threshold on become spans wherever they stand; all
spans can be generalised or removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import attach, fits_broadcast
from ..session import pin, stage
from .common import table
from .registry import query

KINDS = ("email", "ip", "card", "phone", "term")
FLUSH = 48 << 20   # bytes, as reckoned, of the words that a task gathers before it passes their counts on
ENTRY = 120        # bytes that a gathered word takes besides its letters

# Patterns of the contract. A run of digits is entered at its start only, where a match can begin.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_TERM = re.compile(r"[^\W\d_]{3,}")


@dataclass(frozen=True)
class Disclosure:
    """Production parameters."""

    min_texts: int = 3        # different texts that show an entity, and a term with it
    prior: float = 1.0        # texts that a term is taken to stand in without the entity, besides those seen
    threshold: float = 0.9    # least share of the entity's information that a term gives away


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; the part before an @ is read backwards, so long runs are read once."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; code points, end exclusive."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


_SPAN = "struct<start:int,kind:int,end:int>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_TERM_KIND = len(KINDS) - 1


def entity_of(text: str, span: tuple[int, int, int]) -> str:
    """What a span names: the same address or number however it is written."""
    a, kind, b = span
    return f"{KINDS[kind]}:{text[a:b].lower() if kind < 2 else re.sub('[^0-9]', '', text[a:b])}"


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the terms of a text that no span touches. Both are in order, so each is passed once."""
    if not spans:
        yield from (m.span() for m in _TERM.finditer(text))
        return
    at, reach = 0, 0        # reach: the furthest end of the spans that begin before the term's end
    for m in _TERM.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if reach <= m.start():
            yield m.span()


def term_set(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    if not spans:
        return {t.lower() for t in _TERM.findall(text)}
    return {text[a:b].lower() for a, b in terms_of(text, spans)}


def _evidence(keyed: DataFrame) -> DataFrame:
    """(kind, key, what, n) of ``keyed`` (text, key, share): with kind 0 the entities of each text, with kind 1 in how
    many different texts each term stands. A copy counts for its share, so that all copies count for one; tasks add up
    before the shuffle, and pass their counts on by size."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, float] = {}
        size = 0
        for batch in batches:
            found: set[tuple[int, str]] = set()
            for x, key, share in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = x.as_py()
                spans = base_spans(text)
                found.update((key, entity_of(text, s)) for s in spans)
                for t in term_set(text, spans):
                    n = held.get(t)
                    if n is None:
                        size += ENTRY + len(t)
                        held[t] = share
                    else:
                        held[t] = n + share
                if size >= FLUSH:
                    yield rows(1, [0] * len(held), list(held), list(held.values()))
                    held, size = {}, 0
            yield rows(0, [k for k, _ in found], [e for _, e in found], [0.0] * len(found))
        yield rows(1, [0] * len(held), list(held), list(held.values()))

    def rows(kind: int, key: list, what: list, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(key), pa.int32()), pa.array(key, pa.int64()), pa.array(what, pa.string()),
                                           pa.array(n, pa.float64())], ["kind", "key", "what", "n"])

    found = keyed.select("text", "key", "share").mapInArrow(gather, "kind int, key bigint, what string, n double")
    return found.groupBy("kind", "key", "what").agg(F.sum("n").alias("n"))


def _text_terms(texts: DataFrame) -> DataFrame:
    """(key, term) of ``texts`` (key, text): the terms of each."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py()
                terms = sorted(term_set(text, base_spans(text)))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(terms), pa.int64()), pa.array(terms, pa.string())], ["key", "term"])
    return texts.select("key", "text").mapInArrow(each, "key bigint, term string")


def revealing(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """(entity, term, n_entity, n_term, n_both, disclosure) of the pairs from the threshold on.

    All numbers count different texts of ``docs`` (text). disclosure is the pointwise mutual information of term and
    entity as a share of the entity's information, with the chance of the entity given the term taken as
    n_both / (n_term + prior). Only entities and pairs in at least ``min_texts`` different texts are judged.
    """
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    texts = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies")), "pii-texts")
    n = float(texts.count())
    copied = texts.where("copies > 1")
    shared = attach(keyed, copied, ["key"], "left", ready=True).withColumn("share", 1 / F.coalesce("copies", F.lit(1)).cast("double"))
    evidence = stage(_evidence(shared), "pii-evidence")
    held = evidence.where("kind = 0").select("key", F.col("what").alias("entity"))
    known = stage(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= rules.min_texts), "pii-entities")
    # a term that stands in more texts than this cannot reveal the entity
    most = (F.col("n_entity") * F.pow(F.lit(n) / F.col("n_entity"), 1 - rules.threshold) - rules.prior).alias("most")
    widest = known.agg(F.max(most)).first()[0] or 0.0
    terms = evidence.where("kind = 1").select(F.col("what").alias("term"), F.round("n").cast("bigint").alias("n_term"))
    terms = terms.where(F.col("n_term").between(rules.min_texts, int(widest) + 1))
    of = stage(held.join(known, "entity").select("key", "entity", "n_entity", most), "pii-known")
    mine = attach(keyed, of.select("key").distinct(), ["key"], "left_semi").dropDuplicates(["key"])
    near = _text_terms(mine).join(terms, "term").join(of, "key").where(F.col("n_term") <= F.col("most") + 1)
    both = near.groupBy("entity", "term", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= rules.min_texts)
    information = F.log(F.lit(n) / F.col("n_entity"))
    mutual = F.log(F.lit(n) * F.col("n_both") / (F.col("n_entity") * (F.col("n_term") + rules.prior)))
    share = F.when(information > 0, mutual / information).otherwise(0.0).alias("disclosure")
    return both.select("*", share).where(F.col("disclosure") >= rules.threshold)


def _marked(text: str, terms: frozenset) -> tuple[list, list]:
    """A text's pattern matches, and the spans of its terms that are in ``terms``."""
    spans = base_spans(text)
    if not terms or terms.isdisjoint(term_set(text, spans)):
        return spans, []
    return spans, [(a, _TERM_KIND, b) for a, b in terms_of(text, spans) if text[a:b].lower() in terms]


def _rows(spans: list[list[tuple]]) -> pa.Array:
    return pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in spans], _SPANS)


def find(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """(doc_id, text, spans, terms) per row of ``docs`` (doc_id, text; the rest stays out): spans by pattern, and the
    spans of revealing terms, wherever in the corpus they stand outside of those.

    Null and empty texts have no spans; repeated rows and null ids are kept, and copies of a text weigh as one; a text
    of any length is read whole; an empty table gives an empty result. The terms to mark are broadcast if they are few
    (``fits_broadcast``), else every term is looked up in a join.
    """
    strong = pin(revealing(docs, rules).select("term").distinct())
    if not fits_broadcast(strong):
        return _joined(docs, strong)
    terms = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in strong.collect()))

    @F.arrow_udf(f"struct<spans:array<{_SPAN}>,terms:array<{_SPAN}>>")
    def mark(texts: pa.Array) -> pa.Array:
        found = [_marked(x.as_py() or "", terms.value) for x in texts]
        return pa.StructArray.from_arrays([_rows([s for s, _ in found]), _rows([t for _, t in found])], ["spans", "terms"])
    return docs.select("doc_id", "text", mark("text").alias("m")).select("doc_id", "text", "m.spans", "m.terms")


def _joined(docs: DataFrame, strong: DataFrame) -> DataFrame:
    """``find`` for any number of terms."""
    rows = stage(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "pii-rows")

    @F.arrow_udf(f"array<{_SPAN}>")
    def base(texts: pa.Array) -> pa.Array:
        return _rows([base_spans(x.as_py() or "") for x in texts])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py() or ""
                at = list(terms_of(text, base_spans(text)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(at), pa.int64()), pa.array([text[a:b].lower() for a, b in at], pa.string()),
                     pa.array([a for a, _ in at], pa.int32()), pa.array([b for _, b in at], pa.int32())], ["row", "term", "start", "end"])

    stand = rows.select("row", "text").mapInArrow(each, "row bigint, term string, start int, end int").join(strong, "term", "left_semi")
    terms = stand.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(_TERM_KIND).alias("kind"), "end"))).alias("terms"))
    none = F.array().cast(f"array<{_SPAN}>")
    return rows.join(terms, "row", "left").select("doc_id", "text", base("text").alias("spans"), F.coalesce("terms", none).alias("terms"))


def sanitise(text: Column, spans: Column, terms: Column) -> Column:
    """The text with every pattern match generalised to its kind and every revealing term removed."""
    @F.arrow_udf("string")
    def clean(texts: pa.Array, spans: pa.Array, terms: pa.Array) -> pa.Array:
        out = []
        for x, s, t in zip(texts, spans, terms):
            text, parts, at = x.as_py() or "", [], 0
            cuts = [*(s.as_py() or []), *(t.as_py() or [])]
            for c in sorted(cuts, key=lambda c: (c["start"], c["kind"])):
                if c["end"] > at:
                    parts += [text[at:c["start"]], "" if KINDS[c["kind"]] == "term" or c["start"] < at else f"[{KINDS[c['kind']]}]"]
                    at = c["end"]
            out.append("".join(parts) + text[at:])
        return pa.array(out, pa.string())
    return clean(text, spans, terms)


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [_of_kind(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(listed(F.col("spans")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("spans", "terms"))).alias("spans"))
