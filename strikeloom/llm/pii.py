"""Personal data, and the terms that reveal it.

Mail and network addresses, card and phone numbers are found by patterns. Every
different value is a protected entity. How much a term reveals of an entity is
their pointwise mutual information, from the documents that have the term within a
few words of the entity, over the information of the entity itself: 1 where the
term is found beside it alone. Terms over one threshold are generalised, over
another removed, beside the entity that they reveal.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeloom.llm.base import Work, column, fresh_dir, join_keys, slices, text_of

#: Kinds of spans in order; the last two are the method's.
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
EMAIL, IP, CARD, PHONE, GENERALISED, REMOVED = range(6)
#: Words on either side of a mention that count as beside it.
BESIDE = 10
#: Bits of the filter that picks the words whose documents are counted.
FILTER_BITS = 1 << 27

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# fixed values: what the patterns below match is given; none of them looks at a character more than a few times
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W_]++")
NO_DIGITS = {ord(c): None for c in " ().-+"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = (ord(c) - 48) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mentions(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base spans by start and kind: leftmost, not overlapping within a kind."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        # what stands before an @ holds no other one, so it is looked at once
        start = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, EMAIL, domain.end(), text[start : domain.end()].lower()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    for m in ADDRESS.finditer(text):
        numbers = [x.lstrip("0") for x in m[0].split(".")]
        if all(len(x) < 4 and int(x or 0) <= 255 for x in numbers):
            found.append((m.start(), IP, m.end(), ".".join(x or "0" for x in numbers)))
    for kind, pattern, least, most in ((CARD, DIGITS, 12, 19), (PHONE, DIALLED, 9, 15)):
        for m in pattern.finditer(text):
            digits = m[0].translate(NO_DIGITS)
            if least <= len(digits) <= most and (kind != CARD or luhn(digits)):
                found.append((m.start(), kind, m.end(), digits))
    return sorted(found)


def term_of(word: str) -> str:
    """A word as a term: lower case, its digest if very long."""
    word = word.lower()
    return word if len(word) <= 64 else "#" + hashlib.sha256(word.encode()).hexdigest()


def beside(text: str, found: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, int]]:
    """(number of the mention, start, end) of the words within BESIDE words of each mention, without words in mentions."""
    before, after, opened, hidden = deque(maxlen=BESIDE), [], 0, 0
    covered = 0  # end of the mentions that began so far
    for m in WORD.finditer(text):
        start, end = m.span()
        while hidden < len(found) and found[hidden][0] < end:
            covered = max(covered, found[hidden][2])
            hidden += 1
        if start < covered:
            continue
        while opened < len(found) and found[opened][0] <= start:
            yield from ((opened, *w) for w in before)
            after.append([opened, found[opened][2], BESIDE])
            opened += 1
        for one in after:
            if start >= one[1]:
                yield one[0], start, end
                one[2] -= 1
        if after:
            after = [one for one in after if one[2]]
        before.append((start, end))
    for k in range(opened, len(found)):
        yield from ((k, *w) for w in before)


def found_in(docs: DataFrame, text_col: str, with_text: bool) -> DataFrame:
    """Two sorts of rows: one a document, with its columns (the text only if ``with_text``), ``spans`` and a ``key``; and one for each entity and each word beside one, with the document's key.

    ``spans`` are (start, kind, end). ``first`` marks the first of equal (entity, term)
    pairs of a document; the entity itself has no term; ``digest`` is the text's.
    Entities are digests of kind and value.
    """
    kept = [k for k, c in enumerate(docs.columns) if with_text or c != text_col]
    fields = [T.StructField(docs.columns[k], docs.schema[k].dataType) for k in kept]
    own = T.StructType([T.StructField("key", T.LongType()), *fields, T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "kind", "end")])))])
    more = T._parse_datatype_string("digest string, entity string, term string, first boolean, start int, end int")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end")]))
        words = pa.schema([("digest", pa.string()), ("entity", pa.string()), ("term", pa.string()), ("first", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())])
        names = [f.name for f in own.fields] + words.names
        row = TaskContext.get().partitionId() << 33

        def beside_rows(rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            empty = [pa.nulls(len(rows), batch.column(k).type) for k in kept] + [pa.nulls(len(rows), span)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *empty, *[pa.array(c, f.type) for c, f in zip(columns[1:], words, strict=True)]], names)

        for batch in batches:
            for some in slices(batch, 1000):
                spans, rows, first_row = [], [], row
                for text in some.column(place):
                    text = text.as_py() or ""
                    found = mentions(text)
                    spans.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in found])
                    if found:
                        digest = hashlib.sha256(text.encode()).hexdigest()[:32]
                        entity = [hashlib.sha256(f"{KINDS[k]}:{v}".encode()).hexdigest()[:32] for _, k, _, v in found]
                        rows += [(row, digest, e, None, True, None, None) for e in sorted(set(entity))]
                        seen = set()
                        for k, start, end in beside(text, found):
                            pair = (entity[k], term_of(text[start:end]))
                            rows.append((row, digest, *pair, pair not in seen, start, end))
                            seen.add(pair)
                            if len(rows) >= 20_000:
                                yield beside_rows(rows, some)
                                rows = []
                    row += 1
                keys = pa.array(range(first_row, row), pa.int64())
                yield pa.RecordBatch.from_arrays([keys, *[some.column(k) for k in kept], pa.array(spans, span), *[pa.nulls(len(spans), f.type) for f in words]], names)
                if rows:
                    yield beside_rows(rows, some)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, T.StructType(own.fields + more.fields))


def documents_with(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """term, n_term: how many documents have each of ``terms``, and some other words (those that the filter lets pass).

    The filter has one bit for each hash of a term and FILTER_BITS bits at any size of ``terms``.
    """
    place = F.crc32(F.col("term").cast("binary")) % FILTER_BITS + 1
    rows = terms.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        piece = np.frombuffer(r["bits"], np.uint8)
        bits[(r["bucket"] - 1) * len(piece) : r["bucket"] * len(piece)] = piece
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def stretches(text: str, size: int = 1 << 20) -> Iterator[str]:
        at = 0
        while at < len(text):
            end = text.find(" ", at + size)
            yield text[at : end if end >= 0 else len(text)]
            at = end if end >= 0 else len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for some in slices(batch, 1000):
                out = []
                for text in some.column(0):
                    seen = set()
                    for piece in stretches(text.as_py()):
                        for term in {term_of(w) for w in set(WORD.findall(piece))}:
                            at = zlib.crc32(term.encode()) % FILTER_BITS
                            if table[at >> 3] >> (at & 7) & 1:
                                seen.add(term)
                    out += seen
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["term"])
        pa.default_memory_pool().release_unused()

    return docs.select(text_of(text_col).alias("text")).mapInArrow(run, "term string").groupBy("term").agg(F.count("*").alias("n_term"))


def disclosure(n: int, both: Column, entity: Column, term: Column) -> Column:
    """Pointwise mutual information of entity and term over the information of the entity; null where that is 0."""
    counts = [c.cast("double") for c in (both, entity, term)]
    return F.try_divide(F.log2(F.lit(float(n)) * counts[0] / (counts[1] * counts[2])), F.log2(F.lit(float(n)) / counts[1]))


def revealing(work: Work, docs: DataFrame, text_col: str, words: DataFrame, n: int, least: int, generalise: float, remove: float) -> DataFrame:
    """entity, term, kind, seen: the pairs whose disclosure is over a threshold; ``seen`` counts places of the term beside the entity.

    A pair must be found in ``least`` different texts. ``words`` are the second sort of rows of ``found_in``.
    """
    entities = words.filter("term is null").groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = words.filter("term is not null").groupBy("entity", "term", "digest").agg(F.sum(F.col("first").cast("long")).alias("n_both"), F.count("*").alias("seen"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n_both").alias("n_both"), F.sum("seen").alias("seen"), F.count("*").alias("texts")).filter(F.col("texts") >= least).drop("texts")
    pairs = work.written(pairs, "pairs")
    total = pairs.count()
    terms = work.written(pairs.groupBy("term").agg(F.count("*").alias("pairs")), "terms")
    counted = documents_with(docs, terms, text_col) if total else docs.sparkSession.createDataFrame([], "term string, n_term long")
    terms = work.written(counted.join(terms, "term"), "terms")
    entities = work.written(entities.join(pairs.groupBy("entity").agg(F.count("*").alias("pairs")), "entity"), "entities")
    rated = join_keys(pairs, terms, "term", "pairs", total)
    rated = join_keys(work.written(rated, "rated"), entities, "entity", "pairs", total)
    rated = rated.withColumn("disclosure", disclosure(n, F.col("n_both"), F.col("n_entity"), F.col("n_term")))
    kind = F.when(F.col("disclosure") >= remove, F.lit(REMOVED)).when(F.col("disclosure") >= generalise, F.lit(GENERALISED))
    return work.written(rated.select("entity", "term", kind.cast("int").alias("kind"), "seen").filter("kind is not null"), "revealing")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with a mark in place of each base span, the class of each generalised term, and without removed terms; of overlapping spans the first counts."""

    @F.pandas_udf("string")
    def put(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(text: str, spans: list) -> str:
            out, at = [], 0
            for s in spans if spans is not None else []:
                if s["start"] < at:
                    continue
                word = text[s["start"] : s["end"]]
                shape = "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"
                out += [text[at : s["start"]], {GENERALISED: shape, REMOVED: ""}.get(s["kind"], f"[{KINDS[s['kind']].upper()}]")]
                at = s["end"]
            return "".join([*out, text[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, found, strict=True)])

    return put(text, spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, generalise: float = 0.6, remove: float = 0.9, with_text: bool = False) -> DataFrame:
    """One row a document: its id, counts of the base kinds, ``base_sha256``, ``spans``; with ``with_text`` also ``text`` and ``sanitised``.

    Spans are ``kind:start:end`` in code points, by start and then by KINDS, joined by
    commas. A pair of entity and term counts once a document and needs ``least``
    different texts, so copies of a text reveal nothing by themselves. Null texts are
    empty and have no spans; repeated rows are documents each; ids may be null or
    repeated; other columns may have any name and are left out; an empty table gives
    an empty table. Very common pairs, terms and entities are counted before they are
    shuffled and met by broadcasts (``join_keys``).
    """
    spark = docs.sparkSession
    own = docs.select(column(id_col).alias("id"), text_of(text_col).alias("text"))
    with Work(spark, "personal-data") as work:
        found = work.written(found_in(own, "text", with_text), "found")
        rows = found.filter("spans is not null").drop("digest", "entity", "term", "first", "start", "end")
        words = found.filter("entity is not null").select("key", "digest", "entity", "term", "first", "start", "end")
        counts = found.agg(F.count("spans").alias("n"), F.count("term").alias("words")).first()
        pairs = revealing(work, own, "text", words, counts["n"], least, generalise, remove)
        hits = join_keys(words.filter("term is not null").select("key", "entity", "term", "start", "end"), pairs, ["entity", "term"], "seen", counts["words"])
        hits = hits.groupBy("key", "start", "end").agg(F.max("kind").alias("kind"))
        hits = hits.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
        kind_of = F.array(*[F.lit(k) for k in KINDS])
        string = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind_of, s["kind"]), s["start"], s["end"])), ",")
        every = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "more")))
        out = rows.join(hits, "key", "left").withColumn("every", every)
        number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
        texts = ["text", sanitised(F.col("text"), F.col("every")).alias("sanitised")] if with_text else []
        out = out.select(
            F.col("id").alias(id_col), number(EMAIL).alias("n_email"), number(IP).alias("n_ip"), number(CARD).alias("n_card"), number(PHONE).alias("n_phone"),
            F.sha2(string(F.col("spans")), 256).alias("base_sha256"), string(F.col("every")).alias("spans"), *texts,
        )
        path = fresh_dir(spark, "personal-data")
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)
