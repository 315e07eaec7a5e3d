"""Mention tagging on article text with a gazetteer (dictionary of phrases).

The reference runs a per-row NER model; here every text is read once by an
automaton over all phrases (failure links, so that overlapping phrases cost one
pass), money amounts are found in the same pass, and overlapping matches are
resolved by "longest wins, then earliest".  The texts stay in the tasks that
scan them: nothing but mentions comes out, and nothing shuffles.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label -> entity type map and base confidence of the reference.
LABEL_TYPES = [("ORG", "company"), ("PERSON", "person"), ("GPE", "location"), ("LOC", "location"),
               ("EVENT", "event"), ("MONEY", "financial_instrument"), ("PRODUCT", "product")]
BASE_CONFIDENCE = 0.75

MONEY_RE = r"[$€£][0-9][0-9,]*(\.[0-9]+)?( ?(billion|million|thousand|bn|mn|m|k))?"
# Bytes of phrases that travel to every task at a time; a larger gazetteer is matched in several passes.
PHRASE_BYTES = 32 << 20
SCAN_ROWS = 256  # texts whose mentions a task holds as Python objects

_MONEY = re.compile(MONEY_RE)
_BLANKS = re.compile(r"[ \t]+")
_LONG_BLANKS = re.compile(r"[ \t]{2,}|\t")


def label_map(spark) -> DataFrame:
    return spark.createDataFrame(LABEL_TYPES, "label string, type string")


@lru_cache(1 << 16)
def is_word(char: str) -> bool:
    """Letters, digits and combining marks; any other character may stand beside a mention."""
    return char.isalnum() or unicodedata.category(char)[0] == "M"


def normalised(text: str) -> str:
    """Lower case character by character, runs of blanks and tabs as one blank."""
    return _BLANKS.sub(" ", "".join(c.lower() for c in text))


def _with_offsets(text: str) -> tuple[str, list[int] | None]:
    """Normalised text and, unless they are the same, the place in ``text`` of each of its characters."""
    low = text.lower()
    if len(low) == len(text) and "Σ" not in text:
        if "\t" not in text and "  " not in text:
            return low, None
        # character by character as in the text: only the blanks are fewer
        parts, at, upto = [], [], 0
        for m in _LONG_BLANKS.finditer(low):
            parts.append(low[upto:m.start()])
            at.extend(range(upto, m.start() + 1))
            upto = m.end()
        at.extend(range(upto, len(text) + 1))
        return " ".join([*parts, low[upto:]]), at
    chars, at, i = [], [], 0
    while i < len(text):
        c, start = text[i], i
        i += 1
        if c in " \t":
            while i < len(text) and text[i] in " \t":
                i += 1
            c = " "
        for x in c.lower():
            chars.append(x)
            at.append(start)
    at.append(len(text))
    return "".join(chars), at


class Phrases:
    """Automaton over normalised phrases; its build follows the first use in a task's process."""

    def __init__(self, entries: Iterable[tuple]):
        self.entries = [(p, e) for e in entries if (p := normalised(e[0]).strip(" "))]

    def __getstate__(self) -> dict:
        return {"entries": self.entries}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if "_automaton" not in self.__dict__:
            by_phrase: dict[str, list] = {}
            for phrase, entry in self.entries:
                by_phrase.setdefault(phrase, []).append(entry)
            self._automaton = ahocorasick.Automaton()
            for phrase, found in by_phrase.items():
                self._automaton.add_word(phrase, (phrase, found))
            self._automaton.make_automaton()
        return self._automaton

    def find(self, text: str) -> Iterator[tuple[int, int, str, list]]:
        """(start, end, phrase, entries) of every phrase in ``text``, in code points.

        A phrase that begins or ends with a letter or digit does so at a word's edge.
        """
        if not self.entries:
            return
        low, at = _with_offsets(text)
        for last, (phrase, entries) in self.automaton.iter(low):
            start, end = last + 1 - len(phrase), last + 1
            if start and is_word(low[start]) and is_word(low[start - 1]):
                continue
            if end < len(low) and is_word(low[last]) and is_word(low[end]):
                continue
            if at is not None:
                # the end of a run of blanks or of a character that became several
                start, end = at[start], at[end] if at[end] > at[last] else at[last] + 1
            yield start, end, phrase, entries


def settle(starts: Iterable[int], ends: Iterable[int]) -> list[bool]:
    """In the order given: whether a span overlaps no span kept before it (the same span again stays)."""
    kept_s, kept_e, keep = [], [], []
    for s, e in zip(starts, ends, strict=True):
        i = bisect_left(kept_s, s)
        same = i < len(kept_s) and kept_s[i] == s and kept_e[i] == e
        free = (i == 0 or kept_e[i - 1] <= s) and (i == len(kept_s) or kept_s[i] >= e)
        if free and not same:
            kept_s.insert(i, s)
            kept_e.insert(i, e)
        keep.append(free or same)
    return keep


_settle_udf = F.pandas_udf(lambda s, e: pd.Series([settle(a, b) for a, b in zip(s, e, strict=True)], dtype=object),
                           T.ArrayType(T.BooleanType()))


def resolve_overlaps(cands: DataFrame, id_col: str) -> DataFrame:
    """Longest span first, then the earliest: a span stays unless it overlaps one that stays.

    A span beaten only by beaten spans stays, so the order matters along a chain
    of overlaps; it is walked once per text over offsets alone.  Several
    candidates of one and the same span stay together.
    """
    rest = [c for c in cands.columns if c not in (id_col, "start", "end")]
    spans = F.collect_list(F.struct((F.col("start") - F.col("end")).alias("_order"), "start", "end", *rest))
    c = cands.groupBy(id_col).agg(F.array_sort(spans).alias("_c"))
    c = c.withColumn("_keep", _settle_udf(F.col("_c.start"), F.col("_c.end")))
    kept = F.filter(F.arrays_zip("_c", "_keep"), lambda x: x["_keep"])
    return c.select(id_col, F.explode(kept).alias("_m")).select(
        id_col, *[F.col(f"_m._c.{x}").alias(x) for x in cands.columns if x != id_col])


def _scan(phrases: Phrases, money: bool, resolve: bool, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mentions of every text of (id, text) batches, ``SCAN_ROWS`` texts at a time."""
    for b in (whole.slice(s, SCAN_ROWS) for whole in batches for s in range(0, whole.num_rows, SCAN_ROWS)):
        rows: list[tuple] = []
        for i, text in enumerate(b.column(1).to_pylist()):
            if not text:
                continue
            found = [(s, e, phrase, label, kind) for s, e, phrase, entries in phrases.find(text) for _, label, kind in entries]
            if money:
                found += [(m.start(), m.end(), m.group().lower(), "MONEY", "financial_instrument") for m in _MONEY.finditer(text)]
            if resolve and len(found) > 1:
                found.sort(key=lambda r: (r[0] - r[1], r[0]))
                keep = settle([r[0] for r in found], [r[1] for r in found])
                found = [r for r, k in zip(found, keep, strict=True) if k]
            rows += [(i, s, e, text[s:e], phrase, label, kind) for s, e, phrase, label, kind in found]
        at, *columns = zip(*rows, strict=True) if rows else [()] * 7
        ids = b.column(0).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, f.type) for x, f in zip(columns, list(schema)[1:], strict=True)]], schema=pa.schema([
            pa.field(schema[0].name, ids.type), *list(schema)[1:]]))


def phrase_blocks(spark, rows: DataFrame, max_bytes: int) -> Iterator:
    """Broadcasts of ``Phrases``, each over at most about ``max_bytes`` of the rows (phrase first)."""
    size = rows.agg(F.sum(F.octet_length("phrase") + 64)).first()[0] or 0
    blocks = max(1, -(-size // max_bytes))
    for b in range(blocks):
        some = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)
        yield spark.sparkContext.broadcast(Phrases(tuple(r) for r in some.collect()))


def tag_mentions(articles: DataFrame, gazetteer: DataFrame, id_col: str = "article_id",
                 text_col: str = "content", money: bool = False, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """Mentions: (id, start, end, name, phrase, label, type, confidence).

    ``gazetteer``: (phrase, label).  Phrases may hold digits and marks (``AT&T``,
    ``3M``, ``Coca-Cola Co.``); case does not count, nor how many blanks or tabs
    stand between words.  A mention begins and ends at a word's edge: a letter,
    digit or combining mark is not cut off from one beside it.  Offsets are code
    points.  Labels outside the type map are dropped (the reference keeps only
    mapped labels).  ``money``: currency amounts are mentions as well and compete
    with the phrases that they overlap.  Null and empty texts have no mentions.

    Phrases of at most ``phrase_bytes`` go to every task as one automaton; a
    larger gazetteer is matched block by block, each with a pass over the texts,
    and overlaps are resolved on the spans of all blocks.
    """
    spark = articles.sparkSession
    known = gazetteer.select("phrase", "label").where("phrase is not null").distinct() \
        .join(F.broadcast(label_map(spark)), "label").select("phrase", "label", "type")
    texts = articles.select(id_col, text_col)
    out = T.StructType([texts.schema[0], *(T.StructField(n, t) for n, t in (
        ("start", T.IntegerType()), ("end", T.IntegerType()), ("name", T.StringType()), ("phrase", T.StringType()),
        ("label", T.StringType()), ("type", T.StringType())))])
    fields = pa.schema([pa.field(id_col, pa.null()), ("start", pa.int32()), ("end", pa.int32()), *[(n, pa.string()) for n in ("name", "phrase", "label", "type")]])
    blocks = list(phrase_blocks(spark, known, phrase_bytes))

    def one_pass(shared, with_money: bool) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _scan(shared.value, with_money, len(blocks) == 1, fields, batches)

        return texts.mapInArrow(scan, out)

    found = reduce(DataFrame.unionByName, [one_pass(shared, money and i == 0) for i, shared in enumerate(blocks)])
    if len(blocks) > 1:
        found = resolve_overlaps(found, id_col)
    return found.withColumn("confidence", F.lit(BASE_CONFIDENCE))


def mentions_to_entities(mentions: DataFrame, id_col: str = "article_id") -> DataFrame:
    """One entity per (article, phrase, type): surface of the first mention,
    mention count, first offset, best confidence; pos = rank of first offset."""
    g = mentions.groupBy(id_col, "phrase", "type").agg(
        F.min_by("name", "start").alias("name"), F.count("*").alias("mentions"),
        F.min("start").alias("first_start"), F.max("confidence").alias("confidence"))
    w = Window.partitionBy(id_col).orderBy("first_start", "phrase", "type")
    return g.withColumn("pos", F.row_number().over(w) - 1)
