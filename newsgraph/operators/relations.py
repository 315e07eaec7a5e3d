"""Subject -> Action -> Object extraction from text with a verb lexicon.

Offline stand-in for the model's causal mapping: inside one sentence, a
lexicon verb links the nearest mention before it (subject) to the nearest
mention after it (object).  Texts and mentions are brought together by document
once; one pass over each document finds its verbs and sentences and looks both
mentions up by character offset: no pair enumeration.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.operators.tagging import PHRASE_BYTES, Phrases, is_word, phrase_blocks

LEXICON_CONFIDENCE = 0.75

# The rules of sentence boundaries.  A full stop after one of these never ends a sentence ...
TITLES = ("mr", "mrs", "ms", "dr", "prof", "st", "gen", "sen", "rep", "gov", "vs", "e.g", "i.e")
# ... after one of these only before a capital letter.
SUFFIXES = ("inc", "corp", "co", "ltd", "llc", "plc", "bros", "cie", "jr", "sr", "u.s", "u.k", "approx", "etc")

_MARKS = re.compile(r"[.!?]+")
_LAST_WORD = re.compile(r"[^\W_](?:[^\W_]|\.(?=[^\W_]))*$")


def ends_sentence(text: str, start: int, end: int, mention_end: bool) -> bool:
    """Whether the marks ``text[start:end]`` end a sentence.

    At the end of a mention (``Yahoo!``, ``Acme Inc.``) they do only if a capital
    letter or nothing follows.  Else ``!``, ``?`` and runs of marks always do, and
    so does a stop at the end of the text.  A single full stop between two
    letters or digits (``4.2``, ``U.S``) does not, nor one after a title or an
    initial; one after a suffix does only if a capital letter follows.
    """
    after = text[end:end + 80].lstrip()
    capital = not after or after[0].isupper()
    if mention_end:
        return capital
    if text[start:end] != "." or end == len(text):
        return True
    if start and is_word(text[start - 1]) and is_word(text[end]):
        return False
    last = _LAST_WORD.search(text[max(0, start - 40):start])
    word = last.group() if last else ""
    if word.lower() in TITLES or len(word) == 1 and word.isupper():
        return False
    return capital or word.lower() not in SUFFIXES


def sentence_spans(text: str, mentions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; a mark inside a mention ends none.

    ``mentions``: spans that do not overlap, in order of their starts.
    """
    out, at, starts = [], 0, [s for s, _ in mentions]
    for m in _MARKS.finditer(text):
        i = bisect_right(starts, m.start()) - 1
        until = mentions[i][1] if i >= 0 else 0
        if m.end() < until or not ends_sentence(text, m.start(), m.end(), m.end() == until):
            continue
        out.append((at, m.end()))
        at = m.end()
    return out + [(at, len(text))] if at < len(text) else out


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by id (column 0) as tables of whole documents, with the places where a document begins and the end."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        # a document that goes on through many batches is put together once
        if held and held[-1].column(0)[-1] == b.column(0)[0] == b.column(0)[-1]:
            held.append(b)
            continue
        rows = pa.Table.from_batches([*held, b])
        at = _begins(rows)
        if len(at) > 2:
            yield rows.slice(0, at[-2]), at[:-1]
        held = rows.slice(at[-2]).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, _begins(rows)


def _begins(rows: pa.Table) -> np.ndarray:
    ids = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]))


def _link(verbs: Phrases, texts: list[str], spans: list[tuple[int, int]], starts: list[int], ends: list[int]) -> Iterator[tuple]:
    """(subject, object, action, sentiment, sentence) of each linked verb of a document, in order of the verbs.

    Mentions are given by ``starts`` and ``ends``, in order of the ends; subject and
    object are places there.  ``spans``: what sentences may not end inside of.
    """
    found = [(s, entries) for text in texts for s, _, _, entries in verbs.find(text)]
    if not found:
        return
    found.sort(key=itemgetter(0))
    order = sorted(range(len(starts)), key=starts.__getitem__)
    nexts = [starts[k] for k in order]
    sents: list[tuple[int, int, str]] = []
    firsts: list[int] = []
    for off, entries in found:
        # a mention can be a subject from its end on: one that starts at the verb does not hide it
        subj, after = bisect_right(ends, off) - 1, bisect_right(nexts, off)
        if subj < 0 or after == len(nexts):
            continue
        if not sents:
            sents = [(s, e, text) for text in texts for s, e in sentence_spans(text, spans)]
            sents.sort(key=itemgetter(0))
            firsts = [x[0] for x in sents]
        at, until, text = sents[bisect_right(firsts, off) - 1]
        if starts[subj] >= at and nexts[after] < until:
            for _, action, sentiment in entries:
                yield subj, order[after], action, sentiment, text[at:until].strip(" ")


def _relations(verbs: Phrases, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Relations of (id, text, start, end, name, type, confidence) rows sorted by id and end: texts first, then mentions."""
    for rows, at in _documents(batches):
        has = rows.column(1).is_valid().to_numpy()
        text, is_null = rows.column(1).drop_null().to_pylist(), rows.column(0).is_null().to_numpy()[at[:-1]].tolist()
        start, end = (rows.column(k).fill_null(-1).to_numpy().tolist() for k in (2, 3))
        n_texts = np.add.reduceat(has, at[:-1], dtype=np.int64)
        out: list[tuple] = []
        for lo, hi, n, done, no_id in zip(at[:-1].tolist(), at[1:].tolist(), n_texts.tolist(), np.cumsum(n_texts).tolist(), is_null, strict=True):
            first = lo + n
            if not n or first == hi:
                continue
            s, e = start[first:hi], end[first:hi]
            # mentions without an id are those of no text in particular
            spans = [] if no_id else sorted(set(zip(s, e, strict=True)))
            out += [(pos, first + subj, first + obj, *more) for pos, (subj, obj, *more) in enumerate(_link(verbs, text[done - n:done], spans, s, e))]
        pos, subj, obj, action, sentiment, sentence = zip(*out, strict=True) if out else [()] * 6
        ends = [rows.column(k).take(pa.array(x, pa.int64())) for x in (subj, obj) for k in (4, 5, 6)]
        yield from pa.table([rows.column(0).take(pa.array(subj, pa.int64())), pa.array(pos, pa.int32()), *ends, pa.array(action, pa.string()),
                             pa.array(sentiment, pa.float64()), pa.array(sentence, pa.string())], names).combine_chunks().to_batches()


def lexicon_relations(articles: DataFrame, mentions: DataFrame, lexicon: DataFrame,
                      id_col: str = "article_id", text_col: str = "content") -> DataFrame:
    """-> (id, pos, subject, action, object, sentiment, confidence, reasoning).

    ``mentions``: (id, start, end, name, type, confidence), of one text without
    overlaps; ``lexicon``: (verb, action, sentiment), at most ``PHRASE_BYTES`` of
    verbs.  Texts meet their own mentions, so that no sentence ends inside a name.
    A task holds one batch of rows and one document; rows of one id are one document.
    """
    verbs = list(phrase_blocks(articles.sparkSession, lexicon.select(F.col("verb").alias("phrase"), "action", F.col("sentiment").cast("double")), PHRASE_BYTES))
    if len(verbs) > 1:
        raise ValueError("the verb lexicon is larger than one broadcast")
    shared = verbs[0]
    null = lambda t: F.lit(None).cast(t)
    kinds = {"start": "int", "end": "int", "name": "string", "type": "string", "confidence": "double"}
    texts = articles.select(id_col, F.col(text_col).alias("_text")).where("_text <> ''").withColumns({f"_{c}": null(k) for c, k in kinds.items()})
    ments = mentions.select(id_col, null("string").alias("_text"), *[F.col(c).cast(k).alias(f"_{c}") for c, k in kinds.items()])
    # texts have no end and come first
    rows = texts.unionByName(ments).repartition(id_col).sortWithinPartitions(id_col, "_end", "_start", "_name", "_type")
    ends = [f"_{end}_{c}" for end in ("subject", "object") for c in ("name", "type", "confidence")]
    names = [id_col, "pos", *ends, "action", "sentiment", "reasoning"]
    out = T.StructType([rows.schema[id_col], T.StructField("pos", T.IntegerType()),
                        *(T.StructField(c, T.DoubleType() if c.endswith("confidence") else T.StringType()) for c in ends),
                        T.StructField("action", T.StringType()), T.StructField("sentiment", T.DoubleType()), T.StructField("reasoning", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _relations(shared.value, names, batches)

    endpoint = lambda c: F.struct(*[F.col(f"_{c}_{x}").alias(x) for x in ("name", "type", "confidence")])
    return rows.mapInArrow(scan, out).select(
        id_col, "pos", endpoint("subject").alias("subject"), F.upper("action").alias("action"), endpoint("object").alias("object"),
        "sentiment", F.lit(LEXICON_CONFIDENCE).alias("confidence"), "reasoning")
