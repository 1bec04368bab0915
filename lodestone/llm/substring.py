"""Substring dedup by hashing paragraphs: what repeats stays where it comes first and goes everywhere else.

A unit ends with a line, after ".", "!" or "?" with white space, and before a capital after white space, so a
passage that was set into other text still begins and ends with units of its own. A paragraph begins at every
unit that has a word and takes in the units that follow until it has MIN_WORDS words. Its digest covers its
lower-case words alone. Digests are grouped over all documents; what is not the first occurrence is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import U64, in_arrow, mix, powers, text_steps, words

#: Stands for "no keeper" beside doc_ids.
NO_KEEPER = np.iinfo(np.int64).min
#: Words of a paragraph, the least that is ever compared. Every word of it counts, however short its units are, and
#: it must stand in one earlier document as it stands here. 1 removes every repeated unit, chance ones included.
MIN_WORDS = 20

_BASE, _BASE2 = 0xD6E8FEB86659FD93, 0xA24BAED4963EE407
_BLANK = np.zeros(256, bool)
_BLANK[[9, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def _unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(data)
    blank = _BLANK[data]
    upper = (data >= 65) & (data <= 90)
    upper[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    begins = np.zeros(n, bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    begins[1:] |= data[:-1] == 10
    begins[1:] |= upper[1:] & ((data[:-1] == 32) | (data[:-1] == 9))
    after = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    full = np.flatnonzero(~blank)
    before = np.searchsorted(full, after) - 1  # the last byte before the white space
    ok = before >= 0
    begins[after[ok][_STOP[data[full[before[ok]]]]]] = True
    return np.flatnonzero(begins)


@dataclass
class Paragraphs:
    """Units of a run of rows (row, first byte, words) and the paragraph that begins at each: the unit after its last,
    its first word and number of words, its digests; whether there is one at all."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    stop: np.ndarray
    at: np.ndarray
    size: np.ndarray
    digest: np.ndarray
    second: np.ndarray
    some: np.ndarray


def _ranges(h: np.ndarray, base: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial digest of each range of words, the same wherever it stands."""
    up, down = powers(base, len(h) + 1), powers(pow(base, -1, 1 << 64), len(h) + 1)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin]) ^ mix((end - begin).astype(U64))


def paragraphs(data: np.ndarray, offsets: np.ndarray, min_words: int) -> Paragraphs:
    none = np.zeros(0, np.int64)
    if not len(data):
        return Paragraphs(none, none, none, none, none, none, none.astype(U64), none.astype(np.int32), none.astype(bool))
    start = _unit_starts(data, offsets)
    row = np.searchsorted(offsets, start, side="right") - 1
    h, _, at, _ = words(data, offsets)
    bound = np.append(np.searchsorted(at, start), len(at))
    count = np.diff(bound)
    last = np.searchsorted(at, offsets[1:])[row]  # the word after the document's last
    need = bound[:-1] + max(min_words, 1)
    some = (count > 0) & (need <= last)
    stop = np.searchsorted(bound, need)
    stop = np.where(some, stop, np.arange(len(start)))
    end = bound[stop]
    first = bound[:-1]
    digest = _ranges(h, _BASE, first, np.where(some, end, first))
    second = _ranges(mix(h ^ U64(0x9E3779B97F4A7C15)), _BASE2, first, np.where(some, end, first))
    return Paragraphs(row, start, count, stop, first, end - first, digest, (second >> U64(32)).astype(np.uint32).view(np.int32), some)


def _own(p: Paragraphs) -> tuple[np.ndarray, np.ndarray]:
    """Whether a paragraph is its row's first with its digest, and whether it repeats an earlier one of its row that ends before it begins."""
    live = np.flatnonzero(p.some)
    order = live[np.lexsort((live, p.digest[live], p.row[live]))]
    first, again = np.zeros(len(p.row), bool), np.zeros(len(p.row), bool)
    if len(order):
        new = np.append(True, (p.digest[order][1:] != p.digest[order][:-1]) | (p.row[order][1:] != p.row[order][:-1]))
        leader = order[new][np.cumsum(new) - 1]
        first[order[new]] = True
        again[order] = p.at[order] >= p.at[leader] + p.size[leader]
    return first, again


def _emitter(min_words: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_steps(batch.column(1)):
                p = paragraphs(data, offsets, min_words)
                mine = np.flatnonzero(_own(p)[0])
                yield pa.RecordBatch.from_arrays([pa.array(p.digest[mine].view(np.int64)), pa.array(p.second[mine]), batch.column(0).take(pa.array(first + p.row[mine]))], ["digest", "second", "doc_id"])

    return emit


def _cut(data: np.ndarray, offsets: np.ndarray, lists: list, min_words: int) -> tuple[list[bytes], list[str], list[list[int]], list[int]]:
    p = paragraphs(data, offsets, min_words)
    _, own = _own(p)
    edge = np.searchsorted(p.row, np.arange(len(offsets)))
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    texts, spans, kept, gone = [], [], [], []
    for i in range(len(offsets) - 1):
        a, b = edge[i], edge[i + 1]
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        text, again, ids = data[lo:hi], own[a:b], []
        if lists[i] is not None:
            known, second, owners = lists[i]
            order = np.argsort(known, kind="stable")
            known, second, owners = known[order], second[order], owners[order]
            at = np.minimum(np.searchsorted(known, p.digest[a:b]), len(known) - 1)
            hit = (known[at] == p.digest[a:b]) & (second[at] == p.second[a:b]) & p.some[a:b]
            ids = np.unique(owners[at[hit]]).tolist()
            again = again | hit
        if not again.any():
            texts.append(text.tobytes())
            spans.append("")
            kept.append([])
            gone.append(0)
            continue
        cover = np.zeros(b - a + 1, np.int64)
        np.add.at(cover, np.flatnonzero(again), 1)
        np.add.at(cover, p.stop[a:b][again] - a, -1)
        goes = np.cumsum(cover)[:-1] > 0
        change = np.flatnonzero(np.diff(np.concatenate([[0], goes.astype(np.int8), [0]])))
        byte = np.append(p.start[a:b], hi)
        stays = np.ones(len(text), bool)
        mine = []
        for x, y in zip(change[::2].tolist(), change[1::2].tolist()):
            stays[byte[x] - lo : byte[y] - lo] = False
            mine.append(f"{chars[byte[x]] - chars[lo]}:{chars[byte[y]] - chars[lo]}")
        texts.append(text[stays].tobytes())
        spans.append(",".join(mine))
        kept.append(ids)
        gone.append(int(p.count[a:b][goes].sum()))
    return texts, spans, kept, gone


def _cleaner(min_words: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2)
            size = found.offsets.to_numpy()
            field = lambda name, kind: found.values.field(name).to_numpy() if len(found.values) else np.zeros(0, kind)  # noqa: B023, E731
            known, second, keep = field("digest", np.int64).view(U64), field("second", np.int32), field("keep", np.int64)
            null, no_text = found.is_null().to_numpy(zero_copy_only=False), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            no_id = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for first, data, offsets in text_steps(batch.column(1)):
                n = len(offsets) - 1
                lists = [None if null[k] or size[k] == size[k + 1] else tuple(x[size[k] : size[k + 1]] for x in (known, second, keep)) for k in range(first, first + n)]
                texts, spans, kept, gone = _cut(data, offsets, lists, min_words)
                for i in np.flatnonzero(no_id[first : first + n]):
                    texts[i], spans[i], kept[i], gone[i] = data[offsets[i] : offsets[i + 1]].tobytes(), "", [], 0
                out = pa.array([None if no_text[first + i] else t for i, t in enumerate(texts)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), out, pa.array(spans, pa.string()), pa.array(kept, pa.list_(pa.int64())), pa.array(gone, pa.int64())],
                    ["doc_id", "text", "removed_spans", "kept_doc_ids", "removed_words"],
                )

    return clean


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, removed_spans, kept_doc_ids, removed_words) for each row of docs, text without what it repeats.

    docs has doc_id and text; other columns are ignored. A paragraph (min_words words and the rest of their last
    unit) is repeated if a smaller doc_id has it anywhere, or its own text has it further up, not overlapping it.
    The units of every repeated paragraph go. Units without a word, such as blank lines and rules, are no part of
    what is compared: inside a repeated passage they go with it. removed_spans lists the "start:end" ranges of
    characters of the original text that went, comma separated; kept_doc_ids are the smallest doc_ids, ascending,
    that have the paragraphs that went (the document itself is not named).

    A null text stays null; a null doc_id has no rank, so that row stays as it is and counts for nobody. Rows
    that share a doc_id are one document: they don't repeat each other. Empty texts, and those of fewer than
    min_words words, stay as they are. Texts are read whole, however long. An empty table gives no rows. Two
    digests of 64 and 32 bits decide, independent of each other; words are not compared again.

    Digests are computed and shuffled once, without text; the earliest owner comes from a sorted window in the same
    exchange, which spills and never collects, so a digest that is everywhere streams through its task. What
    repeats is then joined to the texts.
    """
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    digests = some.transform(in_arrow, _emitter(min_words), "digest long, second int, doc_id long")
    owner = F.first("doc_id").over(Window.partitionBy("digest", "second").orderBy("doc_id"))
    repeated = digests.withColumn("keep", owner).where("doc_id > keep").distinct()
    of_doc = repeated.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "second", "keep")).alias("found"))
    joined = docs.select("doc_id", "text").join(of_doc, "doc_id", "left").select("doc_id", "text", "found")
    return joined.transform(in_arrow, _cleaner(min_words), "doc_id long, text string, removed_spans string, kept_doc_ids array<long>, removed_words long")


def oracle(min_words: int = MIN_WORDS) -> str:
    return rf"""
WITH s AS (
  SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '([.!?][ \t\r]+|\n)', '\1' || chr(30), 'g'),
    '([ \t])([A-ZÀ-ÖØ-Þ])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS units,
    string_split(trim(regexp_replace(lower(text), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')), ' ') AS word FROM documents),
u AS (SELECT doc_id, unnest(units) AS unit, generate_subscripts(units, 1) AS idx FROM s WHERE doc_id IS NOT NULL AND text IS NOT NULL),
n AS (
  SELECT doc_id, idx, unit, CASE WHEN trim(regexp_replace(lower(unit), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(lower(unit), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')), ' ')) END AS words FROM u),
c AS (
  SELECT *, sum(words) OVER w AS upto, sum(words) OVER w - words AS past,
    sum(length(unit)) OVER w - length(unit) AS pos0 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
p AS (
  SELECT a.doc_id, a.idx, b.idx AS last, a.past, array_to_string(list_slice(s.word, a.past::BIGINT + 1, b.upto::BIGINT), ' ') AS said, b.upto - a.past AS size
  FROM c a ASOF JOIN (SELECT * FROM c WHERE words > 0) b ON a.doc_id = b.doc_id AND a.past + {min_words} <= b.upto
  JOIN (SELECT * FROM s WHERE doc_id IS NOT NULL AND text IS NOT NULL) s ON s.doc_id = a.doc_id WHERE a.words > 0),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY said) AS keep, min(past) OVER (PARTITION BY doc_id, said) AS own FROM p),
r AS (SELECT * FROM f WHERE doc_id > keep OR past >= own + size),
gone AS (SELECT DISTINCT c.doc_id, c.idx FROM c JOIN r ON c.doc_id = r.doc_id AND c.idx BETWEEN r.idx AND r.last),
h AS (
  SELECT c.*, gone.idx IS NOT NULL AS goes FROM c LEFT JOIN gone USING (doc_id, idx)),
i AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM h),
g AS (SELECT doc_id, island, min(pos0)::BIGINT AS a, max(pos0 + length(unit))::BIGINT AS b, sum(words) AS words FROM i WHERE goes GROUP BY doc_id, island),
kept AS (SELECT doc_id, string_agg(unit, '' ORDER BY idx) FILTER (WHERE NOT goes) AS text FROM h GROUP BY doc_id),
d AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_spans, sum(words)::BIGINT AS removed_words FROM g GROUP BY doc_id),
k AS (SELECT doc_id, list_sort(list(DISTINCT keep)) AS kept_doc_ids FROM r WHERE keep < doc_id GROUP BY doc_id)
SELECT s.doc_id, CASE WHEN d.doc_id IS NULL THEN s.text ELSE coalesce(kept.text, '') END AS text, coalesce(removed_spans, '') AS removed_spans,
  coalesce(kept_doc_ids, []::BIGINT[]) AS kept_doc_ids, coalesce(removed_words, 0)::BIGINT AS removed_words
FROM s LEFT JOIN d ON s.doc_id = d.doc_id LEFT JOIN k ON s.doc_id = k.doc_id LEFT JOIN kept ON s.doc_id = kept.doc_id"""


ORACLE = oracle()
