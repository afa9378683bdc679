"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ten consecutive words of an item (all of them where it has fewer). Its set is its shingles of five words (one
shingle of all its words where it has fewer than five). A window is in a text only if all its shingles are, so the necessary
prefix of the window, its shingles ordered by rarity over all documents, is its rarest one alone. A first pass counts in how
many documents each shingle of the benchmark stands; windows with a shingle that stands in none are left out. The second
pass looks up prefixes only. A prefix's offset in its window gives the one place where the window can be, bounds of position
and length drop places beyond either end of the text, and the words there are compared with the window's.

The benchmark is the stated query set; it visits all rows in blocks of a bounded number of windows. Blocks are made one at a
time on the driver and broadcast; a worker holds one of them at a time, so neither grows with the benchmark. Documents are
never shuffled or sampled. Null and empty texts have no words and no hits; whole texts are read, however long. Repeated rows
are judged alike; items that repeat, or share windows, all count; those without an id count as hits and are in no list of
ids. Empty tables give empty results, and an empty benchmark no hits. Other columns pass through; columns of the result's
names are replaced.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymap.llm.arrow import BATCH, ROWS, held_in_turn, with_blocks, with_python
from quarrymap.session import bounded, checkpointed, table

WINDOW = 10
SHINGLE = 5
#: (window, item) pairs, or shingles, of a block.
BLOCK = 200_000
#: Documents with hits that are broadcast at most, at two longs each.
HITS = 1_000_000

#: Bytes that belong to words, with A-Z as a-z; all others as spaces. Every byte of a character beyond ASCII belongs to one.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, in UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


def _shingles(window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    k = min(SHINGLE, len(window))
    return [window[i : i + k] for i in range(len(window) - k + 1)]


def _windows(texts):
    found = []
    for text in texts:
        w = words(text)
        n = min(WINDOW, len(w))
        found.append(sorted({b" ".join(w[i : i + n]).decode() for i in range(len(w) - n + 1)}) if w else [])
    return [found]


def _runs(w: list[bytes], k: int) -> Iterator[tuple[bytes, ...]]:
    """All runs of k words, without copies of the list."""
    return zip(*(islice(w, j, None) for j in range(k)), strict=False)


def _count(texts, block):
    """(shingle, number of the texts that hold it) for one block's set of shingles."""
    counts: Counter = Counter()
    for text in texts:
        w = words(text)
        for k in block["lengths"]:
            counts.update(block["shingles"].intersection(_runs(w, k)))
    return [[b" ".join(s).decode() for s in counts], list(counts.values())]


def match(w: list[bytes], lengths: list[int], prefixes: dict, told: Counter | None = None) -> tuple[set[tuple[int, int]], set[str]]:
    """The spans of the windows that stand in the words ``w``, and their items.

    ``prefixes``: shingle -> [(its offset, the window, items)]. ``told`` counts places fetched by a prefix, those that the
    bounds leave, and hits.
    """
    spans, found = set(), set()
    for k in lengths:
        for i, s in enumerate(_runs(w, k)):
            if s not in prefixes:
                continue
            for offset, window, items in prefixes[s]:
                start = i - offset
                inside = start >= 0 and start + len(window) <= len(w)
                there = inside and tuple(w[start : start + len(window)]) == window
                if told is not None:
                    told.update(fetched=1, inside=inside, hits=there)
                if there:
                    spans.add((start, start + len(window)))
                    found.update(items)
    return spans, found


def merged(spans) -> list[tuple[int, int]]:
    """Spans with those that overlap or touch made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _find(column, sent):
    """n_words, hit_starts, hit_ends and item_ids of a batch of texts, by all blocks in turn."""
    n = len(column)
    counts, spans, items = [0] * n, [()] * n, [()] * n
    for block in held_in_turn(sent):
        for at in range(0, n, ROWS):
            for row, text in enumerate(column.slice(at, ROWS).to_pylist(), at):
                w = words(text)
                counts[row] = len(w)
                some, who = match(w, block["lengths"], block["prefixes"])
                if some:
                    spans[row], items[row] = merged(some.union(spans[row])), who.union(items[row])
    return [counts, [[a for a, _ in x] for x in spans], [[b for _, b in x] for x in spans], [sorted(x) for x in items]]


def benchmark_windows(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct (item, window) of the benchmark; items without words have none."""
    texts = items.select(F.col(id).cast("string").alias("item"), F.col(text).alias("text"))
    made = with_python(texts, _windows, ["text"], [T.StructField("windows", T.ArrayType(T.StringType()))], drop=["text"])
    return made.select("item", F.explode("windows").alias("window")).distinct()


def _split(joined: str) -> tuple[bytes, ...]:
    return tuple(joined.encode().split(b" "))


def rarities(docs: DataFrame, shingles: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """(shingle, df): in how many of the documents each of the shingles stands; those in none are left out.

    Counts are added up within a batch before they are dealt, so no shingle is too common.
    """
    blocks = -(-shingles.count() // block) or 1
    shingles = shingles.withColumn("block", F.pmod(F.xxhash64("shingle"), F.lit(blocks)))

    def load(k: int) -> dict:
        some = {_split(r.shingle) for r in shingles.where(F.col("block") == k).toLocalIterator()}  # one block
        return {"shingles": some, "lengths": sorted({len(s) for s in some})}

    sent = [docs.sparkSession.sparkContext.broadcast(load(k)) for k in range(blocks)]
    schema = T.StructType([T.StructField("shingle", T.StringType()), T.StructField("n", T.LongType())])
    counted = with_blocks(docs.select(F.col(f"`{text}`").alias("text")), sent, _count, schema)
    return counted.groupBy("shingle").agg(F.sum("n").alias("df"))


def prefixed(docs: DataFrame, windows: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """``windows`` that can stand in a document, with ``offset``, the place of their rarest shingle; ties go to the first."""
    parts = F.split("window", " ")
    run = lambda i: F.array_join(F.slice(parts, i, F.least(F.size(parts), F.lit(SHINGLE))), " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - SHINGLE + 1, F.lit(1))), run)
    each = windows.select("window").distinct().select("window", F.posexplode(runs).alias("offset", "shingle"))
    each = checkpointed(each)
    known = rarities(docs, checkpointed(each.select("shingle").distinct()), text, block)
    found = each.join(known, "shingle").groupBy("window").agg(F.min(F.struct("df", "offset")).alias("rarest"), F.count(F.lit(1)).alias("n"), F.first(F.size(parts)).alias("size"))
    whole = found.where(F.col("n") == F.greatest(F.col("size") - SHINGLE + 1, F.lit(1)))
    return windows.join(whole.select("window", F.col("rarest.offset").alias("offset")), "window")


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with n_words, hit_starts, hit_ends (merged word spans, end exclusive) and item_ids (sorted strings).

    The text column is left out, so that the hits are written out without it.
    """
    windows = checkpointed(prefixed(docs, checkpointed(benchmark_windows(items, item_id, item_text)), text, block))
    blocks = -(-windows.count() // block) or 1
    windows = windows.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)))

    def load(k: int) -> dict:
        """One block's index; in expectation ``block`` pairs of window and item, whatever the benchmark's size."""
        held: dict[bytes, bytes] = {}
        who = defaultdict(list)
        for r in windows.where(F.col("block") == k).toLocalIterator():
            window = tuple(held.setdefault(w, w) for w in _split(r.window))
            who[window, r.offset] += [] if r.item is None else [r.item]
        prefixes = defaultdict(list)
        for (window, offset), some in who.items():
            prefixes[window[offset : offset + SHINGLE]].append((offset, window, sorted(some)))
        return {"prefixes": dict(prefixes), "lengths": sorted({len(s) for s in prefixes})}

    sent = [docs.sparkSession.sparkContext.broadcast(load(k)) for k in range(blocks)]
    longs = T.ArrayType(T.LongType())
    outputs = [T.StructField("n_words", T.LongType()), T.StructField("hit_starts", longs), T.StructField("hit_ends", longs), T.StructField("item_ids", T.ArrayType(T.StringType()))]
    return with_python(docs, partial(_find, sent=sent), [text], outputs, drop=[text], arrow=True, rows=BATCH)


def keep_clean(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs.

    Texts are not dealt anew while the documents with hits are few enough to be broadcast.
    """
    mark = F.xxhash64(F.col(f"`{id}`").cast("string"), F.col(f"`{text}`"))
    found = find(docs.select(mark.alias("_qm_mark"), F.col(f"`{text}`").alias("text")), items).where(F.size("hit_starts") > 0)
    hit = checkpointed(found.select("_qm_mark").distinct())
    return docs.join(bounded(hit, HITS), mark == F.col("_qm_mark"), "left_anti")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """What every document holds of the benchmark."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)
), hit AS (SELECT r, p, iw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
whole AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN whole USING (r)
"""
