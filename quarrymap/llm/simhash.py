"""SimHash near-duplicates: fingerprints, a binary trie self-join and connected components.

Any two 64-bit fingerprints that differ in at most three bits agree on at least two of five blocks. Every distinct
fingerprint is therefore filed under its ten pairs of blocks, and each file is joined with itself by walking pairs of nodes
of its binary trie, adding up the bits in which their paths differ and leaving a pair once these exceed the budget. Files with
very many fingerprints are first split by the values of four parts of the bits that are still free, again and again until
they are small, which loses no pair for the same reason. A file returns a spanning forest of its links, at most one edge for each fingerprint, never all pairs.

Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. Equal texts share a
fingerprint and so a component. Rows are judged singly: repeated rows are returned as often as they come. A null id counts
for no component's smallest id, but its fingerprint links like any other. Whole texts are read, however long. An empty table
gives an empty table. Other columns pass through, those of the result's names are replaced; helper columns begin with
``_qm_``, names that a table must not have.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymap.llm.arrow import groups, with_python
from quarrymap.session import bounded, checkpointed, table

SEED = 42
SHINGLE = 3
#: Bits in which linked fingerprints may differ.
BUDGET = 3
#: Borders of the five blocks.
BLOCKS = [(0, 13), (13, 26), (26, 39), (39, 52), (52, 64)]
#: Fingerprints beyond which a file is split.
LARGE_FILE = 2_000
#: Times that a file is split at most; no file can be large then.
SPLITS = 4
#: Rows of one fingerprint that make it common, and the common fingerprints that are broadcast.
OFTEN, COMMON = 1000, 10_000
#: Rows to drop that are broadcast at most, at two longs each.
DROPPED = 1_000_000

_WORDS = re.compile(rb"[^ \t-\r]+")


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = _WORDS.findall((text or "").encode().lower())  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``df`` with the fingerprint as a signed long."""
    return with_python(df, _fingerprints, [text], [T.StructField(out, T.LongType(), False)])


def _fingerprints(texts):
    return [[_signed(fingerprint(t)) for t in texts]]


class _Forest:
    """Which of n things are linked so far."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def trie_links(values: np.ndarray, budget: int = BUDGET, told: dict[str, int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the links between ``values``: sorted, distinct, unsigned.

    A node of the trie is a range of the sorted values that share their first bits, down to the bit where they part; single
    values are leaves. From the root's pair with itself on, the node of a pair that parts higher up is replaced by its two
    children. The bits above both nodes' parting are the errors of their paths so far; a pair beyond the budget is left, a
    pair of leaves within it is a link. A pair of nodes whose values are one component already is left alone. ``told``
    counts the pairs that were visited and those that were left for their errors.
    """
    whole = [int(v) for v in values]
    forest, links = _Forest(len(whole)), []
    one: set[tuple[int, int]] = set()
    seen = pruned = 0

    def parting(a: int, b: int) -> int:
        """One more than the highest bit in which the values of a range differ; 0 for a leaf."""
        return (whole[a] ^ whole[b - 1]).bit_length()

    def middle(a: int, b: int, part: int) -> int:
        """Where the values with the parting bit begin."""
        return bisect_left(whole, whole[b - 1] >> (part - 1) << (part - 1), a, b)

    def joined(a: int, b: int) -> bool:
        """Whether a range is one component; remembered once it is."""
        if b - a == 1 or (a, b) in one:
            return True
        r = forest.root(a)
        if all(forest.root(i) == r for i in range(a + 1, b)):
            one.add((a, b))
            return True
        return False

    todo = [(0, len(whole), 0, len(whole))] if len(whole) > 1 else []
    while todo:
        a, b, c, d = todo.pop()
        seen += 1
        p, q = parting(a, b), parting(c, d)
        if a == c:
            if not p or b - a > 8 and joined(a, b):
                continue
            m = middle(a, b, p)
            # The last one is walked first: what it joins need not be walked again.
            todo += [(a, m, m, b), (a, m, a, m), (m, b, m, b)]
            continue
        if ((whole[a] ^ whole[c]) >> max(p, q)).bit_count() > budget:
            pruned += 1
        elif not p and not q:
            if forest.join(a, c):
                links.append((a, c))
        elif b - a + d - c > 8 and joined(a, b) and joined(c, d) and forest.root(a) == forest.root(c):
            continue
        elif p >= q:
            m = middle(a, b, p)
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = middle(c, d, q)
            todo += [(a, b, c, m), (a, b, m, d)]
    if told is not None:
        told["visited"], told["pruned"] = told.get("visited", 0) + seen, told.get("pruned", 0) + pruned
    return links


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _file_links(batches, budget):
    for file in groups(batches, ["mask", "key"]):
        if file.num_rows < 2:
            continue
        values = np.sort(file.column("fp").to_numpy().view(np.uint64))
        if links := trie_links(values, budget):
            i, j = np.array(links).T
            a, b = values[i].view(np.int64), values[j].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_LINKS)


def _mask(bits: list[int]) -> int:
    """A signed long with the given bits, counted from the highest, set."""
    return _signed(sum(1 << (63 - x) for x in bits))


def _narrower(masks: list[int]) -> dict[int, list[int]]:
    """For every mask, that mask with each of four parts of its free bits added: at most three of the parts can differ."""
    out = {}
    for mask in masks:
        unset = [x for x in range(64) if not mask >> (63 - x) & 1]
        cuts = [round(i * len(unset) / (BUDGET + 1)) for i in range(BUDGET + 2)]
        out[mask] = [_signed((mask | _mask(unset[p:q])) % (1 << 64)) for p, q in zip(cuts, cuts[1:], strict=False)]
    return out


def links(fps: DataFrame, large: int = LARGE_FILE) -> DataFrame:
    """Links (a, b), a < b as signed longs, between distinct fingerprints (fp): enough to connect what is linked.

    A file is a mask and the fingerprints that are equal under it. Files larger than ``large`` are filed anew under masks
    with more bits, as often as needed; after four times a mask leaves 13 bits free, so that no file can hold more than 8192.
    """
    spark = fps.sparkSession
    masks = [_mask([x for a, b in pair for x in range(a, b)]) for pair in combinations(BLOCKS, 2)]
    filed = fps.select("fp", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask"))
    found, by = [], ["mask", "key"]
    for step in range(SPLITS + 1):
        filed = filed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = filed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        filed = checkpointed(filed.join(sizes, ["mask", "key"]))
        small = filed.where((F.col("n") <= large) | F.lit(step == SPLITS)).select(*by, "fp")
        found.append(small.repartition(*by).sortWithinPartitions(*by).mapInArrow(partial(_file_links, budget=BUDGET), "a long, b long"))
        filed = filed.where(F.col("n") > large).select("fp", "mask")
        if step == SPLITS or filed.isEmpty():
            break
        narrower = _narrower(masks)
        masks = [m for parts in narrower.values() for m in parts]
        steps = spark.createDataFrame([*narrower.items()], "mask long, masks array<long>")
        # Ten masks at first and four times as many at each step: 2560 at most.
        filed = filed.join(F.broadcast(steps), "mask").select("fp", F.explode("masks").alias("mask")).distinct()
    return reduce(DataFrame.unionAll, found).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node that can be reached.

    Each round hangs every node's larger neighbours on its smallest one and then does the same with its smaller ones; every
    round is written out, so no lineage grows. At the end each node hangs on its root.
    """
    edges = checkpointed(edges.select("a", "b").where("a < b").distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            found = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return found.unionAll(found.select("root", "root").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def with_components(df: DataFrame, id: str = "doc_id", fp: str = "fp", out: str = "component_id") -> DataFrame:
    """``df`` with the smallest id that is reachable over links of the fingerprints ``fp``; null if no row there has an id.

    Rows of the most common fingerprints, the ``COMMON`` first of those with over ``OFTEN`` rows, get theirs by a broadcast
    of that bounded table, all others by a join that no fingerprint can skew any more.
    """
    key = F.col(f"`{fp}`")
    reps = checkpointed(df.groupBy(key.alias("fp")).agg(F.min(f"`{id}`").cast("long").alias("rep"), F.count(F.lit(1)).alias("rows")))
    roots = checkpointed(reps.join(components(links(reps.select("fp"))).withColumnRenamed("node", "fp"), "fp"))
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))  # linked fingerprints only
    linked = roots.join(least, "root").select("fp", "least")
    named = reps.join(linked, "fp", "left").select(F.col("fp").alias("_qm_fp"), F.coalesce("least", "rep").alias("_qm_component"), "rows")
    common = checkpointed(named.where(F.col("rows") > OFTEN).orderBy(F.desc("rows"), "_qm_fp").limit(COMMON))
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    shown = [*kept, F.col("_qm_component").alias(out)]
    often = df.select(*kept).join(F.broadcast(common), key == F.col("_qm_fp")).select(*shown)
    rest = df.select(*kept).join(F.broadcast(common.select("_qm_fp")), key == F.col("_qm_fp"), "left_anti")
    others = named.join(F.broadcast(common.select("_qm_fp")), "_qm_fp", "left_anti")
    return often.unionByName(rest.join(others, key == F.col("_qm_fp"), "left").select(*shown))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """The fingerprint and the component of near-duplicates of every document."""
    docs = checkpointed(with_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return with_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without those whose component has a smaller id; of rows with one id the smallest stays.

    Rows with a null id have no place in a component and stay. Texts are not dealt anew while the rows to drop are few
    enough to be broadcast. Columns of maps can't be ordered: with them, repeated rows of one id end in an error.
    """
    mark = F.xxhash64(F.col(f"`{text}`"))
    prints = with_fingerprint(df.select(F.col(f"`{id}`").alias("id"), mark.alias("mark"), F.col(f"`{text}`").alias("text"))).select("id", "mark", "fp")
    told = checkpointed(with_components(checkpointed(prints), "id", out="component").where("id is not null"))
    dropped = checkpointed(told.where("id <> component").select(F.col("id").alias("_qm_id"), F.col("mark").alias("_qm_mark")).distinct())
    repeated = checkpointed(told.where("id = component").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("_qm_id")))
    left = df.join(bounded(dropped, DROPPED), (F.col(f"`{id}`") == F.col("_qm_id")) & (mark == F.col("_qm_mark")), "left_anti")
    if repeated.isEmpty():
        return left
    again, same = bounded(repeated, DROPPED), F.col(f"`{id}`") == F.col("_qm_id")
    least = left.join(again, same, "left_semi").groupBy(f"`{id}`").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("_qm_row"))
    return left.join(again, same, "left_anti").unionByName(least.select("_qm_row.*"))
