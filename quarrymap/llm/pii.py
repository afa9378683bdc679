"""Personal data by information-theoretic sanitisation, by DataFrame functions only.

Patterns find the protected entities: e-mail addresses, IP addresses, card numbers and telephone numbers; spellings of one
address or number are one entity. Terms in a document with an entity may reveal it as well. How strongly, corpus co-occurrence
tells: with counts of documents N, n(c), n(t), n(c, t) the pointwise mutual information log2(n(c, t) N / (n(c) n(t))) is set
against the entity's own information log2(N / n(c)); a term that gives ``DISCLOSURE`` of it or more, in ``SUPPORT`` different
texts or more, is a span too, of kind ``term``, wherever it stands outside the base spans, in any document. Documents are
rows, and counts are over all of them. Different texts are needed, so that copies of a document are one piece of evidence, not
many; of an entity in fewer texts, chance and disclosure can't be told apart, since any rare word beside it would count.

Null and empty texts have no spans. Spans depend on the text alone: repeated rows have the same ones, and each counts as a
document; rows with null ids are judged by their text. Spans that overlap are masked as one, by the kind of the first, of
equal starts the longer. Whole texts are read, however long. An empty table gives an empty one. Other columns pass through
``sanitise``; helper columns begin with ``_qm_``, names that a table must not have. Texts are not dealt anew while the texts
that hold a telling term are few enough to be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymap.llm.spans import matches
from quarrymap.session import bounded, checkpointed, table

KINDS = ["email", "ip", "card", "phone"]
#: The contract's patterns with possessive repeats and anchors that cut off hopeless starts: the same matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Share of an entity's information that a term must give to be a span, and the different texts that must show it.
DISCLOSURE, SUPPORT = 0.9, 3
#: A term: letters that it has at least.
TERM = r"\p{L}{4,}+"
#: Terms, or entities' texts, that are broadcast at most; beyond, joins deal both sides.
BROADCAST_TERMS = 200_000
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    digits = F.regexp_replace(part, "^0+", "")
    return (F.length(digits) < 3) | ((F.length(digits) == 3) & (digits <= "255"))


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of a text by kind, as arrays of (start, end, value)."""
    text = F.coalesce(text, F.lit(""))
    card_digits = lambda m: _digits(m["value"])
    return {
        "email": matches(text, EMAIL, text.contains("@")),
        "ip": F.filter(matches(text, IP), lambda m: F.forall(F.split(m["value"], r"\."), _small)),
        "card": F.filter(matches(text, CARD, text.rlike("[0-9](?:[ -]?[0-9]){15}")), lambda m: F.when(F.length(card_digits(m)).between(16, 19), _luhn(card_digits(m))).otherwise(False)),
        "phone": F.filter(matches(text, PHONE, text.contains("+")), lambda m: F.length(_digits(m["value"])).between(8, 15)),
    }


def _entities(spans: dict[str, Column]) -> Column:
    """The distinct entities of the base spans: without case and sub-address of e-mails, or the separators of numbers."""
    normal = {"email": lambda v: F.regexp_replace(F.lower(v), r"\+[^@]*", ""), "ip": lambda v: v, "card": _digits, "phone": _digits}
    one = lambda kind: lambda m: F.concat(F.lit(kind + "|"), normal[kind](m["value"]))
    return F.array_distinct(F.concat(*(F.transform(spans[k], one(k)) for k in KINDS)))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _marks(text: Column) -> dict[str, Column]:
    """Two hashes that stand for a text."""
    return {"_qm_h1": F.xxhash64(text), "_qm_h2": F.xxhash64(F.lit(1), text)}


MARKS = ["_qm_h1", "_qm_h2"]


def telling_terms(texts: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame | None:
    """The terms that tell too much of an entity of the rows (MARKS, _qm_text), written out; None if no entity can have any."""
    n = F.lit(max(1, texts.count()))
    known = F.log2(n / F.col("n_c"))
    told = F.log2(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t")))
    named = texts.select(*MARKS, _entities(base_spans(F.col("_qm_text"))).alias("entities")).where(F.size("entities") > 0)
    # One row for each entity and different text, with the number of rows that have that text.
    named = checkpointed(named.select(*MARKS, F.explode("entities").alias("entity")).groupBy(*MARKS, "entity").agg(F.count(F.lit(1)).alias("rows")))
    entities = named.groupBy("entity").agg(F.sum("rows").alias("n_c"), F.count(F.lit(1)).alias("texts")).where((F.col("texts") >= support) & (known > 0)).drop("texts")
    shared = checkpointed(named.join(entities, "entity"))
    if shared.isEmpty():
        return None
    held = bounded(checkpointed(shared.select(*MARKS).distinct()), BROADCAST_TERMS)
    worded = texts.join(held, MARKS, "left_semi").select(*MARKS, _terms(F.col("_qm_text")).alias("terms")).groupBy(*MARKS).agg(F.first("terms").alias("terms"))
    both = shared.join(worded, MARKS).select("entity", "n_c", "rows", *MARKS, F.explode("terms").alias("term"))
    both = both.groupBy("entity", "term").agg(F.first("n_c").alias("n_c"), F.sum("rows").alias("n_ct"), F.count(F.lit(1)).alias("shown")).where(F.col("shown") >= support)
    # A term is in at least as many documents as it shares with one entity, so one that tells too little by that count is none.
    beside = both.groupBy("term").agg(F.max("n_ct").alias("n_t"))
    both = checkpointed(both.join(beside, "term").where(told >= disclosure * known).drop("n_t"))
    # All terms are counted, within a task first, before any is picked: no term's documents are ever rows of a join.
    counted = texts.select(F.explode(_terms(F.col("_qm_text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    return checkpointed(both.join(counted, "term").where(told >= disclosure * known).select("term").distinct())


def with_spans(docs: DataFrame, text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with ``_qm_spans``: array<struct<kind, start, end>> by kind (email, ip, card, phone, term) and start."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(value.alias("_qm_text")).withColumns(_marks(F.col("_qm_text")))
    placed = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    found = base_spans(value)
    base = F.concat(*(F.transform(found[k], placed(k)) for k in KINDS))
    terms = telling_terms(texts, disclosure, support)
    if terms is None or terms.isEmpty():
        return docs.withColumn("_qm_spans", base)
    each = texts.select(*MARKS, F.explode(_terms(F.col("_qm_text"))).alias("term")).join(bounded(terms, BROADCAST_TERMS), "term", "left_semi")
    holders = checkpointed(each.groupBy(*MARKS).agg(F.collect_set("term").alias("_qm_terms")))
    size = holders.agg(F.sum(F.size("_qm_terms"))).first()[0] or 0
    marked = docs.withColumns({"_qm_base": base} | _marks(value)).join(F.broadcast(holders) if size <= BROADCAST_TERMS else holders, MARKS, "left")
    outside = lambda m: ~F.exists("_qm_base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
    added = F.filter(F.filter(matches(value, TERM), lambda m: F.array_contains("_qm_terms", F.lower(m["value"]))), outside)
    spans = F.when(F.col("_qm_terms").isNull(), F.col("_qm_base")).otherwise(F.concat("_qm_base", F.transform(added, placed("term"))))
    return marked.withColumn("_qm_spans", spans).drop(*MARKS, "_qm_base", "_qm_terms")


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The id and ``spans`` of each row of ``docs``: array<struct<kind, start, end>> by kind and start; code points, end exclusive."""
    some = docs.select(F.col(f"`{id}`").alias("_qm_id"), F.col(f"`{text}`").alias("text"))
    return with_spans(some, "text", disclosure, support).select(F.col("_qm_id").alias(id), F.col("_qm_spans").alias("spans"))


def sanitise(docs: DataFrame, id: str = "doc_id", text: str = "text", remove: bool = False) -> DataFrame:
    """``docs`` with every span of the text generalised to the name of its kind, or removed; other columns as they are."""
    value = F.col(f"`{text}`")
    by_start = F.array_sort("_qm_spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    empty = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("parts"))

    def step(done, span):
        mask = F.lit("") if remove else reduce(lambda other, k: F.when(span["kind"] == k, F.lit(MASKS[k])).otherwise(other), MASKS, F.lit(""))
        gap = F.substring(value, done["upto"] + 1, span["start"] - done["upto"])
        more = F.when(span["start"] >= done["upto"], F.array(gap, mask)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(done["upto"], span["end"]).alias("upto"), F.concat(done["parts"], more).alias("parts"))

    clean = F.aggregate(by_start, empty, step, lambda d: F.concat(F.array_join(d["parts"], ""), F.substring(value, d["upto"] + 1, F.length(value))))
    told = F.when(F.size("_qm_spans") > 0, clean).otherwise(value).alias(text)
    return with_spans(docs, text).select(*(told if c == text else F.col(f"`{c}`") for c in docs.columns))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    of = lambda k: lambda s: s["kind"] == k
    counts = {f"n_{k}": F.size(F.filter("spans", of(k))).cast("long") for k in [*KINDS, "term"]}
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
