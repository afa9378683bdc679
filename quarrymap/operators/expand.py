"""What a question asks for: concepts, matched term groups, and the weighted words of the search.

Many questions are read at once. A vocabulary is a bounded list (gid, term, equivalents, domain, note); its phrases meet the
questions' runs of words by a join, and the greedy choice among a question's few hits is an aggregate over their array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymap.functions import text as X
from quarrymap.operators.features import copies
from quarrymap.session import bounded, checkpointed

# Words that ask for a time, a breakdown or a measure, and what meets a measure.
TIME_WORDS = [
    ("aylik", "aylık"), ("monthly", "aylık"), ("ay sonu", "aylık"), ("gunluk", "günlük"), ("daily", "günlük"), ("haftalik", "haftalık"), ("weekly", "haftalık"),
    ("yillik", "yıllık"), ("yearly", "yıllık"), ("annual", "yıllık"), ("ceyrek", "çeyreklik"), ("quarter", "çeyreklik"), ("donemsel", "dönemsel"), ("periyodik", "dönemsel"),
]
BREAKDOWN_WORDS = ["kirilim", "breakdown", "detay"]
MEASURE_WORDS = [
    ("oran", "oran"), ("yuzde", "oran"), ("rate", "oran"), ("ratio", "oran"), ("percent", "oran"), ("adet", "adet"), ("sayi", "adet"), ("count", "adet"),
    ("tutar", "tutar"), ("bakiye", "tutar"), ("amount", "tutar"), ("balance", "tutar"),
]
MEASURES = {"oran": ["oran", "rate", "ratio", "yuzde", "percent"], "adet": ["adet", "sayi", "count", "cnt"], "tutar": ["tutar", "bakiy", "amount", "balanc", "toplam"]}
MEASURE_DOMAINS = ["finansal"]
SCOPE_PREFIX = "kapsam:"
QUERY_STOPWORDS = ["değil", "hariç", "dışında"]
NEGATIONS = ["yok", "degil", "haric", "harici", "disinda", "olmayan", "olmadan", "olmayanlar", "hic", "without", "except", "not", "no"]
TERM, TIME, BREAKDOWN, MEASURE = "terim", "zaman", "kırılım", "ölçü"
MEMBER_WEIGHT = 0.6
LONGEST_PHRASE, GENERIC = 6, 40
#: Phrases that are broadcast at most, and that are looked up in a row's map at most.
ASKED_PHRASES, ROW_PHRASES = 200_000, 1000
MOST_CHARACTERS = 4000

_CONCEPT = "struct<kind:string,label:string,alternatives:array<array<string>>,value:string,breakdown_value:boolean,scope_note:string>"


def checked(text: Column) -> Column:
    """Why a question can't be asked: query_empty, query_too_long, query_invalid_characters; null if it can."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(bare == "", "query_empty").when(F.length(bare) > MOST_CHARACTERS, "query_too_long").when(bare.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), "query_invalid_characters")


def phrases(vocabulary: DataFrame) -> DataFrame:
    """(gid, member, tokens, phrase, place): longer phrases first, then groups' own terms, then in order of the vocabulary.

    A vocabulary is bounded, so one window over all of it is no burden.
    """
    members = vocabulary.select("gid", F.posexplode(F.concat(F.array("term"), "equivalents")).alias("pos", "member"), "term")
    made = members.withColumn("tokens", X.tokenize(F.col("member"), [], compounds=False)).where(F.size("tokens") > 0)
    order = Window.orderBy(-F.size("tokens"), F.col("member") != F.col("term"), "gid", "pos")
    return made.select("gid", "pos", "member", "tokens", F.array_join("tokens", " ").alias("phrase"), F.row_number().over(order).alias("place"))


def _runs(tokens: Column, longest: int) -> Column:
    """All runs of up to ``longest`` tokens, as (start, n, phrase)."""

    def of(n):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(tokens, i + 1, n), " ").alias("phrase")))

    return F.concat(*(of(n) for n in range(1, longest + 1)))


def greedy(hits: Column) -> Column:
    """Of hits (place, start, n, ..) in order of place and start, those that overlap none before them."""
    over = lambda a, b: (a["start"] < b["start"] + b["n"]) & (b["start"] < a["start"] + a["n"])
    none = F.filter(hits, lambda _: F.lit(False))
    return F.aggregate(F.array_sort(hits), none, lambda done, h: F.when(F.exists(done, lambda d: over(d, h)), done).otherwise(F.concat(done, F.array(h))))


def _starts(word: Column, prefixes: list[str]) -> Column:
    return word.rlike("^(?:" + "|".join(prefixes) + ")")


def _first(word: Column, pairs: list[tuple[str, str]], holds) -> Column:
    """The value of the first pair, in order, whose key the word holds."""
    out = F.lit(None).cast("string")
    for key, value in reversed(pairs):
        out = F.when(holds(word, key), F.lit(value)).otherwise(out)
    return out


def expand(questions: DataFrame, vocabulary: DataFrame, stopwords: list[str] | None = None, longest: int = 8) -> DataFrame:
    """``questions`` (query, text) with what they ask for.

    tokens, raw_words, concepts, terms (array<struct<term, weight>>), groups (matched gids in order), expansion_terms,
    expansion_tokens, consumed. ``longest``: words of the longest phrase of the vocabulary at least.
    """
    stop = (X.STOPWORDS if stopwords is None else stopwords) + QUERY_STOPWORDS
    q = questions.select(
        "query",
        "text",
        X.token_pairs(F.col("text"), stop, compounds=False).alias("pairs"),
        F.array_distinct(X.tokenize(F.col("text"), stop)).alias("searched"),
        F.array_distinct(F.transform(F.regexp_extract_all(F.col("text"), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.replace(X.fold(w), F.lit("_"), F.lit("")))).alias("raw_words"),
    )
    q = checkpointed(q)
    q = q.withColumns({"tokens": F.transform("pairs", lambda p: p["token"]), "surfaces": F.transform("pairs", lambda p: X.fold(p["surface"]))})
    known = checkpointed(phrases(vocabulary))
    hits = q.select("query", F.explode(_runs(F.col("tokens"), longest)).alias("r")).select("query", "r.*").join(F.broadcast(known.drop("tokens")), "phrase")  # a bounded list
    chosen = hits.groupBy("query").agg(greedy(F.collect_list(F.struct("place", "start", "n", "gid", "member"))).alias("spans"))
    # Groups in order of the question, each once, by the member that stands first.
    in_order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["gid"].alias("gid"), s["member"].alias("member"))))
    once = F.aggregate(in_order, F.filter(in_order, lambda _: F.lit(False)), lambda done, s: F.when(F.exists(done, lambda d: d["gid"] == s["gid"]), done).otherwise(F.concat(done, F.array(s))))
    chosen = checkpointed(chosen.select("query", "spans", once.alias("matched")))

    members = known.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("pos", "member", "tokens"))).alias("members")).join(F.broadcast(vocabulary.select("gid", "domain", "note")), "gid")
    told = chosen.select("query", F.posexplode("matched").alias("at", "m")).join(F.broadcast(members), F.col("m.gid") == F.col("gid"))  # a bounded list
    group = F.struct("at", "gid", F.col("m.member").alias("member"), "members", (~X.fold(F.coalesce("domain", F.lit(""))).isin(MEASURE_DOMAINS)).alias("content"), F.when(X.fold(F.coalesce("note", F.lit(""))).startswith(SCOPE_PREFIX), F.col("note")).otherwise("").alias("scope"))
    told = told.groupBy("query").agg(F.array_sort(F.collect_list(group)).alias("told"))
    q = checkpointed(q.join(chosen.select("query", "spans"), "query", "left").join(told, "query", "left"))
    q = q.withColumn("told", F.coalesce("told", F.filter(F.array(F.lit(None).cast(told.schema["told"].dataType.elementType)), lambda _: F.lit(False))))

    alternatives = lambda g: F.array_distinct(F.transform(g["members"], lambda m: m["tokens"]))
    concept = lambda kind, label, alts, value, scope: F.struct(F.lit(kind).alias("kind"), label.alias("label"), alts.alias("alternatives"), value.alias("value"), F.lit(False).alias("breakdown_value"), scope.alias("scope_note"))
    empty, no_alts, nothing = F.lit(""), F.array().cast("array<array<string>>"), F.array().cast(f"array<{_CONCEPT}>")
    time = _first(F.array_join("surfaces", " "), TIME_WORDS, lambda w, k: F.contains(w, F.lit(k)))
    of_word = lambda w: _first(w, MEASURE_WORDS, lambda x, k: F.startswith(x, F.lit(k)))
    measure = F.get(F.filter(F.transform("surfaces", of_word), lambda v: v.isNotNull()), F.lit(0))
    measure_alts = F.lit(None).cast("array<array<string>>")
    for value, words in MEASURES.items():
        measure_alts = F.when(measure == value, F.array(*(F.array(F.lit(w)) for w in words))).otherwise(measure_alts)
    q = q.withColumns({"time": time, "has_breakdown": F.exists("surfaces", lambda w: _starts(w, BREAKDOWN_WORDS)), "measure": measure, "measure_alts": measure_alts})
    special = lambda w: _starts(w, BREAKDOWN_WORDS + [k for k, _ in TIME_WORDS + MEASURE_WORDS])
    consumed = F.flatten(F.transform(F.coalesce("spans", F.array().cast(chosen.schema["spans"].dataType)), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    q = q.withColumn("consumed", consumed)
    placed = F.transform("pairs", lambda p, i: F.struct(i.alias("i"), p["token"].alias("token"), p["surface"].alias("surface")))
    free = F.filter(placed, lambda p: ~F.array_contains("consumed", p["i"]) & ~special(F.get(F.col("surfaces"), p["i"])) & ~p["token"].rlike(r"^\d+$"))
    rest = F.aggregate(free, F.filter(free, lambda _: F.lit(False)), lambda done, p: F.when(F.exists(done, lambda d: d["token"] == p["token"]), done).otherwise(F.concat(done, F.array(p))))
    concepts = F.concat(
        F.when(F.col("time").isNotNull(), F.array(concept(TIME, F.col("time"), no_alts, F.col("time"), empty))).otherwise(nothing),
        F.when(F.col("has_breakdown"), F.array(concept(BREAKDOWN, F.lit("kırılım"), no_alts, empty, empty))).otherwise(nothing),
        F.transform(F.filter("told", lambda g: g["content"]), lambda g: concept(TERM, g["member"], alternatives(g), empty, g["scope"])),
        F.when(F.col("measure").isNotNull(), F.array(concept(MEASURE, F.col("measure"), F.col("measure_alts"), F.col("measure"), empty))).otherwise(nothing),
        F.transform(rest, lambda p: concept(TERM, p["surface"], F.array(F.array(p["token"])), empty, empty)),
    )
    # In a question for a breakdown, terms whose words all stand in brackets are its values.
    listed = X.tokenize(F.array_join(F.regexp_extract_all("text", F.lit(r"\(([^)]*)\)"), F.lit(1)), " ; "), stopwords, compounds=False)
    q = q.withColumns({"concepts": concepts, "listed": F.when(F.col("has_breakdown"), listed).otherwise(F.array().cast("array<string>"))})

    def marked(c):
        own = X.tokenize(c["label"], [], compounds=False)
        value = (c["kind"] == TERM) & (F.size(own) > 0) & (F.size(F.array_except(own, F.col("listed"))) == 0)
        return c.withField("breakdown_value", value)

    added = F.array_except(F.array_distinct(F.flatten(F.flatten(F.transform("told", alternatives)))), F.col("searched"))
    # A member is shown if it brings a word that neither the question nor an earlier member has.
    every = F.flatten(F.transform("told", lambda g: g["members"]))
    start = F.struct(F.col("searched").alias("have"), F.array().cast("array<string>").alias("shown"))
    step = lambda done, m: F.struct(F.array_union(done["have"], m["tokens"]).alias("have"), F.when(F.size(F.array_except(m["tokens"], done["have"])) > 0, F.concat(done["shown"], F.array(m["member"]))).otherwise(done["shown"]).alias("shown"))
    shown = F.aggregate(every, start, step, lambda done: F.array_distinct(done["shown"]))
    weigh = lambda tokens, w: F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))
    q = q.withColumns({"concepts": F.transform("concepts", marked), "expansion_tokens": added})
    return checkpointed(q.select(
        "query", "text", "tokens", "raw_words", "concepts", F.concat(weigh(F.col("searched"), 1.0), weigh(F.col("expansion_tokens"), MEMBER_WEIGHT)).alias("terms"),
        F.transform("told", lambda g: g["gid"]).alias("groups"), F.exists("told", lambda g: F.exists(g["members"], lambda m: (m["pos"] == 0) & X.fold(m["member"]).startswith("musteri"))).alias("customer_group"),
        shown.alias("expansion_terms"), "expansion_tokens",
    ))


def is_content(c: Column) -> Column:
    return c["kind"].isin(TERM, MEASURE)


def _named(expanded: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, phrase) of the columns' synonyms that questions name; (query, phrase) of those that count."""
    listed = features.select("id", copies(features).alias("copies"), F.explode(_listed()).alias("p")).select("id", "copies", "p.phrase", "p.n")
    asked = checkpointed(expanded.select("query", F.explode(F.array_distinct(F.transform(_runs(F.col("tokens"), LONGEST_PHRASE), lambda r: r["phrase"]))).alias("phrase")))
    entries = listed.join(bounded(asked.select("phrase").distinct(), ASKED_PHRASES), "phrase", "left_semi")
    wide = entries.groupBy("phrase", "n").agg(F.sum("copies").alias("columns")).where((F.col("n") > 1) | (F.col("columns") <= GENERIC)).select("phrase")
    asked = checkpointed(asked.join(wide, "phrase", "left_semi"))
    return entries.drop("copies"), bounded(asked, ASKED_PHRASES)


def _listed() -> Column:
    """The different synonyms (n, phrase) of a row, of ``LONGEST_PHRASE`` words at most."""
    short = F.array_distinct(F.filter("f_synonyms", lambda p: F.size(p) <= LONGEST_PHRASE))
    return F.transform(short, lambda p: F.struct(F.size(p).alias("n"), F.array_join(p, " ").alias("phrase")))


def named_in_rows(expanded: DataFrame, features: DataFrame) -> DataFrame:
    """``features`` with ``named``: (query, n, phrase) of the synonyms that questions name, by the rule of ``synonym_hits``.

    Few phrases are looked up in each row and nothing is dealt; many are joined by the row's id.
    """
    entries, asked = _named(expanded, features)
    kind = f"array<struct<query:{expanded.schema['query'].dataType.simpleString()},n:int,phrase:string>>"
    if asked.select("phrase").distinct().count() > ROW_PHRASES:
        by_id = entries.join(asked, "phrase").groupBy("id").agg(F.collect_list(F.struct("query", "n", "phrase")).alias("named"))
        return features.join(by_id, "id", "left").withColumn("named", F.coalesce("named", F.array().cast(kind)))
    by = asked.groupBy("phrase").agg(F.collect_set("query").alias("queries"))
    table = checkpointed(by.agg(F.map_from_entries(F.collect_list(F.struct("phrase", "queries"))).alias("by_phrase")))
    met = F.filter(_listed(), lambda p: F.map_contains_key("by_phrase", p["phrase"]))
    named = F.flatten(F.transform(met, lambda p: F.transform(F.element_at("by_phrase", p["phrase"]), lambda q: F.struct(q.alias("query"), p["n"].alias("n"), p["phrase"].alias("phrase")))))
    return features.crossJoin(F.broadcast(table)).withColumn("named", F.coalesce(named, F.array().cast(kind))).drop("by_phrase")


def synonym_hits(expanded: DataFrame, features: DataFrame) -> DataFrame:
    """(query, id, phrases): columns whose synonyms a question names, longest runs first; single words of over 40 columns don't count."""
    entries, asked = _named(expanded, features)
    found = entries.join(asked, "phrase")
    return found.groupBy("query", "id").agg(F.transform(F.array_sort(F.collect_set(F.struct((-F.col("n")).alias("n"), "phrase"))), lambda r: r["phrase"]).alias("phrases"))


def meaning_key(text: Column, concepts: Column) -> Column:
    """One key for questions of one meaning: what meets their concepts, their numbers and negations; empty without content."""
    alts = lambda c: F.array_join(F.array_sort(F.transform(c["alternatives"], lambda a: F.array_join(a, "+"))), ",")
    parts = F.transform(concepts, lambda c: F.concat_ws(":", c["kind"], c["value"], alts(c), c["breakdown_value"].cast("int").cast("string")))
    words = X.words(text)
    numbers = F.transform(F.filter(words, lambda w: w.rlike(r"^\d+$")), lambda w: F.concat(F.lit("sayı:"), w))
    negated = F.transform(F.filter(words, lambda w: w.isin(NEGATIONS)), lambda w: F.concat(F.lit("olumsuz:"), w))
    key = F.array_join(F.array_sort(F.array_distinct(F.concat(parts, numbers, negated))), "|")
    return F.when(F.exists(concepts, is_content), key).otherwise("")
