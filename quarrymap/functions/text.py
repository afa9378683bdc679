"""Turkish-aware text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of the light stemmer in folded form, and the words that search leaves out.
SUFFIXES = [
    "lerinin", "larinin", "lerine", "larina", "lerini", "larini", "lerin", "larin", "leri", "lari", "ler", "lar", "nin", "nun", "in", "un", "den",
    "dan", "ten", "tan", "de", "da", "te", "ta", "si", "su", "i", "u", "e", "a", "sinden", "sindan", "sinde", "sinda", "sine", "sina", "sini",
    "sinin", "ine", "ina", "ini", "nden", "ndan", "nde", "nda", "yla", "yle", "dir", "dur", "tir", "tur",
]
STOPWORDS = [
    "ve", "veya", "ile", "için", "bir", "bu", "şu", "mi", "mı", "mu", "mü", "var", "yok", "olan", "gibi", "göre", "bazında", "bazlı", "üzerinden",
    "bilgisi", "bilgileri", "bilgilerini", "verisi", "verileri", "tablo", "tabloda", "tablosu", "hangi", "nedir", "mevcut", "midir", "mudur", "de",
    "da", "ki", "vb", "vs", "and", "or", "with", "for", "a", "an", "the", "is", "are", "of", "in", "on", "by", "per", "which", "what", "table",
    "gösteren", "olarak", "bazda", "ihtiyacımız", "duyuyoruz", "nerede", "istiyoruz", "lazım", "içeren", "hakkında", "bulunan", "oluşan", "alan",
    "alanı", "elimizde", "şeklinde", "yer", "belirtir", "örn", "örneğin", "virgül", "ayrılacak", "sadece", "kullanan", "kullanılan", "yapan",
    "yapılan", "sahip", "ne", "kadar", "kadarı", "kadarının", "tüm", "bütün", "yalnız", "yalnızca", "ayrı", "ayrıca", "birlikte", "hem", "gerekli",
    "gereken", "görmek", "istiyorum", "aynı", "yani", "nereden", "bulurum", "alabilirim", "ulaşabilirim", "listesi", "liste",
]
FROM, TO = "ışğüöçâîûéèä", "isguocaiueea"
STEM = r"^(.{4,}?)(?:" + "|".join(sorted(SUFFIXES, key=lambda s: (-len(s), s))) + ")$"
CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\d)(?=\D)|(?<=\D)(?=\d)|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
EDGE = ".,;:'\"`"


def tr_lower(s: Column) -> Column:
    """Lower case with the two Turkish letters i."""
    return F.lower(F.translate(s, "Iİ", "ıi"))


def ascii_fold(s: Column) -> Column:
    """Turkish and common accented letters without their marks."""
    return F.translate(s, FROM, TO)


def fold(s: Column) -> Column:
    """The form in which texts are compared."""
    return ascii_fold(tr_lower(s))


def key_fold(s: Column) -> Column:
    """The form in which source keys are compared; not Turkish."""
    return casefold(F.trim(s))


def split_camel(word: Column) -> Column:
    """The parts of an identifier: at changes of case, between letters and digits, at underscores."""
    return F.filter(F.flatten(F.transform(F.split(word, "_"), lambda w: F.split(w, CAMEL))), lambda p: p != "")


def stem(token: Column) -> Column:
    """Up to three times the longest suffix off, with four letters left; numbers stay."""
    cut = reduce(lambda t, _: F.regexp_replace(t, STEM, "$1"), range(3), token)
    return F.when(token.rlike(r"^\d+$"), token).otherwise(cut)


def _folded(word: str) -> str:
    return word.replace("I", "ı").replace("İ", "i").lower().translate(str.maketrans(FROM, TO))


def _stemmed(token: str) -> str:
    import re

    for _ in range(3):
        token = re.sub(STEM, r"\1", token)
    return token


def folded(word: str) -> str:
    """``fold`` of one word of a fixed list, on the driver."""
    return _folded(word)


def stopword_set(words: list[str] | None = None) -> list[str]:
    """Folded and stemmed forms of the words, sorted."""
    folded = {_folded(w.strip()) for w in (STOPWORDS if words is None else words) if w.strip()}
    return sorted(folded | {_stemmed(w) for w in folded})


def token_pairs(text: Column, stopwords: list[str] | None = None, stems: bool = True, compounds: bool = True) -> Column:
    """array<struct<token, surface>> of search tokens in order: folded parts of identifiers without stopwords, then each
    compound as a whole; the surface is the part in Turkish lower case. ``stopwords``: words as users write them, [] for none."""
    stop = F.array(*map(F.lit, stopword_set(stopwords))) if stopwords != [] else F.array().cast("array<string>")
    pair = lambda t, s: F.struct(t.alias("token"), s.alias("surface"))

    def of(word):
        parts = F.transform(split_camel(word), lambda p: pair(fold(p), tr_lower(p)))
        left = F.filter(parts, lambda p: ((F.length(p["token"]) > 1) | p["token"].rlike(r"^\d$")) & ~F.array_contains(stop, p["token"]) & ~F.array_contains(stop, stem(p["token"])))
        tokens = F.transform(left, lambda p: pair(stem(p["token"]), p["surface"])) if stems else left
        whole = F.when(F.size(parts) > 1, F.array(pair(fold(F.replace(word, F.lit("_"), F.lit(""))), tr_lower(word)))).otherwise(F.array().cast("array<struct<token:string,surface:string>>"))
        return F.concat(tokens, whole) if compounds else tokens

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), of))


def tokenize(text: Column, stopwords: list[str] | None = None, stems: bool = True, compounds: bool = True) -> Column:
    """The tokens of ``token_pairs``."""
    return F.transform(token_pairs(text, stopwords, stems, compounds), lambda p: p["token"])


def words(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def text_key(text: Column) -> Column:
    """Folded words with one space between them."""
    return F.array_join(words(text), " ")


def contains_sequence(hay: Column, needle: Column) -> Column:
    """Whether the tokens of ``needle`` stand side by side in ``hay``."""
    padded = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(needle) > 0) & F.contains(padded(hay), padded(needle))


def split_terms(text: Column) -> Column:
    """Terms between commas and semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[,;]"), lambda t: F.trim(t)), lambda t: t != "")


def casefold(s: Column) -> Column:
    """Lower case for comparison; the two letters that differ from their lower case when folded are folded as well."""
    return F.replace(F.replace(F.lower(s), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def normal_form(name: Column) -> Column:
    """A name without white space, format characters and punctuation at its edges, folded."""
    bare = F.regexp_replace(name, r"(?U)[\s\p{Cf}]", "")
    return casefold(F.regexp_replace(bare, r"^[.,;:'\"`]+|[.,;:'\"`]+$", ""))


def slugify(text: Column) -> Column:
    """The first forty characters, folded, with one underscore for what is no letter or digit."""
    return F.regexp_replace(F.regexp_replace(fold(F.substring(text, 1, 40)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clip(text: Column, n: int) -> Column:
    """One line of at most n characters, cut at a space and marked where it is cut."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(line, 1, n)
    cut = F.when(head.contains(" "), F.regexp_extract(head, "^(.*) [^ ]*$", 1)).otherwise(head)
    return F.when(F.length(line) <= n, line).otherwise(F.concat(cut, F.lit("…")))


def cell(value: Column) -> Column:
    """A sheet's cell as text: missing as empty, whole numbers without a fraction, trimmed."""
    return F.coalesce(F.regexp_replace(F.trim(value.cast("string")), r"^(-?\d+)\.0+$|^NaN$", "$1"), F.lit(""))


def sentences(text: Column) -> Column:
    """Sentences; known abbreviations end none."""
    return F.filter(F.split(text, r"(?<=[.!?])(?<!\bör\.)(?<!\bvb\.)(?<!\bbkz\.)\s+"), lambda s: s != "")


def ngrams(tokens: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` tokens, joined by one space."""
    return once(tokens, lambda t: F.flatten(F.array(*(_runs(t, F.size(t), k) for k in range(1, longest + 1)))))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once for a row, however often a lambda asks for it."""
    return F.transform(F.array(value), use)[0]


def _runs(tokens: Column, n: Column, k: int) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.when(n >= k, made).otherwise(F.array().cast("array<string>"))


def split_synonyms(text: Column) -> Column:
    """Items between commas that stand outside brackets, trimmed, without stops at their ends and without empty ones."""
    start = F.struct(F.array().cast("array<string>").alias("items"), F.lit("").alias("now"), F.lit(0).alias("depth"))

    def step(done, c):
        depth = F.when(c.isin("(", "["), done["depth"] + 1).when(c.isin(")", "]") & (done["depth"] > 0), done["depth"] - 1).otherwise(done["depth"])
        cut = (c == ",") & (depth == 0)
        items = F.when(cut, F.concat(done["items"], F.array(done["now"]))).otherwise(done["items"])
        return F.struct(items.alias("items"), F.when(cut, "").otherwise(F.concat(done["now"], c)).alias("now"), depth.alias("depth"))

    characters = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    items = F.aggregate(characters, start, step, lambda done: F.concat(done["items"], F.array(done["now"])))
    bare = F.transform(items, lambda x: F.trim(F.regexp_replace(F.trim(x), r"\.+$", "")))
    return F.filter(bare, lambda x: x != "")


def escape_like(text: Column) -> Column:
    """The text as a LIKE pattern that matches only itself, with a backslash as escape."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def clip_plain(text: Column, n: int) -> Column:
    """At most n characters, cut at a space and without punctuation before the cut."""
    head = F.substring(text, 1, n)
    at_space = F.regexp_replace(F.regexp_extract(head, "(?s)^(.*) [^ ]*$", 1), "[ ·,;:(]+$", "")
    return F.when(F.length(text) <= n, text).when(head.contains(" "), at_space).otherwise(head)


def column_letter(number: Column) -> Column:
    """The letters of a sheet's column, counted from 0: A, Z, AA; after ZZZ comes AAAA. Null for null."""
    start = F.struct((number.cast("long") + 1).alias("rest"), F.lit("").alias("letters"))

    def step(done, _):
        digit = (done["rest"] - 1) % 26
        more = F.struct(F.call_function("div", done["rest"] - 1, F.lit(26)).alias("rest"), F.concat(F.char(digit + 65), done["letters"]).alias("letters"))
        return F.when(done["rest"] > 0, more).otherwise(done)

    return F.when(number.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda done: done["letters"]))


def name_parts(name: Column, least: int = 3) -> Column:
    """The parts of a name at changes of case, of ``least`` letters or more."""
    upper, lower = "A-ZÇĞİÖŞÜ", "a-zçğıöşü"
    found = F.regexp_extract_all(name, F.lit(f"[{upper}]+(?![{lower}])|[{upper}]?[{lower}]+"), F.lit(0))
    return F.filter(found, lambda p: F.length(p) >= least)


def term_hits(terms: Column, name: Column, description: Column) -> Column:
    """How many of the terms of three characters or more a column's folded name and description hold."""
    text = F.concat(fold(name), F.lit(" "), fold(description))
    return F.size(F.filter(terms, lambda t: (F.length(F.trim(t)) >= 3) & F.contains(text, fold(t))))


def sentences_naming(column: Column, texts: Column) -> Column:
    """The distinct sentences of the texts that name a column as a whole word."""
    every = F.flatten(F.transform(texts, sentences))
    word = F.concat(F.lit(r"(?U)\b"), F.regexp_replace(column, r"([^\p{L}\p{N}_])", r"\\$1"), F.lit(r"\b"))
    return F.array_distinct(F.transform(F.filter(every, lambda s: F.rlike(s, word)), lambda t: F.trim(t)))
