"""The text functions as expressions of the SQL that queries are compared with."""

from __future__ import annotations

from quarrymap.functions import text as X

_STEM = X.STEM.replace("'", "''")


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fold(e: str) -> str:
    return f"translate(lower(translate({e}, 'Iİ', 'ıi')), '{X.FROM}', '{X.TO}')"


def words(e: str) -> str:
    return f"regexp_extract_all({fold(e)}, '[\\p{{L}}\\p{{N}}]+')"


def stem(e: str) -> str:
    cut = e
    for _ in range(3):
        cut = f"regexp_replace({cut}, '{_STEM}', '\\1')"
    return f"CASE WHEN regexp_matches({e}, '^[0-9]+$') THEN {e} ELSE {cut} END"


def camel(e: str) -> str:
    """The parts of an identifier, by spaces set at every boundary; twice, since matches don't overlap."""
    for _ in range(2):
        for pattern in ("(\\p{Ll})(\\p{Lu})", "(\\d)([^\\d ])", "([^\\d ])(\\d)", "(\\p{Lu})(\\p{Lu}\\p{Ll})"):
            e = f"regexp_replace({e}, '{pattern}', '\\1 \\2', 'g')"
    return f"list_filter(string_split({e}, ' '), lambda x: x <> '')"


def stop_list(stopwords: list[str] | None) -> str:
    return "[" + ", ".join(map(quoted, X.stopword_set(stopwords))) + "]" if stopwords != [] else "CAST([] AS VARCHAR[])"


def _kept(parts: str, stop: str) -> str:
    """Of a list of parts those that are tokens."""
    t = fold("p")
    return f"list_filter({parts}, lambda p: (length({t}) > 1 OR regexp_matches({t}, '^[0-9]$')) AND NOT list_contains({stop}, {t}) AND NOT list_contains({stop}, {stem(t)}))"


_IDENTIFIERS = "regexp_extract_all({e}, '[\\p{{L}}\\p{{N}}_]+')"


def parts(e: str, stopwords: list[str] | None = None) -> str:
    """The parts of a text that become tokens, as written."""
    kept = _kept(camel("replace(w, '_', ' ')"), stop_list(stopwords))
    return f"flatten(list_transform({_IDENTIFIERS.format(e=e)}, lambda w: {kept}))"


def tokens(e: str, stopwords: list[str] | None = None, compounds: bool = True) -> str:
    """The search tokens of a text as a list."""
    of = camel("replace(w, '_', ' ')")
    stems = f"list_transform({_kept(of, stop_list(stopwords))}, lambda p: {stem(fold('p'))})"
    joined = fold("replace(w, '_', '')")
    whole = f"CASE WHEN len({of}) > 1 THEN [{joined}] ELSE CAST([] AS VARCHAR[]) END"
    each = f"list_concat({stems}, {whole})" if compounds else stems
    return f"flatten(list_transform({_IDENTIFIERS.format(e=e)}, lambda w: {each}))"
