"""The pipeline's rows against a plain version of its stages on the smallest tables."""

import hashlib
import math
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_operators import DATA, brute_fingerprint, brute_spans

from quarrymap.llm import pii, quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def near_duplicates(docs):
    """The ids without those that reach a smaller one over links of at most three bits."""
    prints = {d: brute_fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in docs}
    changed = True
    while changed:
        changed = False
        for d in docs:
            for e in docs:
                if (prints[d] ^ prints[e]).bit_count() <= 3 and root[e] < root[d]:
                    root[d], changed = root[e], True
    return {d: t for d, t in docs.items() if root[d] == d}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def clean_of(docs, items):
    sought = {w for t in items if (ws := words(t)) for w in windows(ws, min(10, len(ws)))}
    lengths = {len(w) for w in sought}
    return {d: t for d, t in docs.items() if not any(windows(words(t), n) & sought for n in lengths)}


def terms_by_document(docs):
    """The places of telling terms, counted one by one over whole documents."""
    import regex

    def entities(text):
        out = set()
        for span in brute_spans(text):
            kind, a, b = span.split(":")
            value = text[int(a) : int(b)]
            if kind == "email":
                value = re.sub(r"\+[^@]*", "", value.lower())
            elif kind != "ip":
                value = re.sub("[^0-9]", "", value)
            out.add(f"{kind}|{value}")
        return out

    words_of = {d: {m[0].lower() for m in regex.finditer(r"\p{L}{4,}", t or "")} for d, t in docs.items()}
    of = {d: entities(t or "") for d, t in docs.items()}
    telling = set()
    for c in set().union(*of.values()):
        holders = [d for d in docs if c in of[d]]
        known = math.log2(len(docs) / len(holders))
        for t in set().union(*(words_of[d] for d in holders)):
            both = [d for d in holders if t in words_of[d]]
            told = math.log2(len(both) * len(docs) / (len(holders) * sum(t in w for w in words_of.values())))
            if len({docs[d] for d in both}) >= pii.SUPPORT and known > 0 and told >= pii.DISCLOSURE * known:
                telling.add(t)
    out = defaultdict(set)
    for d, text in docs.items():
        base = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(text)]
        for m in regex.finditer(r"\p{L}{4,}", text or ""):
            if m[0].lower() in telling and not any(a < m.end() and m.start() < b for a, b in base):
                out[d].add((m.start(), m.end(), "term"))
    return out


def generalised(docs):
    added, out = terms_by_document(docs), {}
    for d, text in docs.items():
        spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in brute_spans(text))]
        upto, parts = 0, []
        for a, b, kind in sorted([*spans, *added[d]], key=lambda s: (s[0], -s[1])):
            if a >= upto:
                parts += [text[upto:a], pii.MASKS[kind]]
            upto = max(upto, b)
        out[d] = "".join(parts) + text[upto:] if parts else text
    return out


def test_pipeline_by_brute_force(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]
    # The fitted model has no plain version; what it scores and rejects has.
    model = quality.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {d: t for d, t in docs.items() if model.scores(np.array([quality.features(t)]))[0] >= quality.THRESHOLD}
    unique = near_duplicates(good)
    clean = clean_of(unique, items)
    assert len(docs) > len(good) > len(unique) > len(clean) > 0
    safe = generalised(clean)
    assert safe != clean
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = {}
    for d, t in safe.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d] = (ids, len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id: (r.token_ids, r.n_tokens, r.decoded_sha256) for r in rows} == want
    assert len(rows) == len(want)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == docs.columns


def test_pipeline_keeps_odd_rows(spark):
    """Rows without an id or a text pass the stages that have no reason to drop them."""
    rows = [(1, None, None, None, None), (None, "x y z", "en", "a", 5), (2, "call +1 555 555 5555 now", "en", "a", 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    unique = corpus_pipeline.keep_one_of_each(spark, docs, DATA)
    clean = corpus_pipeline.keep_clean(spark, unique, DATA)
    told = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.sanitise(spark, clean, DATA).collect()}
    assert told == {1: (None, None), None: ("x y z", 5), 2: ("call [PHONE] now", 16)}
    assert corpus_pipeline.encode(spark, clean, DATA).count() == 3


def test_telling_terms_by_brute_force(spark):
    """Terms beside entities that many documents share, some in copies, some common everywhere."""
    near = [(i, f"entry {'abcdef'[i % 6]}x{i} from Zebulon Quist at z@y.org today") for i in range(8)]
    copies = [(20 + i, "signed Marguerite w@y.org yesterday") for i in range(5)]
    far = [(40 + i, f"{'gh'[i % 2]}{i} call +1 555 555 5555 {'filler ' * 400} Ottoline{i % 2}") for i in range(6)]
    plain = [(100 + i, f"plain text from today number {i} about nothing") for i in range(80)] + [(200, "Quist and zebulon alone")]
    docs = dict([*near, *copies, *far, *plain])
    want = {d: sorted((a, b) for a, b, _ in s) for d, s in terms_by_document(docs).items()}
    got = {r.doc_id: sorted((s.start, s.end) for s in r.spans if s.kind == "term") for r in pii.find(spark.createDataFrame([*docs.items()], "doc_id long, text string")).collect()}
    assert {d: s for d, s in got.items() if s} == want
    assert 200 in want and 40 in want and not any(d in want for d, _ in copies)


def test_stages_with_clashing_columns(spark):
    """Columns named like a stage's own pass through all filtering stages."""
    names = ["score", "fp", "component_id", "spans", "n_words", "hit_starts", "item_ids", "terms", "entity", "id", "mark", "kind"]
    rows = [(i, f"document {i} says some words that no other one does {i * 7} times", "en", "a", 5, *(f"{c}{i}" for c in names)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert sorted(tuple(r[c] for c in names) for r in out.collect()) == sorted(r[5:] for r in rows)
