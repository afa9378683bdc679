"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one token that its BPE encoding ends with. The candidates are the tokens
that are suffixes of the prefix, found by an automaton of the vocabulary; a candidate is right if the prefix before it ends
with a token that may stand beside it, which looks only at the two tokens' own merge trees. Back-pointers give the ids.

Null and empty texts have no ids and decode to the empty text. Whole texts are encoded, however long; what a worker remembers
is bounded within them, too. Repeated rows are encoded alike; an empty table gives an empty one; other columns pass through,
those of the result's names are replaced.
"""

from __future__ import annotations

import json
import re
from hashlib import sha256
from itertools import accumulate, chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymap.llm.arrow import with_python
from quarrymap.session import table

#: The pre-token pattern of byte-level BPE, fixed by the vocabulary file's kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens and words whose ids a worker remembers, in an older and a newer half; the older goes when the newer is full.
REMEMBERED = 350_000
#: Longer pre-tokens are not remembered.
LONGEST_REMEMBERED = 64


def byte_characters() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class _Words(dict):
    """The ids of words that follow a space; found when first asked for, in the words of ``before`` or by encoding."""

    def __init__(self, vocabulary: Vocabulary, before: _Words | None = None):
        self.vocabulary = vocabulary
        self.before = {} if before is None else before

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.before.get(word)
        if ids is None:
            text = " " + word
            if word.isascii() and word.isalpha() or len(pieces := self.vocabulary.pieces.findall(text)) == 1:
                ids = self.vocabulary.encode_piece(text.encode())
            else:
                ids = self.vocabulary.encode_part(text, pieces)
        if len(word) <= LONGEST_REMEMBERED and len(self) < self.vocabulary.remembered:
            self[word] = ids
        return ids


class Decoder:
    """The bytes of the tokens of one byte-level BPE file."""

    def __init__(self, data: dict):
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        self.tokens: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) for t, i in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.tokens |= {i: content.encode() for content, i in self.special.items()}

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids or ())).decode("utf-8", "replace")


class Vocabulary(Decoder):
    """With merge trees and the suffix automaton, which encoding needs as well."""

    def __init__(self, data: dict, remembered: int = REMEMBERED):
        import ahocorasick

        super().__init__(data)
        self.remembered = remembered
        model = data["model"]
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            whole = ids[left + right]
            self.rank[ids[left], ids[right]] = rank
            if whole not in self.parts:
                self.parts[whole], self.made_at[whole] = (ids[left], ids[right]), rank
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.loose = re.compile(r"\s(?: |(?<= )\s)")
        self.beside: list[dict[int, bool]] = []
        self.automaton = ahocorasick.Automaton()
        for i in ids.values():
            b = self.tokens[i]
            self.beside.append({})
            self.automaton.add_word(b.decode("latin-1"), (len(b), i, self.beside[-1]))
        self.automaton.make_automaton()
        self.anything = dict.fromkeys(ids.values(), True)
        self.known: dict[str, tuple[int, ...]] = {}
        self.words = _Words(self)

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two adjacent tokens comes before the merges that made them.

        Undoing the later of the two tokens' last merges, step by step, shows every pair that ever met at the border with
        the rank at which one of the two was merged on; a merge of that pair with a lower rank would have come first.
        """
        rank, made_at, parts = self.rank, self.made_at, self.parts
        until, ties_go_left = len(rank), False
        while True:
            found = rank.get((left, right))
            if found is not None and (found < until or found == until and ties_go_left):
                return False
            a, b = made_at.get(left, -1), made_at.get(right, -1)
            if a < 0 and b < 0:
                return True
            # At one rank merges run from left to right, so a merge inside the left token comes before one at the border.
            if a > b:
                until, ties_go_left, left = a, False, parts[left][1]
            else:
                until, ties_go_left, right = b, True, parts[right][0]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        n = len(piece)
        #: For the prefix that ends at each byte: what may stand after its last token, as far as it is known; that match.
        #: The element at -1 belongs to the empty prefix, after which every token may stand.
        after: list[dict[int, bool]] = [{}] * n + [self.anything]
        last: list[tuple[int, int, dict[int, bool]] | None] = [None] * n
        for at, match in self.automaton.iter(piece.decode("latin-1")):
            if last[at] is not None:
                continue
            length, token, beside = match
            row = after[at - length]
            fits = row.get(token)
            if fits is None:
                fits = row[token] = self.compatible(last[at - length][1], token)
            if fits:
                last[at], after[at] = match, beside
        ids = []
        at = n - 1
        while at >= 0:
            length, token, _ = last[at]
            ids.append(token)
            at -= length
        ids.reverse()
        return tuple(ids)

    def encode_part(self, text: str, pieces: list[str] | None = None) -> tuple[int, ...]:
        """The ids of text without special tokens, by its pre-tokens."""
        known, words, out = self.known, self.words, []
        for piece in pieces or self.pieces.findall(text):
            if piece[0] == " " and piece[1:].isalpha():
                out += words[piece[1:]]
                continue
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= LONGEST_REMEMBERED and len(known) < self.remembered:
                    known[piece] = ids
            out += ids
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; strings of special tokens become their ids."""
        if not text:
            return []
        if len(self.known) + len(self.words) > self.remembered // 2:
            self.known.clear()
            self.words.before = {}
            self.words = _Words(self, self.words)
            if sum(map(len, self.beside)) > self.remembered:
                for row in self.beside:
                    row.clear()
        out: list[int] = []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append(self.special[part])
            elif not part:
                continue
            elif part[0] == " " or part[-1].isspace() or self.loose.search(part):
                out += self.encode_part(part)
            else:
                # A space between two characters that are none always begins a pre-token, so words can be taken one by one.
                first, *words = part.split(" ")
                out += self.encode_part(first)
                out += chain.from_iterable(map(self.words.__getitem__, words))
        return out


_loaded: dict[tuple, Decoder] = {}


def _vocabulary(content, kind: type, *options):
    """The worker's one vocabulary of that kind."""
    text, digest = content.value
    if (kind, digest, *options) not in _loaded:
        _loaded.clear()
        _loaded[kind, digest, *options] = kind(json.loads(text), *options)
    return _loaded[kind, digest, *options]


def _content(df: DataFrame, path: str | None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:  # one vocabulary file of fixed size, on the driver
        text = file.read()
    return df.sparkSession.sparkContext.broadcast((text, sha256(text.encode()).hexdigest()))


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """``df`` with the array of token ids of the column ``text``."""
    content = _content(df, path)

    def run(texts):
        one = _vocabulary(content, Vocabulary).encode
        return [[one(t) for t in texts]]

    return with_python(df, run, [text], [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])


def decode(df: DataFrame, ids: str = "token_ids", text: str = "decoded_text", path: str | None = None) -> DataFrame:
    """``df`` with the text of the array of token ids ``ids``."""
    content = _content(df, path)

    def run(rows):
        one, flat = _vocabulary(content, Decoder).decode, rows.flatten().to_numpy(zero_copy_only=False).tolist()
        # Lengths rather than offsets: those of a slice begin anywhere, and a null has no length.
        ends = list(accumulate(n or 0 for n in rows.value_lengths().to_pylist()))
        return [[one(flat[a:b]) for a, b in zip([0, *ends], ends)]]

    return with_python(df, run, [ids], [T.StructField(text, T.StringType())], arrow=True)


def round_trip(df: DataFrame, text: str = "text", ids: str = "token_ids", decoded: str = "decoded_text", path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """``df`` without the text, with its token ids and the text that they decode to: ``encode`` and ``decode`` by one worker.

    ``remembered``: words whose ids a worker keeps; fewer take less memory and more time, and give the same ids.
    """
    content = _content(df, path)

    def run(texts):
        vocabulary = _vocabulary(content, Vocabulary, remembered)
        made = [vocabulary.encode(t) for t in texts]
        return [made, [vocabulary.decode(i) for i in made]]

    outputs = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())]
    return with_python(df, run, [text], outputs, drop=[text])


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded documents."""
    joined = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return df.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded_text", 256).alias("decoded_sha256"))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 50k byte-level vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(round_trip(docs))


