"""BPE encoding by per-prefix dynamic programming, and decoding.

A byte-level BPE vocabulary whose ids follow merge order has, for every prefix of a text, one token that
its encoding ends in. Left to right, each prefix takes the longest vocabulary match that ends there and
whose pair with the last token of the prefix before it is compatible, that is, which encoding would not
merge or split otherwise; following the back-pointers from the whole text yields the exact ids. Matches
come from an automaton over the vocabulary with suffix links, compatibility from undoing merges along the
seam of two tokens.

Texts are first cut as the tokenizer cuts them: at its special token's string, and by its pre-tokenization
pattern. Pieces repeat, so each task keeps a memo of bounded size (``MEMO`` pieces, then it starts anew,
which changes speed only).

Cases: null counts as empty, an empty text has no ids and decodes to the empty text; special-token strings
inside texts give the special id, as the tokenizers library does by default; ties and repeated rows are
encoded alike; extra columns are carried by ``encode`` (one called ids is replaced); ids that do not form UTF-8 decode with U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from profilion.llm import textkit as tk
from profilion.llm.cluster import with_columns

#: Fixed value: the byte-level pre-tokenization pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 200_000
NEVER = 1 << 31


#: Below this code point the pattern's classes are written out, for the faster standard matcher.
NEAR = 0x250


def near_pattern() -> re.Pattern:
    """PATTERN for texts whose code points all lie below NEAR."""

    def of(kind: str) -> str:
        return "".join(f"\\u{c:04x}" for c in range(NEAR) if unicodedata.category(chr(c))[0] == kind)

    letters, numbers, space = of("L"), of("N"), r"\t-\r \x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the automaton of a byte-level BPE file in the tokenizers library's format."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        letters = byte_letters()
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in data["model"]["vocab"].items()}
        ids = {t: i for i, t in self.tokens.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int]] = {}
        rank: dict[int, int] = {}
        for k, merge in enumerate(data["model"]["merges"]):
            left, right = (bytes(letters[c] for c in part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
            pair, whole = (ids[left], ids[right]), ids[left + right]
            self.merged[pair] = whole
            self.made_of.setdefault(whole, pair)
            rank.setdefault(whole, k)
        #: The order in which merges apply; single bytes come before all merges.
        self.rank = {i: rank.get(i, -1) for i in self.tokens}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.far_pieces, self.near_pieces, self.far = regex.compile(PATTERN), near_pattern(), re.compile(rf"[^\x00-\u{NEAR - 1:04x}]")
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.automaton = ahocorasick.Automaton()
        for i, t in self.tokens.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        spelled = dict(self.tokens) | {i: s.encode() for s, i in self.special.items()}
        self.lengths = np.array([len(spelled.get(i, b"")) for i in range(max(spelled) + 1)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(max(spelled) + 1)), np.uint8)
        self.memo = _Memo(self)

    def pieces(self, text: str) -> list[str]:
        return (self.far_pieces if self.far.search(text) else self.near_pieces).findall(text)

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes gives just these two."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > MEMO:
                self.fits.clear()
            known = self.fits[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        """Goes back in time along the seam, from the latest merge that built either side, and looks for a
        merge across the seam that would have come first."""
        until = NEVER
        while True:
            across = self.merged.get((left, right))
            if across is not None and self.rank[across] < until:
                return False
            if self.rank[left] > self.rank[right]:
                # the left part was finished later: before that its right half stood at the seam
                until, left = self.rank[left], self.made_of[left][1]
            elif self.rank[right] >= 0:
                # equal ranks, or the right part later: what lies further left merges first
                until, right = self.rank[right] + 1, self.made_of[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        n, fits = len(piece), self.fits
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = end - length
                if before:
                    left = last[before]
                    if left < 0:
                        continue
                    known = fits.get(left << 32 | token)
                    if known or (known is None and self.compatible(left, token)):
                        last[end], size[end] = token, length
                elif self._is_whole(token):
                    last[end], size[end] = token, length
        out = []
        while n > 0:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def _is_whole(self, token: int) -> bool:
        """Whether a token's own bytes encode to it: the merges that build it are not overtaken."""
        parts = self.made_of.get(token)
        if parts is None:
            return True
        known = self.whole.get(token)
        if known is None:
            # undone, its halves must be whole, and their seam must hold up to the merge that joins them
            known = self.whole[token] = self._is_whole(parts[0]) and self._is_whole(parts[1]) and self._joins(*parts)
        return known

    def _joins(self, left: int, right: int) -> bool:
        own, until = self.rank[self.merged[left, right]], NEVER
        while True:
            across = self.merged.get((left, right))
            if across is not None and self.rank[across] < min(until, own):
                return False
            if self.rank[left] > self.rank[right]:
                until, left = self.rank[left], self.made_of[left][1]
            elif self.rank[right] >= 0:
                until, right = self.rank[right] + 1, self.made_of[right][0]
            else:
                return True

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        if self.specials is None or not self.specials.search(text):
            return b"".join(map(self.memo.__getitem__, self.pieces(text)))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += map(self.memo.__getitem__, self.pieces(text[at : m.start()]))
            out.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        return b"".join([*out, *map(self.memo.__getitem__, self.pieces(text[at:]))])

    def forget(self) -> None:
        """Empties the memos, so that a worker that goes on to other work does not hold them."""
        self.memo.clear()
        self.fits.clear()

    def decode(self, ids: bytes) -> str:
        ids = np.frombuffer(ids, "<u4")
        n = self.lengths[ids]
        spelled = self.letters[np.repeat(self.starts[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return spelled.tobytes().decode("utf-8", "replace")


class _Memo(dict):
    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(spec: str) -> Vocabulary:
    """One for each Python worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(spec)
    return _loaded[key]


def _texts(column: pa.Array) -> Iterator[str]:
    return ("" if x is None else x for x in column.to_pylist())


def _spec(docs: DataFrame, path: str):
    """The vocabulary file, read on the driver and broadcast: a few MB whatever the input is."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with a column ids (binary, little-endian unsigned 32-bit), encoded with the file at ``path``."""
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(spec.value)
        for b in batches:
            ids = pa.array([vocabulary.encode(t) for t in _texts(b.column(text))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])
        vocabulary.forget()

    docs = docs.drop("ids")
    return docs.mapInArrow(tk.tidy(run), with_columns(docs.schema, ids="binary"))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with a column decoded: the text of its ids, special tokens kept."""
    spec = _spec(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(spec.value)
        for b in batches:
            texts = pa.array([vocabulary.decode(x.as_py() or b"") for x in b.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(run, with_columns(encoded.schema, decoded="string"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; one pass, one row at a time."""
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(spec.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            for text in _texts(b.column("text")):
                ids = vocabulary.encode(text)
                rows.append((len(ids) // 4, sha(ids), sha(vocabulary.decode(ids).encode())))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        vocabulary.forget()

    return docs.select("doc_id", "text").mapInArrow(tk.tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
