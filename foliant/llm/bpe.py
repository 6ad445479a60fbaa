"""BPE encoding and decoding with a backtracking encoder.

A word's longest token matches come from one Aho-Corasick pass. The encoder walks over them and
keeps a token only if it is compatible with its left neighbour, that is, if merging by rank
would never join or cut across the two; else it takes the next shorter token, or steps back.
Each end position is given up at most once, so the work is linear in the word's length, and the
result is the one that merging by rank gives. Decoding reads a table of token strings by offset.

Texts with characters that Unicode got after version 3.2 are lower-cased and split into words by
the tokenizers library itself: its version of Unicode isn't Python's. Without it the import fails.

The vocabulary file is read by the driver and broadcast: its size doesn't depend on the data.
Null texts count as empty; an empty text has no tokens. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import texts

#: Words up to this length are remembered, and so many of them.
CACHED_CHARS, CACHED_WORDS = 48, 400_000

#: Words of the vocabularies this module reads; a fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Bytes of UTF-8 texts whose characters are all below U+0200; none of those is recent.
_BELOW_200 = bytes(range(0xC8))

_models: dict[str, BPE] = {}


def recent_characters() -> re.Pattern:
    """Code points that Unicode 3.2 doesn't know. Of the others all versions since then say the same."""
    ranges: list[list[int]] = []
    for i in range(0x221, 0x110000):
        if unicodedata.ucd_3_2_0.category(chr(i)) == "Cn":
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def _library_words() -> Callable[[str], list[str]]:
    """How the tokenizers library splits texts, by its own version of Unicode."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    lower = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    split = pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)
    return lambda text: [w for w, _ in split.pre_tokenize_str(lower.normalize_str(text))]


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


def check_supported(spec: dict) -> None:
    """Refuse a vocabulary file that asks for anything that this module doesn't do."""
    split, level = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec["model"]
    right = {
        "normalizer": steps in ([{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}], [{"type": "NFC"}, {"type": "Lowercase"}]),
        "pre_tokenizer": [{k: v for k, v in c.items() if k != "trim_offsets"} for c in cuts] == [split, level],
        "decoder": spec.get("decoder") is None and spec.get("post_processor") is None,
        "model": model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "added_tokens": not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if wrong := [k for k, ok in right.items() if not ok]:
        raise ValueError(f"this vocabulary's {', '.join(wrong)} can't be read")


class BPE:
    """A byte-level BPE vocabulary whose words end in a suffix (``</w>``)."""

    def __init__(self, data: bytes):
        import ahocorasick
        import regex

        spec = json.loads(data)
        check_supported(spec)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        end = {c: chr(0xF0000 + b) for b, c in enumerate(chars)} if self.suffix else {c: c for c in chars}
        self.byte_symbol = chars
        self.last_symbol = [end[c] for c in chars]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.rank = [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        symbols: dict[int, str] = {}
        for c in chars:
            if c in vocab:
                symbols[vocab[c]] = c
            if self.suffix and c + self.suffix in vocab:
                symbols[vocab[c + self.suffix]] = end[c]
        for r, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault((left, right), whole)
            if self.rank[whole] < 0:
                self.rank[whole], self.parts[whole] = r, (left, right)
                symbols[whole] = symbols[left] + symbols[right]
        self.ids = {s: i for i, s in symbols.items()}
        self.length = {i: len(s) for i, s in symbols.items()}
        self.matcher = ahocorasick.Automaton()
        for i, s in symbols.items():
            self.matcher.add_word(s, i)
        self.matcher.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for i, s in symbols.items():
            self.shorter[i] = next((self.ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids), None)
        # decoding: all token strings in one, and where each begins
        names = [""] * size
        for s, i in vocab.items():
            names[i] = s
        for t in spec["added_tokens"]:
            names[t["id"]] = t["content"]
        self.names = "".join(names)
        self.offsets = np.concatenate([[0], np.cumsum([len(n) for n in names])]).tolist()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.marks = tuple({t[:2] for t in self.special})
        self.words = regex.compile(WORDS)
        self.recent, self.library = recent_characters(), _library_words()
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
        self._ids = _Memo(lambda w: " ".join(map(str, self.encode_word(w))))
        self._decoded = _Memo(lambda w: self.decode(self.encode_word(w)))

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between two neighbouring tokens.

        Undo merges from the last one on; if at any time the symbols on both sides of the
        border form a pair that would have been merged earlier, the border can't have stayed.
        """
        rank, parts, pairs = self.rank, self.parts, self.pairs
        limit, limit_right = len(rank), False  # the rank of the merge undone last, and its side
        while True:
            joined = pairs.get((left, right))
            # on equal ranks the leftmost merge comes first
            if joined is not None and (rank[joined] < limit or rank[joined] == limit and limit_right):
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # the right one is merged first, so the left one's merge is undone first
                limit, limit_right, left = a, False, parts[left][1]
            else:
                limit, limit_right, right = b, True, parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        data = word.encode()
        s = "".join([*(self.byte_symbol[b] for b in data[:-1]), self.last_symbol[data[-1]]])
        n = len(s)
        whole = self.ids.get(s)
        if n == 1 and whole is not None:
            return [whole]
        longest: list[int | None] = [None] * n
        length = self.length
        for stop, i in self.matcher.iter(s):
            start = stop - length[i] + 1
            if longest[start] is None or length[longest[start]] < length[i]:
                longest[start] = i
        open_end = bytearray(b"\1") * (n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while token is not None:
            stop = at + length[token]
            if open_end[stop] and (not tokens or self.compatible(tokens[-1], token)):
                tokens.append(token)
                at = stop
                token = longest[at] if at < n else None
                continue
            token_shorter = self.shorter[token]
            if token_shorter is not None:
                token = token_shorter
                continue
            open_end[at] = 0
            if not tokens:
                break
            token = tokens.pop()
            at -= length[token]
        if at != n:
            raise ValueError("the vocabulary lacks a byte of this text")
        return tokens

    def pieces(self, text: str) -> Iterator[tuple[str, list[str]]]:
        """Special tokens and the words between them."""
        at = 0
        if any(m in text for m in self.marks):
            for m in self.split_special.finditer(text):
                yield "", self.split_words(text[at : m.start()])
                yield m[0], []
                at = m.end()
        yield "", self.split_words(text[at:] if at else text)

    def split_words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        if text.encode().translate(None, _BELOW_200) and self.recent.search(text):
            return self.library(text)
        text = unicodedata.normalize("NFC", text)
        # str.lower() looks at what surrounds a capital sigma; the tokenizer doesn't
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return self.words.findall(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for special, words in self.pieces(text):
            out += [self.special[special]] if special else [i for w in words for i in self.encode_word(w)]
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[self.offsets[i] : self.offsets[i + 1]] for i in ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, the ids as text, and the decoded text."""
        ids, decoded = [], []
        for special, words in self.pieces(text):
            if special:
                ids.append(str(self.special[special]))
                decoded.append(self.decode([self.special[special]]))
            elif words:
                ids.append(" ".join(map(self._ids.__getitem__, words)))
                decoded.append(" ".join(map(self._decoded.__getitem__, words)))
        line = " ".join(ids)
        return (line.count(" ") + 1 if line else 0), line, " ".join(decoded)


def model(data: bytes) -> BPE:
    """The vocabulary, built once in each Python worker."""
    key = hashlib.md5(data).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = BPE(data)
    return _models[key]


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: bytes, text: str = "text", into: str = "ids") -> DataFrame:
    """Add ``into``, the token ids of each text; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        bpe = model(shared.value)
        return pa.array([bpe.encode(t) for t in texts(column)], pa.list_(pa.int32()))

    return docs.withColumn(into, ids(text))


def decode(docs: DataFrame, vocabulary: bytes, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``, the text of each array of token ids; null arrays give an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        bpe = model(shared.value)
        return pa.array([bpe.decode(x or []) for x in column.to_pylist()], pa.string())

    return docs.withColumn(into, text(ids))


def digests(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; each text is encoded, and decoded from its ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(shared.value)
        for batch in batches:
            n, ids, decoded = [], [], []
            for value in batch.column(1):
                count, line, back = bpe.digest(value.as_py() or "")
                n.append(count)
                ids.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
