"""BPE encoding by backtracking, and decoding from an offset table.

A word's encoding is found left to right: take the longest token that an Aho-Corasick automaton of the vocabulary found
at the place, unless it isn't compatible with the token before it; then the next shorter token there, and, when none is
left, the place is marked dead and the token before it gives way. Two tokens are compatible if merging their joined
symbols by rank gives just these two; a sequence whose neighbours are all compatible is what the merges would give. The
table of compatible pairs is filled as pairs turn up. Places once dead are not tried again, so a word takes linear time.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, kept_in_worker, table

#: Entries that a task keeps of words and of pairs before it starts anew.
CACHED = 400_000
#: Unicode's White_Space, which the tokenizer drops.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The letters and digits that Unicode 16, which the tokenizer goes by, has beyond Unicode 15.1.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
DIGITS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
SUFFIX = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself, or the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


def members(kind: str, more: tuple[tuple[int, int], ...]) -> np.ndarray:
    """For each character whether its category begins with kind or it is in more."""
    inside = np.fromiter((unicodedata.category(chr(c))[0] == kind for c in range(0x110000)), bool, 0x110000)
    for first, last in more:
        inside[first : last + 1] = True
    return inside


def ranges_of(inside: np.ndarray) -> str:
    """The same as the ranges of a regular expression's class."""
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


def vocabulary_file(path: str | None) -> dict:
    """The vocabulary as the tokenizers library stores it; None: the public one of words with ends."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return json.load(f)


class BacktrackingBPE:
    """The tokenizer of a vocabulary file of words with ends (lower case, white space dropped)."""

    def __init__(self, path: str | None = None):
        import ahocorasick
        import regex
        from tokenizers import normalizers

        file = vocabulary_file(path)
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: Beyond the Latin letters, composing, lower-casing and letters follow Unicode versions of their own. The second
        #: pattern always holds; the first is the fast one for texts of characters that both take for the same.
        self.beyond_latin = regex.compile("[\u0300-\U0010ffff]")
        classes, every = (members("L", LETTERS_16), members("N", DIGITS_16)), "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        differ = np.zeros(0x110000, bool)
        for name, inside in zip("LN", classes, strict=True):
            held = np.zeros(0x110000, bool)
            held[[ord(c) for c in regex.findall(f"\\p{{{name}}}", every)]] = True
            differ |= held ^ inside
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^" + SPACE + "{0}{1}]+"
        self.words, self.words_always = (regex.compile(pattern.format(*c)) for c in (("\\p{L}", "\\p{N}"), map(ranges_of, classes)))
        self.disputed = regex.compile(f"[{ranges_of(differ)}]") if differ.any() else None
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]

        def plain(token):
            """A token over 512 symbols: bytes, and bytes that end a word."""
            ends = token.endswith(SUFFIX)
            out = "".join(chr(byte_of[c]) for c in (token[: -len(SUFFIX)] if ends else token))
            return out[:-1] + chr(256 + ord(out[-1])) if ends else out

        self.ids = {plain(t): i for t, i in vocab.items() if t not in self.special and t != SUFFIX}
        self.ranks = {tuple(map(plain, m if isinstance(m, list) else m.split(" "))): r for r, m in enumerate(merges)}
        self.automaton = ahocorasick.Automaton()
        for token in self.ids:
            self.automaton.add_word(token, len(token))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple[list, list]] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.prefixes: dict[str, int] = {}
        self.known: dict[str, list[int]] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging of a few symbols by rank: what compatibility means."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            pair = symbols[at], symbols[at + 1]
            out, i = [], 0
            while i < len(symbols):  # all places of the pair, left to right
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def grown(self, token: str) -> tuple[list, list]:
        """How a token is merged: its right and left edges, from the token inwards, as (part, rank that takes it up).

        Both are empty for a token that merging its own symbols doesn't give.
        """
        found = self.edges.get(token)
        if found is None:
            found = [], []
            if len(token) == 1 or self.merged(list(token)) == [token]:
                for side, edge in ((1, found[0]), (0, found[1])):
                    part, rank = token, 1 << 60
                    while True:
                        edge.append((part, rank))
                        if len(part) == 1:
                            break
                        halves = self.last_pair(part)
                        part, rank = halves[side], self.ranks[halves]
            self.edges[token] = found
        return found

    def last_pair(self, token: str) -> tuple[str, str]:
        """The two parts whose merge completes a token."""
        found = self.halves.get(token)
        if found is None:
            symbols = list(token)
            while len(symbols) > 2:
                rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            self.halves[token] = found = (symbols[0], symbols[1])
        return found

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging gives the tokens a and b side by side.

        It does unless a part on a's right edge and one on b's left edge merge before either is taken up; with equal
        ranks, the merge further left comes first.
        """
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHED:
                self.pairs.clear()
            right, left = self.grown(a)[0], self.grown(b)[1]
            found = bool(right and left)
            for x, x_taken in right:
                for y, y_taken in left:
                    rank = self.ranks.get((x, y))
                    if rank is not None and rank < x_taken and rank <= y_taken:
                        found = False
            self.pairs[a, b] = found
        return found

    def next_shorter(self, token: str) -> int:
        """The length of the longest token that is a proper prefix of a token, or 0."""
        found = self.prefixes.get(token)
        if found is None:
            found = next((n for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), 0)
            self.prefixes[token] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word of the pattern."""
        data = word.encode()
        text = data[:-1].decode("latin-1") + chr(256 + data[-1])
        size = len(text)
        longest = [0] * size
        for end, length in self.automaton.iter(text):  # ascending ends: the last at a place is its longest
            longest[end - length + 1] = length
        if longest[0] == size and self.grown(text)[0]:
            return [self.ids[text]]
        pairs, dead, path = self.pairs, bytearray(size + 1), []
        at, length, before = 0, longest[0], ""
        while at < size:
            while length:
                token = text[at : at + length]
                if not dead[at + length]:
                    fits = pairs.get((before, token)) if before else bool(self.grown(token)[0])
                    if fits or fits is None and self.compatible(before, token):
                        break
                length = self.next_shorter(token)
            if length:
                path.append(token)
                at += length
                before = token
                length = longest[at] if at < size else 0
                continue
            dead[at] = 1
            if not path:  # no sequence of tokens spells the word
                return [self.ids[s] for s in self.merged(list(text)) if s in self.ids]
            token = path.pop()
            at -= len(token)
            before = path[-1] if path else ""
            length = self.next_shorter(token)
        return [self.ids[t] for t in path]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.split_special.split(text) if self.split_special and "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            words = self.words
            if self.beyond_latin.search(part):
                part = self.normalizer.normalize_str(part)
                if self.disputed and self.disputed.search(part):
                    words = self.words_always
            else:
                part = part.lower()
            for word in words.findall(part):
                ids = self.known.get(word)
                if ids is None:
                    if len(self.known) >= CACHED:
                        self.known.clear()
                    self.known[word] = ids = self.encode_word(word)
                out += ids
        return out


class OffsetTable:
    """All tokens of a vocabulary file, each followed by a space, in one string, and where each begins."""

    def __init__(self, path: str | None = None):
        file = vocabulary_file(path)
        names = {i: t for t, i in file["model"]["vocab"].items()} | {x["id"]: x["content"] for x in file["added_tokens"]}
        texts = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.offsets = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        self.blob = np.frombuffer(b" ".join(texts) + b" ", np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens of ids, joined by one space, gathered from the offset table."""
        if not len(ids):
            return b""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        stop = np.cumsum(size)
        return self.blob[np.arange(stop[-1]) + np.repeat(start - stop + size, size)][:-1].tobytes()


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, ids (array of int), as the tokenizers library gives them.

    path: the vocabulary file; None: the public one. Null and empty texts have no ids; special tokens' strings in a
    text are these tokens. Whole texts are encoded, repeated rows alike; ids may be null. Other columns are ignored.
    """

    def run(batches):
        bpe = kept_in_worker(f"bpe {path}", lambda: BacktrackingBPE(path))
        for batch in batches:
            doc, text = batch.column("doc_id"), batch.column("text")
            begin, values, held = 0, [], 0

            def flush(stop):
                offsets = pa.array(np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32))
                flat = pa.array(np.concatenate(values) if values else np.empty(0, np.int32), pa.int32())
                return pa.RecordBatch.from_arrays([doc.slice(begin, stop - begin), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"])

            for i in range(batch.num_rows):
                values.append(np.array(bpe.encode(text[i].as_py() or ""), np.int32))
                held += len(values[-1])
                if held > 1_000_000:
                    yield flush(i + 1)
                    begin, values, held = i + 1, [], 0
            if values:
                yield flush(batch.num_rows)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(doc_id, ids) with decoded: the tokens joined by one space, special ones too; null ids decode to ''."""

    def run(batches):
        tokens = kept_in_worker(f"tokens {path}", lambda: OffsetTable(path))
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = [tokens.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid and len(x.values) else b"" for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded string")


def op3_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    out = bpe_decode(bpe_encode(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
