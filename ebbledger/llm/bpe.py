"""Byte-pair encoding and decoding over a prefix trie.

The distinct pre-tokens of a batch make a trie of bytes. A depth-first walk
keeps, for every depth of the current path, the last token of the encoding of
that prefix; the encoding of a prefix is the encoding of what stands before its
last token, and that token. So a prefix that many words share is encoded once,
and a word's tokens are read off by walking back from its end.

The last token of a prefix is the one vocabulary entry that ends there, encodes
to itself, and whose boundary to the last token before it no merge would cross
(`Merges.stable`).

Null and empty texts have no tokens and decode to the empty text. Rows stay one
to one, repeated rows included; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from ebbledger.llm.common import text_rows

_old = [chr(c) for c in range(0x558)]
_letter = "".join(c for c in _old if unicodedata.category(c)[0] == "L")
_number = "".join(c for c in _old if unicodedata.category(c)[0] == "N")
_space = "\t\n\v\f\r \x85\xa0"
#: Up to here every version of Unicode in use agrees on what a letter is.
OLD = re.compile(r"[\x00-\u0557]*\Z")
#: Fixed, as published with the vocabulary: contractions; letters, numbers or other signs after at most one space; space.
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_letter}]+| ?[{_number}]+| ?[^{_space}{_letter}{_number}]+|[{_space}]+(?![^{_space}])|[{_space}]+")
#: Between these, a single space always begins a pre-token.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the space.
BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]
#: Pieces of text a worker remembers between batches; at this many it starts anew.
REMEMBERED = 200_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of the vocabulary file for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary(file: str) -> tuple[dict, dict[bytes, int], dict[str, int], dict[int, bytes]]:
    """What a tokenizer file says, its ids by bytes, its special tokens, and the bytes of all ids."""
    with open(file, encoding="utf-8") as f:
        told = json.load(f)
    letters = byte_letters()
    ids = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items()}
    special = {x["content"]: x["id"] for x in told["added_tokens"]}
    return told, ids, special, {i: b for b, i in ids.items()} | {i: s.encode() for s, i in special.items()}


def odd(text: str) -> bool:
    """Whether some space of a text is not a single one between two other characters."""
    beside = (c for c in BLANKS if c in text)
    return text[0] == " " or text[-1] == " " or "  " in text or any(" " + c in text or c + " " in text for c in beside)


class Merges:
    """Vocabulary and merge order of a byte-level tokenizer file."""

    def __init__(self, file: str):
        told, self.ids, self.special, self.text = vocabulary(file)
        vocab = told["model"]["vocab"]
        self.size = {token: len(b) for token, b in self.text.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(told["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.pairs[a, b] = rank, made
            self.parts.setdefault(made, (a, b, rank))
        #: Every beginning of a token is a state: what of the text so far can still become one.
        self.begins = [b"", *dict.fromkeys(token[:n] for token in self.ids for n in range(1, len(token) + 1))]
        self.states = {begin: i for i, begin in enumerate(self.begins)}
        self.moves: dict[int, tuple[int, tuple]] = {}
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.begins)
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.apart: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def move(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The longest end of the text so far, with one more byte, that begins a token; and the tokens that can end there."""
        seen = self.begins[state] + bytes([byte])
        to = next(self.states[seen[n:]] for n in range(len(seen) + 1) if seen[n:] in self.states)
        if self.ends[to] is None:
            seen = self.begins[to]
            suffixes = ((len(seen) - n, self.ids.get(seen[n:])) for n in range(len(seen)))
            self.ends[to] = tuple((n, token) for n, token in suffixes if token is not None and self.whole(token))
        self.moves[state << 8 | byte] = made = to, self.ends[to]
        return made

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge while the token grows, with the rank of the merge that made each."""
        known = self._spines.get((token, side))
        if known is None:
            known, at = [], token
            while at in self.parts:
                known.append((at, self.parts[at][2]))
                at = self.parts[at][side]
            known.append((at, -1))
            known.reverse()
            self._spines[token, side] = known
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay apart: no merge across their boundary comes first.

        Both edges grow in the order of their ranks; two edge tokens that exist at
        the same time merge if their rank is due before either grows on. At equal
        ranks the pair further left goes first.
        """
        left, right = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        known = True
        while True:
            grows_left = left[i + 1][1] if i + 1 < len(left) else len(self.pairs)
            grows_right = right[j + 1][1] if j + 1 < len(right) else len(self.pairs)
            due = self.pairs.get((left[i][0], right[j][0]))
            if due and due[0] < grows_left and due[0] <= grows_right:
                known = False
                break
            if grows_left == grows_right == len(self.pairs):
                break
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1
        if len(self.apart) > 500_000:
            self.apart.clear()
        self.apart[a << 32 | b] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to the token."""
        known = self._whole.get(token)
        if known is None:
            ids = [self.ids[bytes([b])] for b in self.text[token]]
            while len(ids) > 1:
                due = min(((self.pairs[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pairs), default=None)
                if due is None:
                    break
                i = due[1]
                ids[i : i + 2] = [self.pairs[ids[i], ids[i + 1]][1]]
            known = self._whole[token] = ids == [token]
        return known


class Encoder:
    """Encodes texts with a merge table; remembers pieces of text between calls, up to a bound."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.marks = re.compile("(" + "|".join(map(re.escape, merges.special)) + ")") if merges.special else None

    def words_of(self, piece: str, old: bool) -> list[str]:
        """The pre-tokens of a text. Letters newer than the pattern's classes are left to the tokenizer's own splitter."""
        if old or OLD.match(piece):
            return [piece] if piece.lstrip(" ").isalpha() and piece[:2] != "  " else SPLIT.findall(piece)
        return [piece[a:b] for _, (a, b) in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(piece)]

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """The encodings of distinct words, by one depth-first walk through their trie.

        Sorted, the words are the trie's leaves in depth-first order: from one word
        to the next, the walk goes up to their common prefix, whose states stay,
        and down the rest. last[d] is the last token of the first d bytes, states[d]
        says which tokens can end there. Ids are 32-bit numbers in a row.
        """
        merges, moves, apart, size = self.merges, self.merges.moves, self.merges.apart, self.merges.size
        found, path, last, states = {}, b"", [-1], [0]
        for word in sorted(w.encode() for w in words):
            depth, most = 0, min(len(path), len(word))
            while depth < most and path[depth] == word[depth]:
                depth += 1
            del last[depth + 1 :], states[depth + 1 :]
            state = states[depth]
            for byte in word[depth:]:
                depth += 1
                state, ends = moves.get(state << 8 | byte) or merges.move(state, byte)
                states.append(state)
                for length, token in ends:
                    if length == depth:
                        break
                    fits = apart.get(last[depth - length] << 32 | token)
                    if fits or (fits is None and merges.stable(last[depth - length], token)):
                        break
                last.append(token)
            path, tokens, at = word, [], len(word)
            while at:
                tokens.append(last[at])
                at -= size[last[at]]
            found[word.decode()] = array("i", tokens[::-1]).tobytes()
        return found

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as 32-bit numbers in a row; the words that are new in a call share one trie.

        A single space between two other characters always begins a pre-token, so
        texts are cut there first and whole pieces are looked up.
        """
        cut: list[list[tuple[str, list[str]]]] = []
        for text in texts:
            parts = [] if not text else self.marks.split(text) if self.marks and self.marks.search(text) else [text]
            cut.append([])
            for part in parts:
                if part:
                    head, *rest = [part] if part in self.merges.special else BETWEEN.split(part) if odd(part) else part.split(" ")
                    cut[-1].append((head, rest))
        if len(self.first) + len(self.later) > REMEMBERED:
            self.first, self.later = {}, {}
        for mark, token in self.merges.special.items():
            self.first[mark] = array("i", [token]).tobytes()
        old = all(OLD.match(text) for text in texts if text)
        heads = {x: self.words_of(x, old) for x in {head for parts in cut for head, _ in parts} - self.first.keys()}
        rests = {x: self.words_of(" " + x, old) for x in set(chain.from_iterable(rest for parts in cut for _, rest in parts)) - self.later.keys()}
        words = self.learn(set(chain.from_iterable(heads.values())) | set(chain.from_iterable(rests.values())))
        for known, new in ((self.first, heads), (self.later, rests)):
            for piece, parts in new.items():
                known[piece] = b"".join([words[w] for w in parts])
        first, later = self.first, self.later.__getitem__
        return [b"".join([x for head, rest in parts for x in (first[head], *map(later, rest))]) for parts in cut]


_open: dict[str, Encoder] = {}


def opened(file: str) -> Encoder:
    """The encoder of this worker process for a file."""
    if file not in _open:
        _open[file] = Encoder(Merges(file))
    return _open[file]


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `most` bytes of a column, so that memory does not follow the batch."""
    size, begin = batch.column(column).nbytes, 0
    rows = max(1, batch.num_rows * most // max(1, size))
    while begin < batch.num_rows:
        yield batch.slice(begin, rows)
        begin += rows


IDS, TEXTS = "doc_id long, ids array<int>", "doc_id long, ids array<int>, text string"


def _encoded(piece: pa.RecordBatch, file: str) -> pa.RecordBatch:
    ids = opened(file).batch(piece.column("text").to_pylist())
    at = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), np.int32)))
    return pa.RecordBatch.from_arrays([piece.column("doc_id"), lists], ["doc_id", "ids"])


class Decoder:
    """The bytes of all ids in a row, and where each begins."""

    def __init__(self, file: str):
        table = vocabulary(file)[3]
        known = [table.get(i, b"") for i in range(max(table) + 1)]
        self.size = np.array([len(x) for x in known])
        self.begin, self.letters = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(known), np.uint8)

    def decoded(self, piece: pa.RecordBatch) -> pa.RecordBatch:
        lists = piece.column("ids")
        ids, n = lists.flatten().to_numpy(), np.array(lists.value_lengths())
        size = self.size[ids]
        ends = np.cumsum(size)
        made = self.letters[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[ids] - ends + size, size)].tobytes()
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))]
        texts = [made[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])


def encode(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, ids: the token ids of every whole text, as its tokenizer file has them."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                yield _encoded(piece, file)

    return text_rows(docs).withColumns({"doc_id": F.col("doc_id").cast("long")}).mapInArrow(run, IDS)


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """doc_id, ids, text: the ids turned back into text; bytes that are not UTF-8 become U+FFFD."""

    def run(batches):
        decoder = Decoder(file)
        for batch in batches:
            for piece in slices(batch, "ids"):
                yield decoder.decoded(piece)

    return encoded.select("doc_id", "ids").mapInArrow(run, TEXTS)


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """decode(encode(docs)), both in one process of a task: the ids do not travel in between."""

    def run(batches):
        decoder = Decoder(file)
        for batch in batches:
            for piece in slices(batch, "text"):
                yield decoder.decoded(_encoded(piece, file))

    return text_rows(docs).withColumns({"doc_id": F.col("doc_id").cast("long")}).mapInArrow(run, TEXTS)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decoded documents."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
