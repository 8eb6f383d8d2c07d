"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that ends the prefix's BPE
encoding. It is stored per prefix: an automaton over the vocabulary (each state
a suffix, with failure links) lists the tokens that end at a position; of these
the one is kept whose predecessor, the stored last token of the rest of the
prefix, is compatible with it. Following the back-pointers from the full word
gives the ids. Two neighbouring tokens are compatible if no merge across their
border would have come before the merges that built them.

Normalisation, word splitting and special tokens follow the vocabulary file
(NFC, white space, lower case; words; byte alphabet; end-of-word mark on the last
symbol). Stretches between spaces are independent of each other and memoised;
those with characters beyond the Latin blocks are normalised and split by the
tokenizers library, so that its Unicode tables hold. The file's path is a parameter; it is read by the
driver and its tables are broadcast (bounded by the vocabulary).

Rows: null texts are empty (no ids; digests of the empty string). Rows are
independent of each other; columns other than the id and the text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from attrmill.llm.common import Memo, arrow_stage


#: Up to here letters are composed, and lower case and classes are the same in all Unicode versions.
BEYOND = re.compile("[^\0-\u024f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tables of one vocabulary file with an end-of-word mark."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # normaliser and word splitter alone, for text outside the Latin blocks
        self.frame = json.dumps(spec | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []})
        self.mark = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.built: dict[int, int] = {}  # token -> rank of the merge that makes it
        for r, (x, y) in enumerate(merges):
            pair, whole = (self.ids[x], self.ids[y]), self.ids[x + y]
            self.rank.setdefault(pair, r)
            if whole not in self.parts:
                self.parts[whole], self.built[whole] = pair, r
        self.spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self._known: dict[int, bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = split["pattern"]["Regex"]
        for i in self.parts:  # known before the tables are sent
            self.whole(i)

    def whole(self, i: int) -> bool:
        """Whether BPE of the token's own text gives the token."""
        if i not in self._known:
            x, y = self.parts.get(i, (i, i))
            self._known[i] = i not in self.parts or self.whole(x) and self.whole(y) and self.border(x, y, self.built[i])
        return self._known[i]

    def spine(self, i: int, right: bool) -> list[tuple[int, float]]:
        """Tokens along the right (left) edge of a token's merge tree, the token first, each
        with the rank of the merge that consumes it (infinite for the token itself)."""
        out = self.spines.get((i, right))
        if out is None:
            out, at, gone = [], i, float("inf")
            while True:
                out.append((at, gone))
                if at not in self.parts:
                    break
                gone = self.built[at]
                at = self.parts[at][1 if right else 0]
            self.spines[i, right] = out
        return out

    def border(self, left: int, right: int, limit: float) -> bool:
        """No merge across the border comes before rank ``limit`` and before both of its
        sides are consumed. At equal rank the merge further left comes first."""
        for x, x_gone in self.spine(left, True):
            for y, y_gone in self.spine(right, False):
                r = self.rank.get((x, y))
                if r is not None and r < limit and r < x_gone and r <= y_gone:
                    return False
        return True


class Encoder:
    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.by_byte = dict(enumerate(byte_alphabet()))
        self.text_of = {i: t for t, i in v.ids.items()}
        self.text_of |= {i: t for t, i in v.special.items()}
        self.split = regex.compile(v.words)
        library = Tokenizer.from_str(v.frame)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.specials = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        self.fits = Memo(self._fits, 300_000)
        #: of every token: its id as text, and its own text, each with a space before it
        self.rows_of = {i: (f" {i}", " " + t) for i, t in self.text_of.items()}
        self.words = Memo(self._word_row, 400_000)
        self.chunks = Memo(self._chunk_row, 500_000)
        # the end mark is one symbol for the automaton
        self.end = "￿"
        self.automaton = ahocorasick.Automaton()
        for t, i in v.ids.items():
            marked = v.mark and t.endswith(v.mark) and t != v.mark
            if (i in v.parts or len(t) - (len(v.mark) if marked else 0) == 1) and v.whole(i):
                word = t[: -len(v.mark)] + self.end if marked else t
                self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()

    def _fits(self, pair: tuple[int, int]) -> bool:
        return self.v.border(*pair, float("inf"))

    def word(self, symbols: str) -> list[int]:
        """Ids of one word in the byte alphabet."""
        if not symbols:
            return []
        n = len(symbols)
        # last[k], size_of[k]: the token that ends the encoding up to symbol k, and its length; what
        # comes before symbol 0 is the last entry (index -1). The end mark is one more symbol, and no
        # token ends between it and the symbol that has it
        last: list[int | None] = [None] * n + [-1]
        if self.v.mark:
            last[-1:], n, symbols = [None, -1], n + 1, symbols + self.end
            last[n - 2] = -2
        size_of = [0] * n
        fits = self.fits
        for at, (token, size) in self.automaton.iter(symbols):
            if last[at] is None:
                before = last[at - size]
                if before is not None and (before < 0 or fits[before, token]):
                    last[at], size_of[at] = token, size
        out, at = [], n - 1
        while at >= 0:
            if last[at] is None:
                raise ValueError(f"the vocabulary cannot encode {symbols!r}")
            out.append(last[at])
            at -= size_of[at]
        return out[::-1]

    def _row(self, ids: list[int]) -> tuple[str, str]:
        if len(ids) == 1:
            return self.rows_of[ids[0]]
        names, tokens = zip(*map(self.rows_of.__getitem__, ids)) if ids else ((), ())
        return "".join(names), "".join(tokens)

    def _word_row(self, word: str) -> tuple[str, str]:
        return self._row(self.word(word.encode().decode("latin-1").translate(self.by_byte)))

    def _chunk_row(self, chunk: str) -> tuple[str, str]:
        """Of a stretch between spaces: its ids, and its tokens, each with a space before it."""
        if chunk.isascii() or not BEYOND.search(chunk):  # in normal form already
            words = self.split.findall(chunk.lower())
            if len(words) == 1:
                return self.words[words[0]]
            names, tokens = zip(*map(self.words.__getitem__, words)) if words else ((), ())
            return "".join(names), "".join(tokens)
        spans = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(chunk))
        return self._row([i for symbols, _ in spans for i in self.word(symbols)])

    def rows(self, text: str) -> list[tuple[str, str]]:
        """Rows as of _chunk_row for the stretches of a text, in order."""
        out = []
        for k, piece in enumerate(self.specials.split(text) if self.specials and "<|" in text else [text]):
            if k % 2:
                out.append((f" {self.v.special[piece]}", " " + piece))
            else:
                piece = piece if BEYOND.search(piece) else piece.lower()
                out += map(self.chunks.__getitem__, piece.replace("\n", " ").split(" "))
        return out

    def digest(self, text: str) -> tuple[str, str]:
        """The ids as text, and the decoded text."""
        ids, tokens = zip(*self.rows(text))
        return "".join(ids)[1:], "".join(tokens)[1:]

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.digest(text)[0].split()))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.text_of[i] for i in ids)


def _digest(batches, vocabulary):
    encoder = Encoder(vocabulary.value)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for b in batches:
        out = []
        for text in b.column(1).to_pylist():
            ids, tokens = encoder.digest(text) if text else ("", "")
            out.append((ids.count(" ") + 1 if ids else 0, sha(ids), sha(tokens)))
        n, ids, back = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_stage(docs.select("doc_id", "text"), functools.partial(_digest, vocabulary=sent), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(batches, vocabulary):
    encoder = Encoder(vocabulary.value)
    for b in batches:
        ids = [encoder.encode(t) if t else [] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_stage(docs.select("doc_id", "text"), functools.partial(_ids, vocabulary=sent), f"doc_id {kind}, n_tokens long, ids array<int>")
