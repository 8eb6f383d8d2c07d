"""What the tokenizers work out once: their tables before they are sent, a word wherever it stands."""

import gc

import numpy as np
import pytest
from tokenizers import Tokenizer

from attrmill.llm import bpe, token_files
from attrmill.llm.catalog import tokenizer_path

ODD = [
    "\n", "a\nb", "x́\ny  z", "<|endoftext|>\n<|endoftext|>a", "ẛ̣̇a\ṅb", "ΟΔΟΣ\nΑΣ Σ", "don't\r\n'LL \t é",
    "히\nᆨ 한ᄀ\nᅡ", "日本\n語 テスト", " a\x85b\x1cc d", "İstanbul\nŞ ǅ", "e\ńx ̸\n̸=", "one.\n\n\ntwo\n", "'s\n'S s'",
]


def test_bpe_words_across_line_breaks():
    path = tokenizer_path("word_bpe_49k.json")
    encoder = bpe.Encoder(bpe.Vocabulary(path))
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert encoder.digest(text) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
    encoder.chunks.clear()
    encoder.digest("first word\nsecond word\nthird word")
    assert sorted(encoder.chunks) == ["first", "second", "third", "word"]  # before, a stretch for every pair around a break


def test_bpe_tables_are_complete_before_they_are_sent():
    vocabulary = bpe.Vocabulary(tokenizer_path("word_bpe_49k.json"))
    vocabulary.border = None  # an encoder checks no token's own text again
    assert bpe.Encoder(vocabulary).word("a")


def test_kept_memos_are_out_of_collections():
    """Every task ends with a collection; the memos that a worker keeps are not visited by it."""
    token_files._encoder.cache_clear()
    try:
        encoder = token_files._encoder(open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read())
        assert encoder.encode("some words") == encoder._library("some words")
        seen = {id(x) for x in gc.get_objects()}
        assert id(encoder.memo) not in seen and id(encoder.pieces) not in seen
    finally:
        gc.unfreeze()


@pytest.mark.parametrize("limit", [1, 5, 1_000_000])
def test_runs_are_packed_like_documents(monkeypatch, limit):
    monkeypatch.setattr(token_files, "RUN_IDS", limit)
    rng = np.random.default_rng(4)
    for counts in ([], [0], [0, 0], [3, 0, 5, 0], [0, 4, 1, 9], list(rng.integers(0, 12, 50))):
        docs = [(rng.integers(0, 1 << 32, n, np.uint32) >> rng.integers(0, 32, n)).astype(np.uint32) for n in counts]
        counts = np.array(counts, np.int64)
        blocks = [x for s, e in token_files.runs(counts) for x in token_files.pack_all(np.concatenate(docs[s:e]), counts[s:e])]
        assert blocks == [token_files.pack(d) for d in docs]
        places = np.cumsum([0] + [len(x) for x in blocks])[:-1] if blocks else counts
        raw = np.frombuffer(b"".join(blocks) + b"\0" * 4, np.uint8)
        back = [token_files.unpack_all(raw, places[s:e], counts[s:e]) for s, e in token_files.runs(counts)]
        assert [x for part in back for x in part] == [x for d in docs for x in d]
