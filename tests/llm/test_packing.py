import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from semtag.llm.packing import Packer, WordTokenizer, pack_documents

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts(plain, rows):
    texts = [t for _, t, *_ in rows if t] + ["<|endoftext|> it's \x01 Á  x", "\x01", " \x01\x01 b"]
    for got, text in zip(WordTokenizer(PATH, remembered=200)([t.encode() for t in texts]), texts, strict=True):
        assert got.tolist() == plain(text)


@pytest.mark.parametrize("width", [64, 2048])
def test_every_id_in_one_piece(docs, rows, plain, width):
    got = pack_documents(docs, PATH, width=width, windows=4, fan_in=2).collect()
    want = sorted(zlib.crc32(np.array([*plain(t), 1], "<u4").tobytes()) for _, t, *_ in rows)
    assert sum(x["length"] for x in got) == sum(len(plain(t)) + 1 for _, t, *_ in rows)
    by_doc, by_sequence = {}, {}
    for x in got:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_sequence.setdefault(x["sequence_id"], []).append(x)
    whole = {d: [*plain(t), 1] for d, t, *_ in rows}
    for d, pieces in by_doc.items():
        for x in pieces:
            part = whole[d][x["start"] : x["start"] + x["length"]]
            assert x["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and x["doc_tokens"] == len(whole[d])
    fills = []
    for pieces in by_sequence.values():
        pieces.sort(key=lambda x: x["offset"])
        assert [x["offset"] for x in pieces] == np.cumsum([0, *(x["length"] for x in pieces)])[:-1].tolist()
        fills.append(sum(x["length"] for x in pieces))
    assert max(fills) <= width and sum(f < width - 16 for f in fills) <= 1
    assert len(want) == len(rows)


def test_empty_table(nothing):
    assert pack_documents(nothing, PATH).count() == 0


def test_open_windows_are_bounded():
    p = Packer(100, 3, 4, 0)
    r = np.random.default_rng(0)
    for i in range(200):
        p.place(i, 0, np.arange(int(r.integers(1, 250)), dtype="<u4"), 1)
        assert len(p.open) <= 3


def test_tokenizers_that_read_across_words_encode_whole_texts(rows):
    other = WordTokenizer(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert not other.by_word
    texts = [t for _, t, *_ in rows][:30] + ["don't  stop.\n\nnow"]
    for text, ids in zip(texts, other([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == other.encode(text).tolist()


def test_words_fall_out_of_memory_and_come_back():
    tokenizer = WordTokenizer(PATH, remembered=20)
    assert tokenizer.by_word
    texts = [f"word{i % 7}, same. Łódź! it's {i},%%% 'tis a-b. ..." for i in range(400)]
    for text, ids in zip(texts, tokenizer([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == tokenizer.encode(text).tolist()
    assert len(tokenizer.known) < 700
