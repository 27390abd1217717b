import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing, token_files
from quire.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH, cached=50)


def plain(text, end):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_words_encode_as_whole_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, sizes = ENCODER.encode([t.encode() for t in texts], 1)
    want = [plain(t, 1) for t in texts]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("text", ["Don't'S it's,", "İ Σας ẞ ﬁ Å é ́x", "a<|endoftext|>B <|ENDOFTEXT|>", "naïve, ÉTÉ.", None, ""])
def test_odd_words(text):
    assert ENCODER.encode([text and text.encode()], 2)[0].tolist() == plain(text, 2)


@pytest.fixture(scope="module")
def rows(hard):
    return hard.select("doc_id", "text").collect()


def test_files_hold_all_documents(hard, rows):
    manifest = token_files.write_token_files(hard, PATH, length=64)
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens
        start += r.n_tokens
    want = sorted(np.array(plain(r.text, 1), "<u4").tobytes() for r in rows)
    assert sorted(bytes(r.ids) for r in got) == want


def test_sequences_are_equal_and_mapped(hard, rows):
    files = token_files.write_token_files(hard, PATH, length=64).collect()
    total = 0
    for f in files:
        reader = token_files.open_token_file(f.path)
        last = -(-f.n_ids // 64) - 1
        for i in range(last + 1):
            ids, mask = token_files.sequence(reader, i)
            assert len(ids) == len(mask) == 64 and (mask.all() or i == last)
            assert not ids.flags.owndata
            total += int(mask.sum())
    assert total == sum(len(plain(r.text, 1)) for r in rows)


def test_empty_table(empty):
    assert token_files.read_token_files(token_files.write_token_files(empty, PATH)).count() == 0
    assert packing.pack(empty, PATH).count() == 0


@pytest.mark.parametrize("size,windows", [(64, 2), (4096, 128)])
def test_pieces_cover_every_id_once(hard, rows, size, windows):
    got = packing.pack(hard.repartition(4), PATH, size=size, windows=windows, fan_in=2).collect()
    bags = sorted(np.array(plain(r.text, 2), "<u4").tobytes() for r in rows)
    by_doc, by_sequence = {}, {}
    for p in got:
        assert 0 < p.length and len(p.ids) == 4 * p.length
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sum(p.length for p in got) == sum(len(b) // 4 for b in bags)
    whole = np.array(plain(next(r.text for r in rows if r.doc_id == 7), 2), "<u4").tobytes()
    for p in got:
        if p.doc_id == 7:
            assert bytes(p.ids) == whole[4 * p.start : 4 * (p.start + p.length)]
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding < 0.05 * sum(p.length for p in got)


def test_cut_at_powers():
    pieces = [(1, 0, 3000, 3000, bytes(12000)), (2, 0, 3001, 3001, bytes(12004))]
    out = packing.cut_at_powers(pieces, 4096)
    lengths = [sum(p[2] for p in w) for w in out]
    assert lengths == [4096, 1024, 512, 256, 64, 32, 16, 1] and sum(lengths) == 6001
