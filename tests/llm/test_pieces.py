import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from linkweave.llm import pieces


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.table(path), sentencepiece.SentencePieceProcessor(model_file=path)


def agree(both, text):
    ours, library = both
    ids, n, back = ours.both(text)
    want = library.encode(text)
    assert (ids, n, back) == (",".join(map(str, want)), len(want), library.decode(want)), repr(text)


def test_random_strings(both):
    rng = random.Random(4)
    letters = list("aeionrst  the  ▁\n\t<>é漢\x00🙂� s/") + ["tion", "▁the", "ing"]
    for _ in range(4000):
        agree(both, "".join(rng.choice(letters) for _ in range(rng.randint(0, 25))))
    known = both[0].pieces[259:]
    for _ in range(2000):
        agree(both, "".join(rng.choice(known) for _ in range(rng.randint(0, 8))))


@pytest.mark.parametrize("text", ["", " ", "   ", "<s>", "</s> a", "<0x41>", "a  b ", "▁", "▁▁ a", "<unk>", "a\x00b", "x" * 5000, "🙂" * 300])
def test_special_strings(both, text):
    agree(both, text)


def test_words_come_back_after_their_generation(both, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 3)
    for _ in range(3):
        agree(both, "one two three four five six seven one two")


def test_odd_documents(both, odd, odd_rows, none):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc, text in odd_rows:
        ids = both[1].encode(text or "")
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(both[1].decode(ids))))
    assert sorted(map(tuple, pieces.encode_decode(odd).collect()), key=repr) == sorted(want, key=repr)
    assert pieces.encode_decode(none).count() == 0
