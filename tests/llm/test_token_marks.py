import random

import numpy as np
from tokenizers import Tokenizer

from loamgrid.llm.tokens import PieceEncoder, default_vocabulary

WORDS = ["foo", "x", "é", "7", "²", "½", "x'", "it's", "_", "é", "字", "ⅷ", "-", "(foo", "[1", "a/b/", '"said', "a_", "😀", "x's"]


def test_runs_of_marks_as_by_the_library():
    library = Tokenizer.from_file(default_vocabulary())
    texts = [" foo).", 'he said". it"), [1]. x\'. a/b/. (b)], "c"],', "foo)!?\n(bar).\nend].", "a <|endoftext|> b", "a<|endoftext|>.", "<|endoftext|>"]
    rng = random.Random(4)
    for _ in range(400):
        texts.append(" ".join(rng.choice(WORDS) + "".join(rng.choices(")]}\"'>/-_", k=rng.randint(0, 2))) + "".join(rng.choices(".,;:!?%&*#$|", k=rng.randint(0, 3))) for _ in range(12)))
    got = PieceEncoder(default_vocabulary()).encode(texts)
    for t, g, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert np.array_equal(g, want.ids), t


class Counted:
    """The library's tokenizer; counts the texts that it is given."""

    def __init__(self, inner):
        self.inner, self.given = inner, 0

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, texts, **more):
        self.given += len(texts)
        return self.inner.encode_batch_fast(texts, **more)


def test_new_pieces_go_to_the_library_together():
    rng = random.Random(11)
    letters = "abcdefgéüñĠĊłß日本'’-_0123456789.,😀\x00\x7f\u200b\u0301"
    texts = ["".join(rng.choice(letters) if rng.random() < 0.8 else rng.choice(" \n") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    texts = [t for t in texts if not any(x in t for x in ("  ", "\n\n", " \n", "\n "))] + [" a", "a ", "\na", "a\n", " ", "\n", "", "'s 's\n's it's", "Ġ Ċ\nĊ Ġ", " ".join(f"w{i}x{i * 7}" for i in range(3000))]
    e = PieceEncoder(default_vocabulary())
    library, e.tokenizer = e.tokenizer, Counted(e.tokenizer)
    got = e.encode(texts) + e.encode(texts)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)] * 2
    assert [x.tolist() for x in got] == want
    assert len(e.index) > 3000 and e.tokenizer.given < 20


def test_an_added_token_across_two_pieces(tmp_path):
    e = PieceEncoder(default_vocabulary())
    e.tokenizer.add_tokens(["qq ww", "qq\nww"])
    e.tokenizer.save(path := str(tmp_path / "more.json"))
    e = PieceEncoder(path)
    texts = ["aa qq\nqq", "ww xx\nww", "bb qq ww", "qq\nww"]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
