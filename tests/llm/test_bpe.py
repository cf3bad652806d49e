import random

from tallyspark.llm import bpe as B
from tests.llm.cases import ROWS, documents, empty

ODD = [
    "", "a", "<|endoftext|>x <|endoftext|>", "  a  b\n\n c\t\t", " x\xa0y", "é" * 50, "😀😀 👩‍👩‍👧", "a" * 3000, "'s 't 'RE don't I'll", "日本語テキスト", "\x00\x01\x85 a", "１２３ ½ ²", "aa" * 20 + " " * 50 + "b", "İ ſ",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.default_path())


def test_ids_and_text_equal_the_library():
    t, b, rng = library(), B.load(B.default_path()), random.Random(1)
    texts = ODD + [r[1] or "" for r in ROWS] + ["".join(rng.choice("ab \n.'sé日😀<|endoftext|>​0Ⅷ") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert B.unpack(b.encode(x)) == ids
        assert b.decode(ids) == t.decode(ids, skip_special_tokens=False) == x
        some = [rng.randrange(50_300) for _ in range(6)]
        assert b.decode(some) == t.decode(some, skip_special_tokens=False)


def test_merging_equals_scanning_for_the_least_rank():
    b, rng = B.load(B.default_path()), random.Random(2)
    for _ in range(300):
        ids = [b.start[x] for x in "".join(rng.choice("etaoin srhld") for _ in range(rng.randrange(0, 40))).encode()]
        slow = list(ids)
        while True:
            found = [(b.merges[p][0], i) for i, p in enumerate(zip(slow, slow[1:])) if p in b.merges]
            if not found:
                break
            _, i = min(found)
            slow[i : i + 2] = [b.merges[slow[i], slow[i + 1]][1]]
        assert b.merge(list(ids)) == slow


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(B, "CACHE_PIECES", 3)
    b, t = B.Bpe(B.default_path()), library()
    text = " ".join(f"w{i % 11} again" for i in range(200))
    assert B.unpack(b.encode(text)) == t.encode(text, add_special_tokens=False).ids
    assert len(b.kept) <= 3 and len(b.older) <= 3


def test_frames(spark):
    docs = documents(spark, clash=True)
    out = B.decode(B.encode(docs)).collect()
    assert [r.decoded for r in out] == [r[1] or "" for r in ROWS]
    digests = B.digests(docs).collect()
    assert [r.n_tokens for r in digests] == [len(r.token_ids) for r in out]
    assert B.digests(empty(spark)).count() == 0
