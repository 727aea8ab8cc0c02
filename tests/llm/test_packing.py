import random
import zlib

import numpy as np
import pytest

from postlake.llm.packing import Capacity, _Encoder, best_fit, merge_ranks, pack_documents, sequences, slots
from postlake.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_odd_rows(make_docs, odd_rows, tokenizer):
    rows = [*odd_rows, (50, "a<|endoftext|>b"), (51, " two  spaces \n x\n\n y \t z "), (52, "it's\xa0we'll 12 345　b")]
    out = pack_documents(make_docs(rows), tokenizer_path(), with_ids=True).collect()
    pieces = {}
    for r in out:
        pieces.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(r)
    count = 0
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start, piece = 0, 0
        while start < len(ids):
            length = (len(ids) - 1) % 1024 + 1 if not piece else 1024
            part = ids[start : start + length]
            held = pieces[i, piece, start, length, zlib.crc32(part.tobytes())]
            assert all(r.ids == part.tolist() for r in held)
            start, piece, count = start + length, piece + 1, count + 1
    assert count == len(out)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= 1024
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
    total = sum(r.length for r in out)
    assert len(by_sequence) <= 1.06 * -(-total // 1024) + 1


def test_ids_are_those_of_the_tokenizer(tokenizer):
    """Blanks and signs of many scripts, in every neighbourhood; a run that the faster library gives up on; a special token."""
    encoder, draw = _Encoder(tokenizer_path()), random.Random(1)
    assert encoder.fast is not None
    pool = [chr(c) for c in [*range(0x250), *range(0x300, 0x370), *range(0x2000, 0x2070), *range(0x1F600, 0x1F640), 0x3000, 0xFEFF, 0x660, 0x2160]]
    texts = ["".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(4000)]
    texts += [f"a {chr(c)} b{chr(c)}1{chr(c)}{chr(c)} " for c in range(0, 0x30000, 11) if not 0xD800 <= c < 0xE000]
    texts += ["", "a<|endoftext|>b", " " * 300_000, "é1" * 20_000, "don'T WE'LL it's"]
    for text, data in zip(texts, encoder.encode(texts), strict=True):
        assert data == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text[:80])


def test_other_tokenizers_run_by_themselves(tmp_path):
    """What is no plain byte-level vocabulary in order of its merges is left to the tokenizer."""
    import json

    from postlake.llm.queries import tokenizer_path as path

    assert merge_ranks(path("word_bpe_49k.json")) is None and _Encoder(path("word_bpe_49k.json")).fast is None
    spec = json.load(open(path(), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | change))
        assert merge_ranks(str(other)) is None
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    other.write_text(json.dumps(spec))
    assert merge_ranks(str(other)) is None


def test_sequences(make_docs):
    docs = make_docs([(1, "some text"), (2, "more"), (3, None)])
    packed = pack_documents(docs, tokenizer_path(), with_ids=True)
    rows = sequences(packed).collect()
    assert len(rows) == 1 and sorted(rows[0].doc_ids) == [1, 2, 3] and rows[0].ids.count(2) == 3


def test_empty(make_docs):
    assert pack_documents(make_docs([]), tokenizer_path()).count() == 0


@pytest.mark.parametrize("select", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [Capacity(100), Capacity(100, documents=3), Capacity(100, cost=5200), Capacity(100, 4, 6000)])
def test_best_fit_holds_every_capacity(capacity, select):
    draw = random.Random(3)
    counts = {draw.randrange(1, 71): draw.randrange(1, 400) for _ in range(50)}
    packing = best_fit(counts, capacity, select=select)
    most = capacity.vector()
    seen = {}
    for content, number in packing:
        need = sum(np.array([n, 1, n * n]) * k for n, k in content)
        assert (need <= most).all()
        for n, k in content:
            seen[n] = seen.get(n, 0) + k * number
    assert seen == counts
    table = slots(packing)
    for n in counts:
        own = table[table[:, 0] == n]
        assert own[0, 1] == 0 and (np.diff(own[:, 1]) > 0).all()


def test_best_fit_is_tight():
    assert sum(n for _, n in best_fit({60: 10, 40: 10, 100: 3}, Capacity(100))) == 13
    with pytest.raises(ValueError, match="exceeds"):
        best_fit({50: 1}, Capacity(100, cost=1000))
