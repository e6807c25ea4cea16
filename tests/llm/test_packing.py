import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from odd import documents
from vigila.llm import packing as P
from vigila.llm.queries import packed


@pytest.mark.parametrize("hist", [
    {}, {1: 5}, {600: 1001}, {1023: 7, 1: 3}, {700: 10**6, 3: 5, 513: 17}, {n: 1 for n in range(1, 1024)},
    {n: random.Random(4).randrange(0, 9) for n in range(1, 1024)}])
def test_plan_covers_all_and_pads_one_window(hist):
    rows = P.plan_windows(hist)
    if sum(hist.values()) > 10_000:
        return
    pieces, windows = defaultdict(list), defaultdict(list)
    for n, low, high, cut, size, w, first, each, at in rows:
        for r in range(low, high):
            i = first + r - low
            pieces[n, r].append((cut, size))
            windows[w + i // each].append((at + i % each * size, size))
    assert set(pieces) == {(n, r) for n, c in hist.items() for r in range(c)}
    for (n, _), got in pieces.items():
        assert [c for c, _ in sorted(got)] == [sum(s for _, s in sorted(got)[:i]) for i in range(len(got))]
        assert sum(s for _, s in got) == n
    sums = []
    for got in windows.values():
        at = 0
        for o, s in sorted(got):
            assert o == at
            at += s
        sums.append(at)
    assert all(s <= 1024 for s in sums) and sum(s < 1024 for s in sums) <= 1


def test_closest_fill_is_closest():
    rnd = random.Random(9)
    for _ in range(60):
        counts = {rnd.randrange(1, 30): rnd.randrange(1, 4) for _ in range(5)}
        room = rnd.randrange(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = P.closest_fill(counts, room)
        assert all(c <= counts[n] for n, c in got.items())
        assert sum(n * c for n, c in got.items()) == max(s for s in sums if s <= room)


def test_words_encode_like_whole_texts():
    whole = Tokenizer.from_file(P.vocabulary("byte_bpe_50k.json"))
    texts = ["", " ", "  a  b ", "a <|endoftext|> b<|endoftext|>c  <|endoftext|>\n", "\n\n x\ty\r\n z", "a　 b  c",
             "it's 'll  don't 12 3 ..  !! \x1c x", " lead", "trail ", "a \n b", "é  b  😀 😀", "x" * 5000,
             "", "!!", "a!! b", "don't. it's, we'll! 'tis", "x² ½ ªº µ·¸", "ÀÿĀɏ ɐ привет, 漢字。 ١٢٣ ①", "a\u00adb c\u00a0d \u200b"]
    rnd = random.Random(2)
    texts += ["".join(rnd.choice("ab1.,' \n\té") for _ in range(60)) for _ in range(300)]
    got = P.WordTokenizer(P.vocabulary("byte_bpe_50k.json"), P.vocabulary("byte_bpe_50k.tiktoken"))(texts)
    assert got == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_pieces_of_odd_rows(spark):
    docs = documents(spark)
    got = packed(docs).collect()
    whole = Tokenizer.from_file(P.vocabulary("byte_bpe_50k.json"))
    want = defaultdict(int)
    ids = {}
    for r in docs.collect():
        want[r.doc_id] += 1
        ids.setdefault(r.doc_id, []).append(whole.encode(r.text or "", add_special_tokens=False).ids + [0])
    total = defaultdict(int)
    seq = defaultdict(list)
    for r in got:
        total[r.doc_id] += r.length
        seq[r.sequence_id].append((r.offset, r.length))
        sums = {zlib.crc32(np.array(i[r.start:r.start + r.length], "<u4").tobytes())
                for i in ids[r.doc_id] if len(i) == r.doc_tokens}
        assert r.ids_crc32 in sums
    assert total == {k: sum(map(len, v)) for k, v in ids.items()}
    pad = 0
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
        pad += 1024 - at
    assert pad < 1024
    assert packed(docs.limit(0)).count() == 0
