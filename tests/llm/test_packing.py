import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from remitspark.llm import packing, tokens

PATH = packing.tokenizer_path()
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_as_the_tokenizer_gives_them(messy, rows):
    expected = Counter()
    for i, t, _ in rows:
        ids = ids_of(t)
        for p, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            expected[(i, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = Counter(tuple(r) for r in packing.pieces(messy).collect())
    assert got == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB .,'s\n\t<|>endoftx1é\u0301\u00a0क\u093c"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_word_by_word_is_the_same(texts):
    ids, bounds = tokens.token_ids(pa.array(texts, pa.string()), PATH, 1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids_of(t) for t in texts]


def fits(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_gapless_and_tight(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, int(n)) for i, n in enumerate(np.minimum(rng.lognormal(4, 1, 3000).astype(int) + 1, 500))]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    out = packing.pack(cut, capacity=500).collect()
    assert Counter((r["doc_id"], r["length"]) for r in out) == Counter((i, n) for i, _, n in rows)
    assert fits(out, 500) <= 1.01 * sum(r[2] for r in rows) / 500 + 2


@pytest.mark.parametrize("sizes", [[500] * 7, [251] * 9, [1], [167] * 10 + [166] * 10 + [500], [300, 200] * 40])
def test_configurations_hold_every_piece(sizes):
    out = packing.configurations(dict(Counter(sizes)), 500)
    held = Counter()
    for times, content in out:
        assert times > 0 and sum(n * c for n, c in content) <= 500
        for n, c in content:
            held[n] += times * c
    assert held == Counter(sizes)
    assert sum(t for t, _ in out) <= -(-sum(sizes) // 500) + (5 if 251 in sizes else 1)


def test_repeated_rows_empty_table_and_whole_documents(make, messy):
    assert packing.pack_documents(make([])).count() == 0
    out = packing.pack_documents(messy).collect()
    fits(out, 4096)
    assert sum(r["doc_id"] == 11 for r in out) == 2
    with_ids = packing.pieces(messy, with_ids=True).filter("doc_id = 12").orderBy("piece").collect()
    assert [x for r in with_ids for x in r["ids"]] == ids_of(messy.filter("doc_id = 12").first()["text"])
