from collections import Counter

import pytest

from remitspark.llm import sharding


def test_table_is_full_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 1009)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.25 * 1009


def test_shards_must_fit():
    for bad in ([], ["a", "a"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 2)


def test_rows_go_where_the_table_says(messy, make, rows):
    import hashlib

    names = ["x", "y", "z"]
    table = sharding.lookup_table(names, 101)
    out = sharding.shard(messy, shards=names, slots=101).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _, _ in rows)
    for r in out:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"], r["shard_name"]) == (slot, table[slot], names[table[slot]])
    assert sharding.shard(make([])).count() == 0
