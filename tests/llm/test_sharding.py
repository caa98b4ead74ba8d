from collections import Counter

import pytest

from docflow.llm import sharding


def test_table_is_even_and_follows_preferences():
    slots = sharding.lookup_table()
    loads = Counter(slots)
    assert set(loads) == set(range(64)) and max(loads.values()) - min(loads.values()) <= 1


def test_removal_moves_few_other_keys():
    before = sharding.lookup_table()
    names = tuple(s for s in sharding.SHARDS if s != "shard-20")
    after = [names[i] for i in sharding.lookup_table(names)]
    kept = [(sharding.SHARDS[a], b) for a, b in zip(before, after) if sharding.SHARDS[a] != "shard-20"]
    assert sum(a != b for a, b in kept) / len(kept) < 0.1


def test_against_a_plain_fill():
    names, size = ("a", "b", "c"), 13
    orders = []
    for s in names:
        offset, skip = sharding._hash(s, "offset") % size, sharding._hash(s, "skip") % (size - 1) + 1
        orders.append([(offset + j * skip) % size for j in range(size)])
    slots = {}
    while len(slots) < size:
        for i, order in enumerate(orders):
            if len(slots) < size:
                slots[next(x for x in order if x not in slots)] = i
    assert [slots[i] for i in range(size)] == sharding.lookup_table(names, size)


@pytest.mark.parametrize(("names", "size"), [((), 7), (("a", "a"), 7), (("a", "b"), 8), (("a", "b", "c"), 2)])
def test_bad_tables(names, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, size)


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert len({r["shard"] for r in rows if r["doc_id"] == 4}) == 1
    assert sharding.shard_documents(no_docs).collect() == []
    loads = sharding.shard_loads(sharding.shard_documents(odd_docs)).collect()
    assert sum(r["n_rows"] for r in loads) == len(rows)
