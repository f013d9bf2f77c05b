import random
import zlib
from collections import defaultdict

import numpy as np
from cases import documents

from panelspark.llm import shard
from panelspark.llm.common import read
from panelspark.llm.queries import op1_sharding


def check(rows, shards):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert set(by_shard) <= set(range(shards))
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))


def test_differencing_places_every_part():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1000, 200)
    parts = np.zeros((200, 4), np.int64)
    parts[:, 0] = sizes
    sums, final = shard.difference(list(parts))
    held = [int(sizes[final[:, 0] == s].sum()) for s in range(4)]
    assert held == sums.tolist()
    assert max(held) - min(held) <= 5


def test_edge_cases(spark):
    docs = documents(spark)
    rows = shard.shard_rows(docs, shards=4).collect()
    assert len(rows) == docs.count()
    check(rows, 4)
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in rows}
    assert (4, 16, 0) in sizes and (5, 16, 0) in sizes
    assert all(r.text_crc32 == zlib.crc32(b"one") for r in rows if r.doc_id == 8)


def test_empty(spark):
    assert shard.shard_rows(documents(spark, [])).count() == 0


def test_groups_stay_whole_and_bytes_are_even(spark):
    random.seed(5)
    texts = [f"{k} " + "x" * random.randrange(3000) for k in range(3000)]
    rows = [(k, texts[k % 3000]) for k in range(3600)] + [(9000 + k, "copied " * 20) for k in range(300)]
    found = shard.shard_rows(documents(spark, rows, extra=False), shards=8, bucket=200, fan=4).collect()
    check(found, 8)
    held, homes = defaultdict(int), defaultdict(set)
    text_of = dict(rows)
    for r in found:
        held[r.shard] += r.size
        homes[text_of[r.doc_id]].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    assert max(held.values()) - min(held.values()) < 0.001 * sum(held.values()) / 8


def test_a_group_with_a_third_of_all_bytes_is_cut(spark):
    rows = [(k, "same text " * 30) for k in range(1000)] + [(5000 + k, f"{k} " * 60) for k in range(2000)]
    found = shard.shard_rows(documents(spark, rows, extra=False), shards=8, chunk_rows=50).collect()
    check(found, 8)
    held = defaultdict(int)
    for r in found:
        held[r.shard] += r.size
    assert max(held.values()) - min(held.values()) < 0.05 * sum(held.values()) / 8


def test_query_over_the_whole_table(spark, sf_dir):
    """Every column of the registered query against the texts themselves."""
    texts = defaultdict(list)
    for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect():
        texts[r.doc_id].append((r.text or "").encode())
    rows = op1_sharding(spark, sf_dir).collect()
    assert len(rows) == sum(map(len, texts.values()))
    wanted = sorted((i, len(t) + 16, zlib.crc32(t)) for i, held in texts.items() for t in held)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == wanted
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    check(rows, 40)
    held = defaultdict(int)
    for r in rows:
        held[r.shard] += r["size"]
    assert len(held) == 40
    # as even as placing the largest group first on the least full shard, which is done here by hand
    groups = defaultdict(int)
    for own in texts.values():
        for t in own:
            groups[t] += len(t) + 16
    plain = [0] * 40
    for size in sorted(groups.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    assert max(held.values()) - min(held.values()) <= max(max(plain) - min(plain), 64)
    # equal texts stay together, unless a group is larger than a shard's share
    of = defaultdict(set)
    for r in rows:
        of[r.text_crc32, r["size"]].add(r.shard)
    share = sum(groups.values()) / 40
    sizes = {(zlib.crc32(t), len(t) + 16): n for t, n in groups.items()}
    assert all(len(s) == 1 for k, s in of.items() if sizes[k] <= share)
