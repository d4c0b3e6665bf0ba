import random
import zlib
from collections import Counter, defaultdict

from docpipe.llm.common import with_rank
from docpipe.llm.packing import configurations, pack, pack_documents, places, plan
from docpipe.llm.sharding import ROW_OVERHEAD, schedule, shard_documents


def lengths(n, seed, top=2048):
    rng = random.Random(seed)
    return Counter(min(top, max(1, int(rng.lognormvariate(6.5, 1.1)))) for _ in range(n))


def test_plan_is_whole_and_close_to_the_bound():
    for n, most in ((0, 0), (1, 1), (50, 1.1), (3000, 1.02)):
        counts = lengths(n, n)
        runs = plan(dict(counts))
        used = Counter()
        for r in runs:
            assert r.used == sum(r.lengths) <= 2048 and r.n > 0
            for x in r.lengths:
                used[x] += r.n
        assert used == counts
        bound = -(-sum(x * c for x, c in counts.items()) // 2048)
        assert sum(r.n for r in runs) <= most * bound


def test_plan_of_hard_cases():
    assert sum(r.n for r in plan({2048: 10, 1024: 4, 1: 2048})) == 13
    assert sum(r.n for r in plan({1025: 7})) == 7
    assert sum(r.n for r in plan({5: 3, 6: 3}, capacity=11)) == 3


def test_configurations_reach_the_optimum():
    found = configurations([6, 4, 3], [10, 10, 10], 10)
    assert abs(sum(x for _, x in found) - 13) < 0.35
    assert all(sum(c * s for c, s in zip(p, (6, 4, 3), strict=True)) <= 10 for p, _ in found)


def test_places_number_every_slot():
    runs = plan(dict(lengths(500, 4)))
    at = places(runs)
    assert len(set(at["key"].tolist())) == len(at["key"]) and (at["key"][1:] > at["key"][:-1]).all()


def check_packed(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    return len(by)


def test_pack_documents(odd, none):
    rows = pack_documents(odd).collect()
    n = check_packed(rows)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1
    assert len({(r.doc_id, r.piece) for r in rows}) >= odd.select("doc_id").distinct().count()
    assert pack_documents(none).count() == 0


def test_pack_with_one_hot_length(spark):
    df = spark.range(2000).selectExpr("id doc_id", "0 piece", "CASE WHEN id % 3 = 0 THEN id % 2048 + 1 ELSE 700 END length")
    rows = pack(df).collect()
    assert len(rows) == 2000
    check_packed(rows)


def test_rank_is_gapless(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN id % 7 ELSE 99 END g")
    by = defaultdict(list)
    for r in with_rank(df, "g", ["id"], "rank", 3000).collect():
        by[r.g].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 3000


def test_schedule_is_longest_first():
    rng = random.Random(1)
    items = [(rng.randint(1, 1000), f"i{k}") for k in range(300)]
    load, expected = [0] * 5, {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        s = min(range(5), key=lambda k: (load[k], k))
        load[s] += size
        expected[name] = s
    assert schedule(items, 5) == expected
    assert schedule([], 5) == {}


def test_shards(odd, none, documents):
    rows = shard_documents(odd, shards=4).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    shard_of = {}
    for r in rows:
        text = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(text) + ROW_OVERHEAD, zlib.crc32(text))
        assert shard_of.setdefault(text, r.shard) == r.shard
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shard_documents(none).count() == 0
    rng = random.Random(2)
    many = shard_documents(documents(["z" * rng.randint(0, 3000) + str(i) for i in range(1500)]), shards=4, pieces=100).collect()
    load = Counter()
    for r in many:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 2 * sum(load.values()) / 400
