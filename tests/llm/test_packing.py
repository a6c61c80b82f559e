import itertools
import random
from collections import Counter

from flowsieve.llm import packing


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


def test_bucket_ends_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randint(0, 12) for _ in range(rng.randint(1, 30))]
        cells = sorted(Counter(lengths).items())
        for buckets in (1, 2, 3, 5):
            ends = packing.bucket_ends([c for _, c in cells], [n * c for n, c in cells], [n for n, _ in cells], buckets)
            assert len(ends) <= buckets and ends[-1] == max(lengths)
            values = [n for n, _ in cells]
            best = min(
                padding(lengths, [*chosen, values[-1]])
                for r in range(min(buckets, len(values)))
                for chosen in itertools.combinations(values[:-1], r)
            )
            assert padding(lengths, ends) == best
    assert packing.bucket_ends([], [], [], 4) == []


def test_packs_every_document(spark):
    rng = random.Random(4)
    docs = [(i, " w\t" * rng.choice([0, 1, 5, 40, 300, 2000, 9000])) for i in range(400)]
    docs += [(None, None), (1, docs[1][1]), (7, "w " * 70_000), (None, "a")]
    df = spark.createDataFrame([(i, t, "b", 3) for i, t in docs], "doc_id long, text string, batch string, slot int")
    rows = packing.pack(df, buckets=5, batch_tokens=10_000).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=repr) == sorted(
        ((i, len((t or "").split())) for i, t in docs), key=repr
    )
    ends = {r.bucket: r.bucket_tokens for r in rows}
    for r in rows:
        assert r.n_tokens <= r.bucket_tokens and r.n_tokens > ends.get(r.bucket - 1, -1)
    batches = Counter((r.bucket, r.batch) for r in rows)
    for bucket, end in ends.items():
        held = max(10_000 // max(end, 1), 1)
        sizes = [n for (b, _), n in sorted(batches.items()) if b == bucket]
        assert all(n == held for n in sizes[:-1]) and sizes[-1] <= held
        slots = sorted((r.batch, r.slot) for r in rows if r.bucket == bucket)
        assert slots == [divmod(i, held) for i in range(len(slots))]


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
