import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flowsieve.llm import alignment

TOKENIZERS = alignment.load(alignment.FOLDER)


def tokens(text):
    """(ids, byte ranges) by each tokenizer; None where bytes differ from space and text."""
    a = TOKENIZERS.a.encode(" " + text, add_special_tokens=False).ids
    b = TOKENIZERS.b.encode(text)
    out = []
    for ids, held in ((a, TOKENIZERS.a_bytes), (b, TOKENIZERS.b_bytes)):
        if b"".join(held[i] for i in ids) != (" " + text).encode():
            return None
        ends = np.cumsum([len(held[i]) for i in ids]).tolist()
        out.append((ids, list(zip([0, *ends], ends))))
    return out


def brute(docs):
    found, counts = [], Counter()
    for doc_id, text in docs:
        both = tokens(text) if text else None
        links, groups = [], []
        if both:
            (a, at_a), (b, at_b) = both
            i = j = 0
            # Every pair of tokens, compared range by range.
            for x, (f, t) in zip(a, at_a):
                links += [(x, y) for y, (g, u) in zip(b, at_b) if f < u and g < t]
            for end in sorted({t for _, t in at_a} & {t for _, t in at_b}):
                n = sum(t <= end for _, t in at_a)
                m = sum(t <= end for _, t in at_b)
                groups.append(",".join(map(str, a[i:n])) + "|" + ",".join(map(str, b[j:m])))
                i, j = n, m
        counts.update(links)
        found.append((doc_id, both, links, ";".join(groups), len(groups)))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return sorted(
        (
            (
                d, len(both[0][0]) if both else 0, len(both[1][0]) if both else 0, n_groups, len(links),
                sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links),
                hashlib.sha256(groups.encode()).hexdigest() if both else "",
            )
            for d, both, links, groups, n_groups in found
        ),
        key=repr,
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def run(spark, docs, **options):
    df = spark.createDataFrame([(i, t, 7, "x", 1) for i, t in docs], "doc_id long, text string, n long, pair string, chunk int")
    rows = alignment.counted_links(df, **options).collect()
    return sorted([tuple(r[c] for c in COLUMNS) for r in rows], key=repr)


def documents():
    rng = random.Random(3)
    words = ["tokenization", "naïve", "Straße", "日本語", "x", "don't", "3.14159", "antidisestablishment", "\n", "  ", "\t", "é", " ", "🙂"]
    special = ["<|endoftext|>", "</s>", "<s>", "<unk>", "<0x41>", "a<s>b", "▁", "a▁b c", "▁ ", "ﬁ ½ ①"]
    docs = [(1, None), (2, ""), (3, " "), (4, "  "), (5, "a"), (6, " leading and trailing "), (None, "no id"), (7, "\n\n a\n b")]
    docs += [(20 + i, s) for i, s in enumerate(special)]
    docs += [(100 + i, rng.choice([" ", "", "  "]).join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(60)]
    docs += [(200, "the same text twice"), (200, "the same text twice"), (200, "another text of that id"), (201, "ab" * 700)]
    return docs


@pytest.mark.parametrize("chunk_bytes", [1, 500, alignment.CHUNK_BYTES])
def test_matches_brute_force(spark, chunk_bytes):
    docs = documents()
    assert run(spark, docs, chunk_bytes=chunk_bytes) == brute(docs)


def test_a_third_of_the_rows_is_one_text(spark):
    docs = [(i, "one text that fills a third of all rows") for i in range(300)] + [(1000 + i, f"row {i} of the others") for i in range(600)]
    assert run(spark, docs, chunk_bytes=2_000) == brute(docs)


def test_groups_as_text(spark):
    df = spark.createDataFrame([(1, "tokenization of words"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.counted_links(df, groups=True).collect()}
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256
    assert len(rows[1].groups.split(";")) == rows[1].n_groups
    assert (rows[2].groups, rows[2].groups_sha256, rows[2].n_links) == ("", "", 0)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_all_texts_without_tokens(spark):
    assert run(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")])


def test_texts_are_cut_in_stretches(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choices("ab  \n", k=5_000))
    whole = list(alignment.pieces_of(text, True))
    monkeypatch.setattr(alignment, "_STRETCH", 50)
    parts = list(alignment.pieces_of(text, True))
    assert len(parts) > 10 and [p for s in parts for p in s] == whole[0]
    assert " ".join(whole[0]) == text and list(alignment.pieces_of(text, False)) == [[text]]


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_those_that_both_have(seed):
    rng = np.random.default_rng(seed)
    a_sizes, b_sizes, a_first, b_first, expected = [], [], [0], [0], []
    base = 0
    for _ in range(40):
        length = int(rng.integers(0, 60))
        for sizes, first in ((a_sizes, a_first), (b_sizes, b_first)):
            inner = np.flatnonzero(rng.random(max(length - 1, 0)) < rng.random()) + 1
            ends = np.append(inner, length) if length else inner
            sizes += (base + ends).tolist()
            first.append(len(sizes))
        base += length
    a_ends, b_ends = np.array(a_sizes), np.array(b_sizes)
    a, b = alignment.shared_cuts(a_ends, b_ends, np.array(a_first), np.array(b_first))
    expected = np.intersect1d(a_ends, b_ends)
    assert a_ends[a].tolist() == b_ends[b].tolist() == expected.tolist()
