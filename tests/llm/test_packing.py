import os
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sceneloom.llm import packing as p

SCHEMA = "doc_id bigint, text string, piece string, container string, grp string, size string"
needs_vocabulary = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"), reason="no vocabulary")


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def plain_first_fit(sizes, capacity):
    room, out = [], []
    for x in sizes:
        k = next((k for k, r in enumerate(room) if r >= x), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= x
        out.append(k)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_tree_equals_plain_first_fit(sizes):
    sizes.sort(reverse=True)
    assert p.first_fit_decreasing(sizes, 20) == plain_first_fit(sizes, 20)


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1'.,!éß界😀 \t\n\r  \x1c")), max_size=60))
def test_counts_equal_the_tokenizer(text):
    c = p.counts("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert c.of(text) == len(c.encoding.encode_ordinary(text))


@needs_vocabulary
def test_pack(spark):
    r = random.Random(4)
    rows = [(k, " ".join(f"wort{r.randrange(99)}" for _ in range(r.choice([5, 50, 300, 700])))) for k in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "wort " * 5000), (1003, "x" * 50_000), (1004, " \n ")]
    got = p.pack(table(spark, rows), p.Params(group_items=150)).collect()
    c = p.counts("/opt/tokenizers/byte_bpe_50k.tiktoken")
    used, parts = defaultdict(int), defaultdict(list)
    for x in got:
        parts[x.doc_id].append(x)
        if x.container is not None:
            used[x.container] += x.n_tokens
    assert max(used.values()) <= 2048 and set(parts) == {k for k, _ in rows}
    for k, text in rows:
        n = c.of(text)
        assert sum(x.n_tokens for x in parts[k]) == n and sorted(x.piece for x in parts[k]) == list(range(len(parts[k])))
        assert len(parts[k]) == max(1, -(-n // 2048))
        assert all((x.container is None) == (n == 0) for x in parts[k])
    assert sum(used.values()) / (2048 * len(used)) > 0.9
    assert p.pack(table(spark, [])).count() == 0
