import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import window_packing as wp
from marketloom.llm.queries import tokenizer


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=80))
def test_containers(sizes):
    doc, part, container, tokens = wp.pack(np.array(sizes, np.int64), 32)
    used = np.bincount(container, tokens) if len(container) else np.zeros(0)
    assert (used <= 32).all()
    for i, size in enumerate(sizes):
        own = tokens[doc == i]
        assert own.sum() == size and len(own) == max(1, -(-size // 32))
        assert part[doc == i].tolist() == list(range(len(own)))
    if sum(sizes):
        assert len(set(container[tokens > 0])) < 2 * -(-sum(sizes) // 32) + 1


def test_level_choice_against_brute_force():
    """Every document goes where the sum of squares of the open levels becomes smallest."""
    rng = np.random.default_rng(5)
    packer = wp.Packer(20)
    for size in rng.integers(1, 20, 300).tolist():
        before = packer.count.copy()
        packer.place(size)
        grown = {}
        for level in [0, *np.flatnonzero(before[: 20 - size + 1]).tolist()]:
            after = before.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 20
            grown[level] = int((after[1:20] ** 2).sum())
        assert int((packer.count[1:20] ** 2).sum()) == min(grown.values())


def test_fill_of_many():
    sizes = np.random.default_rng(1).integers(20, 900, 20_000)
    _, _, container, tokens = wp.pack(sizes, 2048)
    assert tokens.sum() / (len(set(container.tolist())) * 2048) > 0.99


def test_table(spark):
    texts = ["một hai ba", None, "", "dài " * 6000, "a" * 300_000, " " * 300_000, "một hai ba"]
    df = spark.createDataFrame([(i, t, 5, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, container string")
    out = wp.packed(df, tokenizer(), capacity=512)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    own = {i: wp.count_tokens(t, tokenizer()) for i, t in enumerate(texts)}
    for i in own:
        assert sum(r["n_tokens"] for r in rows if r["doc_id"] == i) == own[i]
    assert sum(r["doc_id"] == 0 for r in rows) == 1
    assert wp.fill(out, 512).first()["fullest"] <= 512
    assert [tuple(r) for r in rows] == [tuple(r) for r in wp.packed(df, tokenizer(), capacity=512).collect()]
    assert wp.packed(df.limit(0), tokenizer()).count() == 0
    nameless = spark.createDataFrame([(None, "một"), (None, "hai"), (1, "ba")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in wp.packed(nameless, tokenizer()).collect()) == ["1", "None", "None"]
    assert wp.packed(df.where("doc_id in (1, 2)"), tokenizer()).count() == 2


@pytest.mark.parametrize("stretch", [50, 97])
def test_cuts_do_not_change_counts(monkeypatch, stretch):
    text = "Tiếng Việt 12 kg, a  b\n\n đồ-chơi 3,5 " * 40
    whole = wp.count_tokens(text, tokenizer())
    monkeypatch.setattr(wp, "STRETCH", stretch)
    assert wp.count_tokens(text, tokenizer()) == whole
