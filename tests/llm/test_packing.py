import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geostrata.llm import packing


def plain_first_fit(sizes, capacity):
    room, out = [], {}
    for i in np.argsort(-np.array(sizes), kind="stable"):
        at = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
        if at is None:
            at = len(room)
            room.append(capacity)
        room[at] -= sizes[i]
        out[int(i)] = at
    return [out[i] for i in range(len(sizes))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(50, 90))
def test_tree_finds_the_first_container_with_room(sizes, capacity):
    assert packing.first_fit_decreasing(np.array(sizes, np.int64), capacity).tolist() == plain_first_fit(sizes, capacity)


def packed(spark, rows, specs, **options):
    return packing.pack(spark.createDataFrame(rows, "doc_id long, n long, container long, spec_id int"), "doc_id", "n", spark.createDataFrame(specs, "spec_id int, capacity int"), **options).toPandas()


def test_pack(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), int(n), 0, 0) for i, n in enumerate(rng.integers(0, 700, 3000))] + [(5000, 10_001, 0, 0), (5001, 0, 0, 0)]
    out = packed(spark, [*rows, (None, 5, 0, 0), (6000, None, 0, 0), (6001, -1, 0, 0)], [(1, 512), (2, 4096), (3, 0), (4, None)], group_rows=1000)
    assert set(out.spec_id) == {1, 2}
    for spec, capacity in ((1, 512), (2, 4096)):
        one = out[out.spec_id == spec]
        total = one.groupby("doc_id").tokens.sum()
        assert total.to_dict() == {r[0]: r[1] for r in rows}
        assert one.groupby("container").tokens.sum().max() <= capacity
        split = one.groupby("doc_id").size()
        assert set(split[split > 1].index) == {r[0] for r in rows if r[1] > capacity}
        parts = one[one.doc_id == 5000].sort_values("part")
        assert (parts.first_token.to_numpy() == np.cumsum(np.r_[0, parts.tokens[:-1]])).all()
    small = out[out.spec_id == 1]
    assert small.tokens.sum() / (small.container.nunique() * 512) > 0.95


def test_nothing_to_pack(spark):
    assert len(packed(spark, [], [(1, 10)])) == 0
    assert len(packed(spark, [(1, 1, 0, 0)], [])) == 0
    assert packed(spark, [(1, 0, 0, 0), (2, 0, 0, 0)], [(1, 10)]).container.nunique() == 1
    with pytest.raises(ValueError):
        packed(spark, [(1, 1, 0, 0)], [(i, 10) for i in range(packing.MOST_SPECS + 1)])


def test_repeated_keys_are_items(spark):
    assert packed(spark, [(1, 6, 0, 0), (1, 6, 0, 0)], [(1, 10)]).container.nunique() == 2


def test_documents(spark):
    docs = spark.createDataFrame([(1, "hello world " * 40), (2, None), (3, "")], "doc_id long, text string")
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 30), (2, None, 30)], "spec_id int, tokenizer string, capacity int")
    out = packing.pack_documents(docs, "doc_id", "text", specs).toPandas()
    assert set(out.doc_id) == {1, 2, 3} and out.tokens.max() <= 30
    assert packing.pack_documents(docs, "doc_id", "text", specs.where("spec_id = 2")).count() == 0


def test_no_tokenizer_is_left_out(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    specs = spark.createDataFrame([(i, f"t{i}", 30) for i in range(packing.MOST_SPECS + 1)], "spec_id int, tokenizer string, capacity int")
    with pytest.raises(ValueError, match="tokenizers"):
        packing.pack_documents(docs, "doc_id", "text", specs)
