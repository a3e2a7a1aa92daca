"""Token counts after edits against counting anew."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm.tokencount import TokenTree, count_tokens, edit_tokens, standard_edits, token_state
from tributary.llm.tokenizing import default_path


@pytest.fixture(scope="module")
def tokens():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.text("ab .,'\n\té漢", max_size=200), st.lists(st.tuples(st.integers(-3, 220), st.integers(0, 60), st.text("ab .'\n", max_size=30)), max_size=6))
def test_any_edits(text, edits):
    from tokenizers import Tokenizer

    count = TOKENIZER.setdefault("t", Tokenizer.from_file(default_path()))
    one = lambda leaves: [len(count.encode(x, add_special_tokens=False).ids) for x in leaves]
    tree, now = TokenTree(text, one, size=8), text
    for start, length, new in edits:
        tree.replace(start, length, new)
        a = max(0, min(start, len(now)))
        now = now[:a] + new + now[min(a + length, len(now)) :]
        assert tree.text() == now and len(tree) == len(now) and tree.total() == one([now])[0]


TOKENIZER: dict = {}


def test_few_leaves_are_counted_again(tokens):
    rnd = random.Random(1)
    text = " ".join("w" * rnd.randrange(1, 9) for _ in range(20_000))
    tree = TokenTree(text, lambda leaves: [tokens(x) for x in leaves])
    before = tree.encoded
    tree.replace(50_000, 3, " new words ")
    assert tree.encoded - before < 2000 and tree.total() == tokens(tree.text())


def test_query(spark, odd, tokens, empty):
    df, rows = odd
    out = count_tokens(df).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in out:
        if r["doc_id"] is None:
            continue
        t = now = texts[r["doc_id"]]
        for start, length, new in standard_edits(t):
            now = now[:start] + new + now[start + length :]
        assert (r["n_tokens"], r["edited_tokens"], r["edited_chars"], r["encoded_chars"]) == (tokens(t), tokens(now), len(now), len(t))
    assert count_tokens(empty).collect() == []


def test_given_edits(spark, tokens):
    kind = "doc_id long, text string, edits array<struct<start:int,length:int,new:string>>"
    rows = [(1, "one two three", [(4, 3, "2"), (None, None, None), (90, 5, " end")]), (2, None, None), (3, "abc", []), (4, None, [(0, 0, "new")])]
    out = {r["doc_id"]: (r["n_tokens"], r["edited_tokens"]) for r in count_tokens(spark.createDataFrame(rows, kind), edits_col="edits").collect()}
    assert out == {1: (tokens("one two three"), tokens("one 2 three end")), 2: (0, 0), 3: (tokens("abc"),) * 2, 4: (0, tokens("new"))}


def test_edits_of_a_kept_state(spark, tokens, tmp_path):
    """A second call edits what the first one kept, and counts only leaves that are touched."""
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randrange(1, 9) for _ in range(2000))) for i in range(6)] + [(7, None)]
    token_state(spark.createDataFrame(rows, "doc_id long, text string")).write.parquet(f"{tmp_path}/0")
    now = {i: t or "" for i, t in rows}
    for step in range(2):
        edits = {i: [(rnd.randrange(5000), rnd.randrange(9), rnd.choice(["", " new words ", "x"]))] for i in now if i != 3}
        given_ = spark.createDataFrame([(i, e) for i, e in edits.items()], "k long, edits array<struct<start:int,length:int,new:string>>")
        state = spark.read.parquet(f"{tmp_path}/{step}")
        done = edit_tokens(state.join(given_, state["id"] == given_["k"], "left"), "edits")
        done.write.parquet(f"{tmp_path}/{step + 1}")
        for i, ((start, length, new),) in edits.items():
            a = min(start, len(now[i]))
            now[i] = now[i][:a] + new + now[i][min(a + length, len(now[i])) :]
        for r in spark.read.parquet(f"{tmp_path}/{step + 1}").collect():
            assert r["text"] == now[r["id"]] and r["edited_tokens"] == sum(r["counts"]) == tokens(now[r["id"]]) and sum(r["sizes"]) == len(r["text"])
            assert r["again_chars"] < 2500 and (r["id"] != 3 or r["again_chars"] == 0)


def test_edits_by_name(spark, tokens):
    """Fields of an edit may stand in any order."""
    docs = spark.createDataFrame([(1, "one two three", [("2", 3, 4)])], "doc_id long, text string, e array<struct<new:string,length:int,start:int>>")
    assert count_tokens(docs, edits_col="e").first()["edited_chars"] == len("one 2 three")
