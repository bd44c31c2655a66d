from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import op03_bpe as O
from tests.llm.common import awkward

pytestmark = pytest.mark.skipif(not Path(O.VOCABULARY).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def codec():
    return O.Codec(Path(O.VOCABULARY).read_text())


SPACES = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b"
TEXTS = st.lists(st.one_of(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80), st.text(alphabet=SPACES + "ab'sé日\U0001f9ec1.", max_size=30)), max_size=6)


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_pieces_give_the_librarys_ids(texts):
    import pyarrow as pa

    codec = O.codec(Path(O.VOCABULARY).read_text())
    if len(texts) % 2:
        codec.forget()
    ids, edges = codec.encode(*O.S.bytes_of(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_round_trip_and_the_librarys_offsets(texts):
    codec = O.codec(Path(O.VOCABULARY).read_text())
    import pyarrow as pa

    found = codec.ids(texts)
    data, starts = O.S.bytes_of(pa.array(texts, pa.string()))
    edges = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(int)
    ids = np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int32)
    begin, end = codec.offsets(ids, data, starts, edges)
    for k, t in enumerate(texts):
        assert codec.decode(found[k]) == t
        assert "".join(codec.pieces(found[k])) == t
        want = codec.tokenizer.encode(t, add_special_tokens=False).offsets
        assert list(zip(begin[edges[k] : edges[k + 1]].tolist(), end[edges[k] : edges[k + 1]].tolist(), strict=True)) == want


def test_split_characters(codec):
    ids = codec.ids(["\U0001f9ec"])[0]
    assert len(ids) > 1
    assert codec.decode(ids) == "\U0001f9ec" and "�" in codec.decode(ids[:1])
    assert codec.pieces(ids) == [""] * (len(ids) - 1) + ["\U0001f9ec"]
    assert codec.decode(np.array([-1, 10**6])) == ""


def test_special_tokens_are_text(codec):
    ids = codec.ids(["<|endoftext|>"])[0]
    assert 50256 not in ids and codec.decode(ids) == "<|endoftext|>" and codec.decode(np.array([50256])) == "<|endoftext|>"


def test_one_hash_for_two_pieces_is_noticed(codec, monkeypatch):
    import pyarrow as pa

    texts = ["an apple or a grape", "nothing shared", "grape apple", "", "le le la la"]
    data, starts = O.S.bytes_of(pa.array(texts))
    want = [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for fold in (3, 2, 1):  # with `fold` hashes in all, pieces of one length and of several are mixed up
        monkeypatch.setattr(O.S, "word_hashes", lambda d, b, e, fold=fold: ((e - b) % fold).astype(np.uint64))
        codec.forget()
        ids, edges = codec.encode(data, starts)
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == want
    monkeypatch.undo()
    codec.forget()


def test_the_older_half_is_forgotten(codec, monkeypatch):
    import pyarrow as pa

    codec.forget()
    monkeypatch.setattr(O, "REMEMBERED", 50)
    for k in range(0, 400, 20):
        texts = [f"word{j} and w{j * 7} é{j % 30}" for j in range(k, k + 20)]
        ids, edges = codec.encode(*O.S.bytes_of(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(codec.known) < 150
    codec.forget()


def test_texts_of_rows_that_split_characters(codec):
    ids = codec.ids(["x\U0001f9ec"])[0]
    for cut in range(len(ids) + 1):
        edges = np.array([0, cut, len(ids), len(ids)])
        assert codec.texts(ids, edges).to_pylist() == [codec.decode(ids[:cut]), codec.decode(ids[cut:]), ""]
    assert codec.texts(np.array([-1, 10**6]), np.array([0, 1, 2])).to_pylist() == ["", ""]


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert sorted(map(repr, O.encoded(docs, back=True).select("doc_id", "decoded").collect())) == sorted(map(repr, docs.selectExpr("doc_id", "text as decoded").collect()))
    out = O.encoded(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["ids"] is None and by[2]["n_tokens"] == 0 and by[1]["ids"] == []
    assert all(len(r["ids"]) == len(r["starts"]) == len(r["ends"]) == r["n_tokens"] for r in rows if r["ids"] is not None)
    back = sorted(map(repr, O.decoded(out).collect()))
    assert back == sorted(map(repr, docs.select("doc_id", "text").collect()))
    assert O.encoded(docs.where("false")).count() == 0
