import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, token_files, tokens
from tessera.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
FAST, WHOLE = Encoder(PATH), Encoder(PATH, by_word=False)


#: Letters that are normalised to other signs too, marks, presentation forms, jamo, and signs around them.
AWKWARD = [*"ab's.!\n\t ́é<|>Σİ१9{_़ּ̇", *(chr(i) for i in range(0x958, 0x960)), *(chr(i) for i in range(0xFB1D, 0xFB4F)), *(chr(i) for i in (0xDDC, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x1E9E, 0x1C5, 0x212B, 0x2ADC, 0xFB01, 0x1E922))]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.lists(st.sampled_from(AWKWARD), max_size=30).map("".join)), max_size=6))
def test_words_apart_give_the_same_ids(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    a, b = FAST.encode(pa.array(texts, pa.string())), WHOLE.encode(pa.array(texts, pa.string()))
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_letters_that_become_marks_stay_with_the_signs_behind_them():
    for text in ("İ{", "x İ. y", "istİ, a", "\u0958.", "\u0915\u093c.", "\ufb2a.", "a\ufb2a!b", "\u0130\u0958. \u0130"):
        assert FAST.encode(pa.array([text]))[0].tolist() == WHOLE.encode(pa.array([text]))[0].tolist(), text


def test_signs_behind_letters_are_no_words_of_their_own(monkeypatch):
    """Letters are remembered once for all signs behind them, also after others were forgotten."""
    monkeypatch.setattr(tokens, "MOST_WORDS", 6)
    enc = Encoder(PATH)
    for k in "abcdefgh":
        texts = [f"lantern lantern, lantern... {k * 3}forge!) {k}e\u0301, \u0130{{ \u0130, 53.1. {k}.{k}, ...", f"{k * 3}forge (lantern) lantern!", "", None, ".", f" {k}"]
        a, b = enc.encode(pa.array(texts)), WHOLE.encode(pa.array(texts))
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
        assert "lantern" in enc.code and not {"lantern,", "lantern...", "lantern!", f"{k * 3}forge!)"} & set(enc.code)


def test_special_tokens_and_odd_spaces():
    texts = ["x\x1cy z\u0085w <|endoftext|>a b<|endoftext|> \t  q\r\nk", "é ́a Σας it's 'S don't12", "", None]
    assert FAST.by_word and FAST.encode(pa.array(texts))[0].tolist() == WHOLE.encode(pa.array(texts))[0].tolist()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=300)), np.uint32)
    assert token_files.unpack(token_files.pack(ids, bits), len(ids), bits).tolist() == ids.tolist()
    ends = np.array([0, len(ids) // 3, len(ids)])
    s = token_files.Shard(token_files.make_shard(ids, ends, np.array([5, 9]), np.array([False, True]), bits, block_ids=7))
    assert s.ids(0, s.n_ids).tolist() == ids.tolist() and s.document(1).tolist() == ids[ends[1] :].tolist()
    a, b = sorted((data.draw(st.integers(0, len(ids))), data.draw(st.integers(0, len(ids)))))
    assert s.ids(a, b).tolist() == ids[a:b].tolist()


def test_token_files_hold_all_documents_in_order(spark, odd, none, tmp_path):
    shards = token_files.write_token_shards(odd, f"file://{tmp_path}/t", PATH, shard_ids=1000, block_ids=64)
    got = token_files.shard_documents(shards).collect()
    want = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    at = 0
    by = {}
    for d, t in want:
        by.setdefault(d, []).append(WHOLE.lib.encode(t or "", add_special_tokens=False).ids + [1])
    for r in got:
        assert r["start"] == at and r["ids"] in by[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += len(r["ids"])
    assert token_files.shard_documents(token_files.write_token_shards(none, f"file://{tmp_path}/e", PATH)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_patterns_place_every_length_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    placed = {}
    for count, p in patterns:
        assert count > 0 and sum(a * b for a, b in p) <= 64
        for length, copies in p:
            placed[length] = placed.get(length, 0) + copies * count
    assert placed == histogram


def test_shortest_pack_is_taken_first():
    """Against a packing of one piece at a time."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 33, 400)
    packs = []
    for n in sorted(lengths.tolist(), reverse=True):
        fit = [p for p in packs if sum(p) + n <= 32]
        if fit:
            min(fit, key=sum).append(n)
        else:
            packs.append([n])
    h = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    assert abs(sum(c for c, _ in packing.shortest_pack_first(h, 32)) - len(packs)) <= 1


def test_packed_documents(spark, odd, none):
    packed = packing.pack_documents(odd, PATH, seq_len=64)
    rows = packed.collect()
    docs = {}
    for r in odd.collect():
        docs.setdefault(r["doc_id"], []).append(WHOLE.lib.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    assert sum(r["length"] for r in rows) == sum(len(x) for v in docs.values() for x in v)
    for r in rows:
        assert any(x[r["start"] : r["start"] + r["length"]] == r["ids"] and len(x) == r["doc_tokens"] for x in docs[r["doc_id"]])
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by) == list(range(len(by)))
    for rs in by.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == np.cumsum([0] + [r["length"] for r in rs])[:-1].tolist()
        total = sum(r["length"] for r in rs)
        assert total <= 64 and rs[0]["padded_length"] == (total if total & (total - 1) == 0 else 64)
    for s in packing.sequences(packed, pad_id=0).collect():
        assert s["ids"][: sum(r["length"] for r in by[s["sequence_id"]])] == [i for r in by[s["sequence_id"]] for i in r["ids"]]
    assert packing.pack_documents(none, PATH).collect() == []
