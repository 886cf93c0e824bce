"""Token counts, packing, language, toxicity and media: edge cases and brute force."""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, score string, size string"
TEXTS = [None, "", "Hello there, world.", "a  b\n\nc", "  ", "<|endoftext|> x <|endoftext|>", "déjà vu 12's", "one " * 3000, "日本語 text", "Hello there, world.", "a \n b", "tab\tend "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, None if i == 4 else f"s{i % 3}", "x", "y", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[2]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_counts_are_the_library_s(docs, empty):
    from tokenizers import Tokenizer

    from sparkloom.llm import tokencount

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = tokencount.count_tokens(docs, P.path("byte_bpe_50k.json")).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(rows) == len(TEXTS)  # twelve and a repeat, without the null id
    for r in rows:
        assert r.n_tokens == len(tok.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512)
    assert tokencount.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0


SPACES = " \t\n\x0b\r\x85\xa0\u1680\u2003\u2028\u3000\x1c\x1f\u180e\u200b\ufeff"


@given(st.lists(st.one_of(st.text(max_size=8), st.text(SPACES, max_size=4), st.sampled_from(["<|endoftext|>", "it's", " the", "12", "!?", "é", "e\u0301", "日本", " 's", "\U0001f600"])), max_size=12))
@settings(max_examples=400, deadline=None)
def test_chunks_agree_with_the_library(parts):
    import pyarrow as pa

    from sparkloom.llm import vocab

    enc = vocab.encoder(P.path("byte_bpe_50k.json"))
    texts = ["".join(parts), " ".join(parts), "\n\n".join(parts)]
    want = [enc.v.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode(pa.array(texts, pa.string()))] == want
    assert enc.count(pa.array(texts, pa.string())).tolist() == [len(x) for x in want]


def test_chunks_of_real_texts_agree_with_the_library():
    """Real texts, as they are and with white space that adjoins; none of the latter goes to the library whole."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from sparkloom.llm import vocab

    enc = vocab.encoder(P.path("byte_bpe_50k.json"))
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    texts += [t.replace(". ", ".\n\n    ").replace(", ", ",  ") for t in texts]
    want = [enc.v.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(enc.v.chunks(t) is not None for t in texts)
    assert [x.tolist() for x in enc.encode(pa.array(texts, pa.string()))] == want
    assert enc.count(pa.array(texts, pa.string())).tolist() == [len(x) for x in want]


def test_counts_by_sentencepiece(docs):
    import sentencepiece

    from sparkloom.llm import tokencount

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, P.path("piece_bpe_32k.model")).collect()}
    assert all(got[i] == len(model.encode(t or "")) for i, t in enumerate(TEXTS) if i != 3)


def test_single_tokens_are_proved():
    from sparkloom.llm import vocab

    v = vocab.ByteVocabulary(P.path("byte_bpe_50k.json"))
    assert v.plain and len(v.single) == 50256
    for word in ("the", "Hello", "dedup"):
        ids = v.ids_of_text(" " + word)
        assert (v.single.get(b" " + word.encode()) == ids[0]) == (len(ids) == 1)


def test_pieces_cover_each_id_once(docs, empty):
    from tokenizers import Tokenizer

    from sparkloom.llm import packing

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), window=64).collect()
    lanes: dict[int, list] = {}
    docs_ids: dict = {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length
        lanes.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs_ids.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
    for n, lane in lanes.items():
        ends = np.cumsum([0] + [k for _, k in sorted(lane)])
        assert [o for o, _ in sorted(lane)] == ends[:-1].tolist()
        assert ends[-1] == 64 or n == max(lanes)
    assert sorted(lanes) == list(range(len(lanes)))
    for i, t in enumerate(TEXTS):
        if i in (2, 3):
            continue
        parts = sorted(docs_ids[i])
        assert [x for _, ids, _ in parts for x in ids] == tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert {n for _, _, n in parts} == {sum(len(ids) for _, ids, _ in parts)}
    assert sum(n for start, _, n in docs_ids[2] if start == 0) == 2 * docs_ids[2][0][2]  # the repeat is packed again
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_media_round_trip(docs, empty):
    from sparkloom.llm import isomedia

    rows = isomedia.media_digests(docs).collect()
    assert len(rows) == len(TEXTS) + 1 and isomedia.media_digests(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        pad = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = by[i if i != 3 else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        f = json.loads(r.feature)
        assert f["codec"] == "raw " and f["samples"] == len(pad) // 192 and len(f["keyframes"]) == -(-f["samples"] // 16)
    assert by[2][1:] == by[9][1:]


def test_media_reads_other_layouts():
    from sparkloom.llm import isomedia

    payload = bytes(range(192)) * 200
    raw = isomedia.write_container(payload)
    t = isomedia.read_container(raw)[0]
    assert isomedia.stored_bytes(raw, t) == payload and t["duration"] == len(payload) / 8000
    # A free box of 64-bit size in front of the rest shifts every offset: ranges follow the chunk table, so they no longer fit.
    wide = (1).to_bytes(4, "big") + b"free" + (24).to_bytes(8, "big") + bytes(8)
    assert isomedia.read_container(raw + wide)[0]["codec"] == "raw "
    for broken in (raw[:100], raw[:-3], b"", b"\0\0\0\4free"):
        got = isomedia.probe([broken])
        assert got["error"][0] is not None and got["codec"][0] is None
    with pytest.raises(ValueError):
        isomedia.write_container(b"x")


@pytest.mark.parametrize("explicit", [True, False])
def test_media_reads_fragments(explicit):
    """A file whose movie box has no samples, and two fragments: sizes and flags of each sample, or defaults."""
    import struct

    from sparkloom.llm import isomedia
    from sparkloom.llm.isomedia import _box, _full

    whole = isomedia.write_container(bytes(192))
    at = whole.index(b"stsd") - 4
    stsd = whole[at : at + struct.unpack_from(">I", whole, at)[0]]
    none = [_full(k, struct.pack(">I", 0)) for k in (b"stts", b"stsc", b"stco")] + [_full(b"stsz", struct.pack(">II", 0, 0))]
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(13)), _box(b"minf", _box(b"stbl", stsd, *none)))
    trak = _box(b"trak", _full(b"tkhd", struct.pack(">IIII", 0, 0, 7, 0), bytes(64)), mdia)
    raw = _box(b"ftyp", b"iso5", bytes(4)) + _box(b"moov", trak, _box(b"mvex", _full(b"trex", struct.pack(">IIIII", 7, 1, 20, 5, 0x10000))))
    want, keys = b"", []
    for n in range(2):
        samples = [bytes([n * 8 + i]) * (5 if not explicit else 3 + i) for i in range(4)]
        if explicit:
            run = b"".join(struct.pack(">III", 30, len(x), 0 if i == 2 else 0x10000) for i, x in enumerate(samples))
            flags = 0x701
        else:
            run, flags = struct.pack(">I", 0), 0x5  # the first sample's flags: a keyframe
        def moof(offset):
            trun = _full(b"trun", struct.pack(">Ii", 4, offset), run, flags=flags)
            return _box(b"moof", _full(b"mfhd", struct.pack(">I", n + 1)), _box(b"traf", _full(b"tfhd", struct.pack(">I", 7), flags=0x20000), trun))
        raw += moof(len(moof(0)) + 8) + _box(b"mdat", *samples)
        want += b"".join(samples)
        keys.append(4 * n + (2 if explicit else 0))
    t = isomedia.read_container(raw)[0]
    assert isomedia.stored_bytes(raw, t) == want and t["keys"].tolist() == keys and t["duration"] == 8 * (30 if explicit else 20) / 1000
    assert isomedia.probe([raw])["samples"][0] == 8 and isomedia.probe([raw[:-9]])["error"][0] is not None


def test_language_held_out(spark):
    from sparkloom.llm import langid
    from sparkloom.llm.common import is_held_out

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = langid.learn(docs)
    rows = langid.identify(docs, profiles).collect()
    held = [r.lang_pred == r.lang for r in rows if is_held_out(r.doc_id)]
    assert len(held) > 30 and np.mean(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, docs, empty):
    from sparkloom.llm import langid

    profiles = langid.learn(docs)
    got = {r.doc_id: r for r in langid.identify(docs, profiles).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 4))
    nothing = langid.learn(empty)
    assert nothing.languages == [] and {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty, profiles).count() == 0 and langid.identify(docs, profiles).columns.count("score") == 1


def test_rank_order_by_hand():
    from sparkloom.llm import langid

    p = langid.Profiles.of({"aa": langid.top_grams("abab abab", 5).tolist(), "zz": langid.top_grams("zyzy zyzy", 5).tolist()}, 5)
    assert p.predict("abab abab") == ("aa", 1.0) and p.predict("zyzy")[0] == "zz" and p.predict("12 34") == ("und", 0.0)


def test_toxicity_held_out(spark):
    from sparkloom.llm import toxicity
    from sparkloom.llm.common import is_held_out

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    y = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score(docs, model).collect() if is_held_out(r.doc_id) and r.doc_id in y]
    hit = [r.predicted for r in rows if y[r.doc_id] == 1]
    clean = [r.predicted for r in rows if y[r.doc_id] == 0]
    assert np.mean(hit) > 0.6 and np.mean(clean) < 0.05


def test_grammar_weighs_scopes(docs, empty):
    from sparkloom.llm import toxicity

    m = toxicity.Model({"zorg": 3.0}, {"blar": 3.0})
    plain, aimed, negated, quoted = (m.features(t)[0] for t in ("what a zorg", "you are a zorg", "he is not a zorg at all today", "she said that zorg came"))
    assert aimed > plain > negated and plain > quoted and m.features("blarhead")[0] == 3.0
    assert m.features("I will kill you")[0] > m.features("I will kill time")[0] > 0
    after, factor = toxicity.grammar()
    assert len(after) == 4 * 7 * 6 and factor[0][toxicity.INSULT] == 1.0
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert got[0] == got[1] and all(0 <= s <= 1 for s in got.values()) and toxicity.score(empty, m).count() == 0
