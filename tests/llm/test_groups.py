"""Mixing, substring dedup, near-duplicates, vectors, suffixes and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "doc_id long, text string, lang string, source string, size long, key string, d string, a string"


def frame(spark, texts, ids=None, sources=None):
    rows = [(ids[i] if ids else i, t, None, sources[i] if sources else f"s{i % 3}", 1, "k", "d", "a") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def corpus(seed: int = 1) -> list[str | None]:
    """Copies, near copies, shared passages, low-entropy runs, nulls, empty and long texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(70)]
    base = [[word() for _ in range(r.randint(5, 160))] for _ in range(14)]
    out: list[str | None] = [None, "", " \n ", "x " * 120, "x " * 121, "\x0b".join(passage), "y" * 200, "y" * 260]
    for b in base:
        out.append(" ".join(b))
        edited = list(b)
        edited[r.randrange(len(b))] = word()
        out.append("  ".join(edited))
        out.append(" ".join(b[:20] + passage[5:] + b[20:]))
    out += [out[8], out[8], out[11], " ".join(w for b in base for w in b)]
    r.shuffle(out)
    return out


def covered(seqs, ids, window):
    own: dict = {}
    for i in sorted(range(len(ids)), key=lambda i: ids[i]):
        for j in range(len(seqs[i]) - window + 1):
            own.setdefault(tuple(seqs[i][j : j + window]), ids[i])
    out = []
    for i, s in enumerate(seqs):
        gone = np.zeros(len(s), bool)
        for j in range(len(s) - window + 1):
            if own[tuple(s[j : j + window])] < ids[i]:
                gone[j : j + window] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_against_brute_force(spark, seed):
    from sparkloom.llm import phrases

    texts = corpus(seed)
    seqs = [(t or "").encode().split() for t in texts]
    gone = covered(seqs, list(range(len(texts))), 50)
    rows = {r.doc_id: r for r in phrases.digests(frame(spark, texts)).collect()}
    assert len(rows) == len(texts) and sum(g.sum() for g in gone) > 100
    for i, (s, g) in enumerate(zip(seqs, gone)):
        kept = b" ".join(w for w, x in zip(s, g) if not x)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (len(s), int(g.sum()), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_against_brute_force(spark, seed, monkeypatch):
    from sparkloom.llm import suffixes

    if seed == 2:
        monkeypatch.setattr(suffixes, "BUCKET", 1)  # every anchor counts as crowded
    texts = corpus(seed)
    seqs = [(t or "").encode() for t in texts]
    gone = covered(seqs, list(range(len(texts))), 50)
    rows = {r.doc_id: r for r in suffixes.digests(frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, (s, g) in enumerate(zip(seqs, gone)):
        kept = np.frombuffer(s, np.uint8)[~g].tobytes()
        spans = int((g & ~np.append(False, g[:-1])[: len(g)]).sum())
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(s), int(g.sum()), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("bucket", [2000, 1])
def test_suffixes_of_a_passage_repeated_in_one_document(spark, bucket, monkeypatch):
    from sparkloom.llm import suffixes

    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    texts = []
    for n in (50, 60, 70, 90, 150):
        s, c, d = text(n), text(80), text(80)
        texts += [text(80) + s + text(80), (c + s + d) * 2, (c + s + d) * 3 + "z", s + text(10) + s]
    texts += ["y" * 300, "y" * 150 + text(30) + "y" * 150 + "z"]
    gone = covered([t.encode() for t in texts], list(range(len(texts))), 50)
    rows = {x.doc_id: x.n_removed for x in suffixes.digests(frame(spark, texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [int(g.sum()) for g in gone]


@pytest.mark.parametrize("bucket, local, most", [(2000, 64, 2_000_000), (2000, 2, 300), (1, 3, 1000)])
def test_suffixes_of_texts_that_share_an_id(spark, bucket, local, most, monkeypatch):
    """Two texts of one id or of none, texts longer than what is worked on at once, anchors crowded in one batch."""
    from sparkloom.llm import suffixes

    for name, value in (("BUCKET", bucket), ("LOCAL", local), ("AT_ONCE", most)):
        monkeypatch.setattr(suffixes, name, value)
    texts, ids = corpus(7), []
    long = "".join(random.Random(8).choice("abcdefgh ") for _ in range(7000))
    texts += [long, long[:400], long[3000:3500] + "tail", long, "head" + long[100:5000]]
    r = random.Random(3)
    for _ in texts:
        ids.append(r.choice([None, 1, 2, 7, 7, 9, 12, 15, 20]))
    seqs = [(t or "").encode() for t in texts]
    gone = covered(seqs, [1 << 70 if i is None else i for i in ids], 50)
    want = sorted((i or -1, len(s), int(g.sum()), hashlib.sha256(np.frombuffer(s, np.uint8)[~g].tobytes()).hexdigest()) for i, s, g in zip(ids, seqs, gone))
    rows = suffixes.digests(frame(spark, texts, ids=ids)).collect()
    assert sorted((x.doc_id or -1, x.n_bytes, x.n_removed, x.kept_sha256) for x in rows) == want


@given(st.lists(st.text("ab", min_size=6, max_size=30), min_size=1, max_size=6), st.integers(1, 20))
@settings(max_examples=100, deadline=None)
def test_deep_shallow_order(parts, depth):
    from sparkloom.llm import suffixes

    data = "".join(parts).encode() + b"a" * depth
    at = np.arange(len(data) - depth + 1)
    order, equal = suffixes.deep_shallow(data, at, np.zeros(len(at), np.int64), depth)
    cut = [data[i : i + depth] for i in at[order]]
    assert sorted(order.tolist()) == at.tolist() and cut == sorted(cut)
    assert equal.tolist() == [False] + [a == b for a, b in zip(cut, cut[1:])]


def test_blind_trie_orders():
    from sparkloom.llm.suffixes import BlindTrie

    r = random.Random(3)
    words = ["".join(r.choice("ab") for _ in range(9)).encode() for _ in range(200)]
    trie = BlindTrie(b"".join(words), 9)
    for i in range(len(words)):
        trie.insert(i, 9 * i)
    assert [words[i] for i in trie.ordered()] == sorted(words)


@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=60, deadline=None)
def test_equal_windows_share_an_anchor(x, y):
    from sparkloom.llm.anchored import Scheme, mixed

    scheme = Scheme(12, 4)
    values = mixed(np.array(x + y, np.uint64) + np.uint64(7))
    edges = np.array([0, len(x), len(x) + len(y)])
    at, h = scheme.anchors(values, edges)
    for lo, hi in ((0, len(x)), (len(x), len(x) + len(y))):
        for i in range(lo, hi - 12 + 1):
            assert ((at >= i) & (at <= i + 8)).any()
    c1, c2 = scheme.contexts(values, edges, at)
    assert len(c1) == len(c2) == len(at)


def test_repeats_null_and_equal_ids(spark):
    from sparkloom.llm import phrases, suffixes

    t = " ".join(f"w{i}" for i in range(60))
    docs = frame(spark, [t, t, t + " end", t], ids=[5, 5, None, 7])
    got = sorted((r.doc_id or -1, r.n_removed) for r in phrases.digests(docs).collect())
    assert got == [(-1, 60), (5, 0), (5, 0), (7, 60)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffixes.digests(docs).collect())
    assert got == [(-1, len(t)), (5, 0), (5, 0), (7, len(t))]
    none = docs.limit(0)
    assert phrases.digests(none).count() == suffixes.digests(none).count() == 0
    kept = {r.doc_id: r.text for r in phrases.deduplicate(docs).collect()}
    assert kept == {5: t, None: "end"}


def test_phrases_of_texts_that_share_an_id(spark):
    """Two texts of one id or of none, the anchors of one beyond the other's end."""
    from sparkloom.llm import phrases

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    body = [word() for _ in range(600)]
    texts = [" ".join(body), " ".join(body[500:580]), " ".join([word() for _ in range(20)] + body[100:400]), " ".join(body[450:] + [word()]), " ".join([word() for _ in range(69)]), *corpus(7)]
    ids = [2, 7, 7, None, 7] + [r.choice([None, 1, 2, 7, 9, 12]) for _ in texts[5:]]
    seqs = [(t or "").encode().split() for t in texts]
    gone = covered(seqs, [1 << 70 if i is None else i for i in ids], 50)
    want = sorted((i or -1, len(s), int(g.sum()), hashlib.sha256(b" ".join(w for w, x in zip(s, g) if not x)).hexdigest()) for i, s, g in zip(ids, seqs, gone))
    rows = phrases.digests(frame(spark, texts, ids=ids)).collect()
    assert sorted((x.doc_id or -1, x.n_words, x.n_removed, x.kept_sha256) for x in rows) == want


CLASH = ("key", "d", "t", "row", "s", "e", "first", "n", "k", "fp", "root", "component_id", "least", "_key", "_k", "_s", "_first", "_n", "_fp", "_root", "_least", "_rank", "_source", "_all", "_p", "_copy", "certain", "size", "source_size", "target", "copies", "taken", "rank", "score", "lang_pred", "x", "l", "count")


@pytest.mark.parametrize("name", ["deduplicate", "keep_one", "keep_one_similar", "mixed_rows", "mix", "identify", "toxicity"])
def test_columns_of_any_name_pass(spark, name):
    from pyspark.sql import functions as F

    from sparkloom.llm import langid, mixing, phrases, simhash, toxicity

    new = {"mix": ("size", "source_size", "target", "copies", "taken", "inclusion"), "identify": ("lang_pred", "score"), "toxicity": ("score", "predicted")}.get(name, ())
    docs = frame(spark, ["a b c", "d e f g", None, "h i j k l"]).select("doc_id", "text", "lang", "source")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    run = {"deduplicate": phrases.deduplicate, "keep_one": simhash.keep_one, "keep_one_similar": simhash.keep_one_similar, "mixed_rows": mixing.mixed_rows, "mix": mixing.mix, "identify": lambda d: langid.identify(d, langid.Profiles.of({}, 5)), "toxicity": lambda d: toxicity.score(d, toxicity.Model({}, {}))}[name]
    out = run(docs)
    assert [c for c in out.columns if c not in new] == [c for c in docs.columns if c not in new]
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASH if c not in new)


def test_simhash_of_crowded_values(spark, monkeypatch):
    from sparkloom.llm import shingles, simhash

    monkeypatch.setattr(simhash, "SHARE", 3)
    monkeypatch.setattr(shingles, "SHARE", 4)
    test_simhash_against_all_pairs(spark)
    test_near_copies_stage_against_all_pairs(spark)


def test_simhash_against_all_pairs(spark):
    from sparkloom.llm import simhash

    texts = corpus(4) + [" ".join(f"q{i}" for i in range(400)), " ".join(f"q{i}" if i != 200 else "z" for i in range(400))]
    fp = [simhash.fingerprint(t) for t in texts]
    group = list(range(len(fp)))
    for _ in fp:
        for i in range(len(fp)):
            for j in range(len(fp)):
                if (fp[i] ^ fp[j]).bit_count() <= 4:
                    group[i] = min(group[i], group[j])
    rows = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [(rows[i].fingerprint, rows[i].component_id) for i in range(len(fp))] == [(format(f, "016x"), g) for f, g in zip(fp, group)]
    assert group[-1] == group[-2] != len(fp) - 1
    assert simhash.near_duplicates(frame(spark, texts).limit(0)).count() == 0
    ids = [None, 3, 3, 4]
    assert {r.doc_id for r in simhash.keep_one(frame(spark, ["a b", "a b", "a b", "c d e"], ids=ids)).collect()} == {3, 4}
    assert simhash.keep_one(frame(spark, ["a b", "a b", "a b", "c d e"], ids=ids)).count() == 2


def test_near_copies_stage_against_all_pairs(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(11)
    texts: list[str | None] = corpus(5)
    for _ in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice((100, 300)))]
        texts.append(" ".join(words))
        for share in (0.01, 0.02, 0.04):  # words edited: similarity above and below 0.8
            texts.append(" ".join("z%d" % r.randrange(9999) if r.random() < share else w for w in words))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    kept = {x.doc_id for x in corpus_pipeline.near_copies(spark, frame(spark, texts), "").collect()}
    assert kept == set(group) and len(pairs) > 60
    none = frame(spark, texts).limit(0)
    assert corpus_pipeline.near_copies(spark, none, "").count() == 0
    ids = [None, 3, 3, 4]
    assert sorted(x.doc_id for x in corpus_pipeline.near_copies(spark, frame(spark, ["a b", "a b", "a b", "c d e"], ids=ids), "").collect()) == [3, 4]


@given(st.lists(st.integers(0, (1 << 12) - 1), unique=True, max_size=60), st.integers(1, 3))
@settings(max_examples=50, deadline=None)
def test_forest_joins_what_pairs_join(xs, distance):
    from sparkloom.llm.simhash import forest, link_runs

    x = np.array(xs, np.uint64)

    def parts(links):
        root = {v: v for v in xs}
        for _ in xs:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    pairs = [(a, b) for a in xs for b in xs if a != b and (a ^ b).bit_count() <= distance]
    assert parts(pairs) == parts([(int(a), int(b)) for a, b in forest(x, distance)])
    if xs:
        u, v = link_runs(x, np.zeros(len(x), np.int64), distance)
        assert parts(pairs) == parts(list(zip(u.tolist(), v.tolist())))


def test_block_masks_keep_close_pairs():
    from sparkloom.llm.simhash import block_masks

    r = random.Random(5)
    for n in (10, 10**6, 10**9, 10**12):
        masks = block_masks(n)
        for _ in range(200):
            a = r.getrandbits(64)
            b = a
            for bit in r.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_vectors_against_all_pairs(spark):
    from sparkloom.llm import capfilters

    r = np.random.default_rng(6)
    base = r.standard_normal((60, 16))
    x = np.vstack([base, base[:30] + 0.1 * r.standard_normal((30, 16)), base[:5]]).astype(np.float32)
    label = [i % 3 for i in range(60)] + [i % 3 for i in range(30)] + [i % 3 for i in range(5)]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, label))]
    odd = [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] + [1.0] * 15, 0), (203, x[0].tolist(), None), (None, x[0].tolist(), 0), (204, [None] + [1.0] * 15, 0), (205, [], 0), (206, [1.0, 0.0], 1), (207, [2.0, 0.0], 1)]
    docs = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    got = {x.vec_id: x for x in capfilters.near_vectors(docs).collect()}
    want = near.sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum() and want.sum() > 50
    assert all(got[i].component_id == i - 60 for i in range(60, 65)) and all(got[i].n_links == 0 and got[i].kept for i in (200, 201, 202, 203, None, 204, 205))
    assert got[206].n_links == got[207].n_links == 1 and got[207].component_id == 206
    assert capfilters.near_vectors(docs.limit(0)).count() == 0


def test_vectors_of_crowded_filters(spark, monkeypatch):
    """Groups of near copies with many links near the cut, over several tiles; links are those of all pairs."""
    from sparkloom.llm import capfilters

    monkeypatch.setattr(capfilters, "SHARE", 7)
    test_vectors_against_all_pairs(spark)
    r = np.random.default_rng(9)
    base = r.standard_normal((6, 32))
    x = np.vstack([b + s * r.standard_normal((30, 32)) for b in base for s in (0.15, 0.27, 0.3)]).astype(np.float32)
    x[5] = x[6]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    cos = u @ u.T
    near, want = cos >= 0.93, (cos >= 0.93).sum(axis=1) - 1
    docs = spark.createDataFrame([(i, v, "a") for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label string")
    got = {r.vec_id: r for r in capfilters.near_vectors(docs).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() and want.sum() > 1000 and ((cos > 0.93) & (cos < 0.95)).sum() > 300
    group = np.arange(len(x))
    for _ in x:
        group = np.array([group[n].min() for n in near])
    assert np.mean([got[i].component_id == group[i] for i in range(len(x))]) > 0.99


def test_vectors_of_many_lengths(spark, monkeypatch):
    from sparkloom.llm import capfilters

    monkeypatch.setattr(capfilters, "CODES", 2)
    rows = [(3 * n + i, ([1.0] * n if i < 2 else [1.0, -1.0] * (n // 2) + [1.0] * (n % 2)), 0) for n in range(2, 9) for i in range(3)]
    got = {r.vec_id: r.n_links for r in capfilters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[3 * n + i] == (i < 2) for n in range(2, 9) for i in range(3))


def test_vectors_of_one_large_label(spark):
    from sparkloom.llm import capfilters

    r = np.random.default_rng(7)
    n, pairs = 20_000, 600
    x = r.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = r.standard_normal((pairs, 64))
    g -= (g * x[:pairs]).sum(axis=1)[:, None] * x[:pairs]
    x[-pairs:] = 0.932 * x[:pairs] + np.sqrt(1 - 0.932**2) * g / np.linalg.norm(g, axis=1)[:, None]
    x = x.astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = sum(int((u[i : i + 1000] @ u.T >= 0.93).sum()) for i in range(0, n, 1000)) - n
    docs = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    found = capfilters.near_vectors(docs).agg({"n_links": "sum"}).first()[0]
    assert want >= 2 * pairs and 0.99 * want <= found <= want


@pytest.mark.parametrize("dim, n", [(1, 50), (2, 100_000), (3, 1000), (16, 10**6), (64, 3 * 10**6)])
def test_codes_meet_close_pairs(dim, n):
    from sparkloom.llm.capfilters import Code

    r = np.random.default_rng(8)
    u, g = (x / np.linalg.norm(x, axis=1)[:, None] for x in r.standard_normal((2, 1000, dim)))
    g -= (g * u).sum(axis=1)[:, None] * u
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * g / np.linalg.norm(g, axis=1)[:, None] if dim > 1 else u
    code = Code.of(dim, n)
    met = [len(set(a) & set(b)) > 0 for a, b in zip(code.decode(u).tolist(), code.decode(v).tolist())]
    assert np.mean(met) >= 0.99


def test_components_of_a_long_path(spark):
    from sparkloom.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_mixture_targets_and_copies(spark):
    from sparkloom.llm import mixing

    r = random.Random(8)
    sizes = {"a": 400, "b": 40, "c": 90, None: 60, "d": 5}
    rows = [(s, r.randint(0, 30)) for s, n in sizes.items() for _ in range(n)]
    docs = frame(spark, ["w " * n if n else None for _, n in rows], sources=[s for s, _ in rows])
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(x.doc_id for x in got) == list(range(len(rows)))
    names = sorted([s for s in sizes if s], key=str) + [None]
    size = {s: sum(x.size for x in got if x.source == s) for s in names}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    free = set(names)
    while True:
        rest = 1.5 * sum(size.values()) - sum(2.0 * size[s] for s in names if s not in free)
        over = {s for s in free if rest * weight[s] / sum(weight[f] for f in free) > 2 * size[s]}
        if not over:
            break
        free -= over
    for s in names:
        mine = [x for x in got if x.source == s]
        target = rest * weight[s] / sum(weight[f] for f in free) if s in free else 2.0 * size[s]
        assert all(abs(x.target - target) < 1e-6 and x.source_size == size[s] for x in mine)
        assert abs(sum(x.taken for x in mine) - target) <= 15 and all(x.taken in (0, x.size, 2 * x.size) for x in mine)
    again = {x.doc_id: x.taken for x in mixing.mix(docs.repartition(7)).collect()}
    assert again == {x.doc_id: x.taken for x in got}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and out.count() == sum(x.copies for x in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(frame(spark, [None, ""])).agg({"taken": "sum"}).first()[0] == 0


def test_mixture_of_rows_that_tie(spark):
    """Rows of one id (or none) and one text share a rank; as many of them are taken as the target leaves room for."""
    from sparkloom.llm import mixing

    r = random.Random(4)
    rows = [("a", "w " * r.randint(1, 30), i) for i in range(150)] + [("b", "w " * r.randint(1, 30), 500 + i) for i in range(150)]
    rows += [("c", "v " * 10, None)] * 230 + [("d", "x " * 7, 9)] * 101 + [("e", f"x{i} " * 10, None) for i in range(90)]
    got = mixing.mix(frame(spark, [t for _, t, _ in rows], sources=[s for s, _, _ in rows], ids=[i for _, _, i in rows])).collect()
    assert len(got) == len(rows)
    for s in "abcde":
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= max(x.size for x in mine) / 2 and all(x.copies in (0, 1, 2) for x in mine)
        rest = mine[0].target - mine[0].source_size * (mine[0].target // mine[0].source_size)
        assert abs(sum(x.inclusion * x.size for x in mine) - rest) < 1e-6 * max(1, rest)  # expected words are the remainder
        assert any(0 < x.inclusion < 1 for x in mine) == (rest > 0)


def test_inclusion_probabilities_hold(spark):
    """Over many seeds a document is taken about as often as its inclusion probability says, large ones more often."""
    from sparkloom.llm import mixing

    sizes = [1] * 30 + [5] * 30 + [40] * 10 + [400]
    docs = frame(spark, [f"d{i} " * n for i, n in enumerate(sizes)], sources=["a"] * len(sizes)).coalesce(1).cache()
    runs = [{x.doc_id: x for x in mixing.mix(docs, share=0.9, cap=2.0, seed=s).collect()} for s in range(12)]
    p = np.array([runs[0][i].inclusion for i in range(len(sizes))])
    often = np.mean([[x[i].copies for i in range(len(sizes))] for x in runs], axis=0)
    assert p[-1] == 1.0 and often[-1] == 1.0
    for a, z in ((0, 30), (30, 60), (60, 70)):
        assert abs(often[a:z].mean() - p[a:z].mean()) < 0.12


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(120)
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, d).collect(), stage(spark, docs, d).schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.count() > 0
        if name in ("language", "near_copies", "repeats"):
            assert docs.count() <= n
            n = docs.count()
    assert docs.agg({"length": "sum"}).first()[0] > 0
