"""Language, toxicity's machine and each stage of the pipeline against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_groups import SCHEMA, covered, frame

P = pytest.importorskip("public_tokenizers")


def grams(text: str) -> list[str]:
    """The 1- to 3-grams of padded words, by counts and then by code points; gaps are code point 1."""
    line = "\x01" + "\x01".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + "\x01"
    found = Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1))
    code = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    found = {g: n for g, n in found.items() if g != "\x01" and not (len(g) == 3 and g[1] == "\x01")}
    return [(g, -n) for n, _, g in sorted((-n, code(g), g) for g, n in found.items())]


def plain_profiles(docs, size: int = 400) -> dict[str, list[str]]:
    from sparkloom.llm.common import is_held_out

    total: dict[str, Counter] = {}
    for d in docs:
        if d.lang is not None and d.text is not None and not is_held_out(d.doc_id):
            for g, n in grams(d.text):
                total.setdefault(d.lang, Counter())[g] -= n
    code = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    return {k: [g for _, _, g in sorted((n, code(g), g) for g, n in c.items())[:size]] for k, c in total.items()}


def plain_language(text: str | None, profiles: dict[str, list[str]], size: int = 400) -> tuple[str, float]:
    top = [g for g, _ in grams(text or "")][:size]
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    best = []
    for lang in sorted(profiles):
        place = {g: i for i, g in enumerate(profiles[lang])}
        best.append((sum(abs(place[g] - i) if g in place else size for i, g in enumerate(top)), lang))
    away, lang = min(best)
    return lang, 1 - away / (size * len(top))


def test_language_against_plain_python(spark):
    from sparkloom.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    profiles = plain_profiles(rows)
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    for r in rows:
        lang, score = plain_language(r.text, profiles)
        assert (got[r.doc_id].lang_pred, round(got[r.doc_id].score, 9)) == (lang, round(score, 9))


def test_languages_without_bound(spark):
    from sparkloom.llm import langid

    rows = [(i, f"{chr(0x4E00 + i % 501)} a{chr(0x4E00 + i % 501)}", f"l{i % 501}", "s", 1, "k", "d", "a") for i in range(12 * 501)]
    docs = spark.createDataFrame(rows, SCHEMA)
    p = langid.learn(docs)
    assert len(p.languages) == 501
    assert all(r.lang_pred == r.lang for r in langid.identify(docs, p).limit(50).collect())


def test_machine_against_its_parts():
    """The composed table gives what the three transducers give one beside the other, on random clauses."""
    from sparkloom.llm import toxicity as tox

    after, factor = tox.grammar()
    r = random.Random(1)
    for _ in range(300):
        kinds = [r.randrange(6) for _ in range(r.randint(1, 25))]
        marks = tox.marks(kinds)
        assert marks == [tox.TARGET in kinds[i + 1 : i + 1 + tox.AIMED] for i in range(len(kinds))]
        state, states = 0, [0, 0, 0]
        for k, m in zip(kinds, marks):
            steps = [t.step(s, k, m) for t, s in zip(tox.scopes(), states)]
            assert factor[state][k + 6 * m] == pytest.approx(np.prod([f for _, f in steps]))
            state, states = after[state][k + 6 * m], [s for s, _ in steps]


def test_toxicity_weights_rows(spark):
    """Drawn rows stand for all: with few toxic rows among many the constant follows the true share, not the sample's."""
    from sparkloom.llm import toxicity

    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 1, 400), r.normal(1, 1, 400)])[:, None]
    y = np.repeat([0.0, 1.0], 400)
    flat, weighted = toxicity.fit_logistic(x, y), toxicity.fit_logistic(x, y, np.where(y == 1, 0.1, 1.9))
    assert weighted[0] < flat[0] - 1.5 and abs(weighted[1] - flat[1]) < 0.5


def test_threats_targets_and_scopes_are_learned(spark):
    """Words of each class that no seed list has, from labelled texts in which they make the difference."""
    from sparkloom.llm import toxicity

    r = random.Random(3)
    rest = lambda: " ".join(f"{c}{c}w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for c in "mnopq")
    rows, labels = [], []
    for i in range(4800):
        text = "zorgan vosso" if i % 6 < 2 else "grunfel them" if i % 6 == 2 else "nixo zorgan here" if i % 180 == 5 else "plain tale"
        rows.append((i, f"{rest()}. {text}. {rest()}"))
        labels.append((i, int(i % 6 < 3)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, lab)
    assert model.kinds["nixo"] == toxicity.NEGATION and model.kinds["grunfel"] == toxicity.THREAT
    assert model.features("nixo zorgan")[0] < 0.5 * model.features("zorgan")[0]


# --- the pipeline's stages, each on its own input ----------------------------------------------


def words_of(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(21)
    base = [x.asDict() for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000").orderBy("doc_id").limit(70).collect()]
    rows, n = [], 1000
    for d in base:
        rows.append(d)
        words = (d["text"] or "").split()
        if len(words) > 80:
            near = list(words)
            near[r.randrange(len(near))] = "edited"
            rows += [dict(d, doc_id=n, text=" ".join(near)), dict(d, doc_id=n + 1, text="Fresh words ahead. " + " ".join(words[10:75]) + f" and words behind {n}. " * 30)]
            n += 2
    rows += [dict(base[0], doc_id=n, text=t) for n, t in enumerate([None, "", "123 456", "qqqq xxzz kkjj wwpp vvbb", "xkq zvb jjw qpp mnb vcx zzl ktr pql wsx " * 8], 3000)]
    return spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema).repartition(3).cache()


def stage(name):
    pipeline = pytest.importorskip("corpus_pipeline")
    return dict(pipeline.STAGES)[name]


def test_language_stage(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = docs.collect()
    profiles = plain_profiles(rows)
    kept = {r.doc_id for r in rows if (p := plain_language(r.text, profiles))[0] != "und" and p[1] >= pipeline.LEAST_LANGUAGE}
    out = stage("language")(spark, docs, "")
    assert {r.doc_id for r in out.collect()} == kept and out.columns == docs.columns
    assert not kept & set(range(3000, 3005)) and len(kept) >= len(rows) - 6


def test_near_copies_stage(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    sets = []
    for r in rows:
        w = [x.lower() for x in words_of(r.text)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in range(20):
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    got = stage("near_copies")(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == [r.doc_id for i, r in enumerate(rows) if group[i] == i] and len(pairs) > 20


def test_repeats_stage(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    seqs = [words_of(r.text) for r in rows]
    want = {}
    for r, s, g in zip(rows, seqs, covered(seqs, [r.doc_id for r in rows], 50)):
        left = b" ".join(w for w, x in zip(s, g) if not x).decode()
        if not g.any():
            want[r.doc_id] = r.text
        elif left:
            want[r.doc_id] = left
    got = {r.doc_id: r.text for r in stage("repeats")(spark, docs, "").collect()}
    assert got == want and len(want) < len(rows) and sum(want[i] != r.text for r in rows if (i := r.doc_id) in want) > 10


def test_mixture_stage(spark, docs):
    """The whole sampling in plain Python: targets by water filling, inclusion probabilities, ranks, cuts."""
    rows = docs.collect()
    size = {r.doc_id: len(words_of(r.text)) for r in rows}
    names = sorted({r.source for r in rows if r.source is not None}) + ([None] if any(r.source is None for r in rows) else [])
    total = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in names}
    weight, free = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}, set(names)
    while True:
        rest = 1.5 * sum(total.values()) - sum(2.0 * total[s] for s in names if s not in free)
        over = {s for s in free if rest * weight[s] / sum(weight[f] for f in free) > 2 * total[s]}
        if not over:
            break
        free -= over
    want: Counter = Counter()
    for s in names:
        target = rest * weight[s] / sum(weight[f] for f in free) if s in free else 2.0 * total[s]
        certain = int(target // total[s]) if total[s] else 0
        left = target - certain * total[s]
        mine = [r for r in rows if r.source == s and size[r.doc_id]]
        for r in (r for r in rows if r.source == s):
            want[r.doc_id] += certain
        if left <= 0:
            continue
        lo, hi = 0.0, 1e9
        for _ in range(200):  # the rate at which the expected words are the remainder
            rate = (lo + hi) / 2
            lo, hi = (rate, hi) if sum(min(1.0, rate * size[r.doc_id] ** 0.5) * size[r.doc_id] for r in mine) < left else (lo, rate)
        ranked = []
        for r in mine:
            u = (int(hashlib.md5(f"7:{r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            p = min(1.0, rate * size[r.doc_id] ** 0.5)
            ranked.append((u / (1 - u) * (1 - p) / p if p < 1 - 1e-9 else 0.0, r.doc_id))
        taken = 0
        for _, i in sorted(ranked):
            if taken + size[i] / 2 > left:
                break
            want[i] += 1
            taken += size[i]
    got = Counter(r.doc_id for r in stage("mixture")(spark, docs, "").collect())
    assert got == +want


def test_sequences_stage(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = stage("sequences")(spark, docs, "").collect()
    lanes, ids = {}, {}
    for p in pieces:
        lanes.setdefault(p.sequence_id, []).append((p.offset, p.length))
        ids.setdefault(p.doc_id, []).append((p.start, np.frombuffer(bytes(p.ids), "<u4").tolist()))
    for n, lane in lanes.items():
        lane.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(lane, lane[1:])) and lane[0][0] == 0 and (sum(k for _, k in lane) == 2048 or n == max(lanes))
    for r in docs.collect():
        assert [x for _, part in sorted(ids[r.doc_id]) for x in part] == tok.encode(r.text or "", add_special_tokens=False).ids + [1]


def test_stages_pass_columns_of_any_name_and_empty_tables(spark, docs):
    from pyspark.sql import functions as F

    pipeline = pytest.importorskip("corpus_pipeline")
    names = ("score", "lang_pred", "found", "row", "key", "size", "copies", "target", "rank", "p", "k", "text_", "root")
    wide = docs.limit(30).withColumns({n: F.lit(f"own {n}") for n in names}).cache()
    for _, f in pipeline.STAGES[:-1]:
        out = f(spark, wide, "")
        assert out.columns == wide.columns and all(r[n] == f"own {n}" for r in out.collect() for n in names)
        assert f(spark, wide.limit(0), "").count() == 0
    assert pipeline.STAGES[-1][1](spark, wide.limit(0), "").count() == 0


def test_run_is_its_stages(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for name, f in pipeline.STAGES:
        out = f(spark, now, str(tmp_path))
        now = spark.createDataFrame(out.collect(), out.schema)
    whole = pipeline.run(spark, str(tmp_path))
    text = lambda df: sorted((r.doc_id, r.start, bytes(r.ids)) for r in df.where("start = 0").collect())
    count = lambda df: Counter(i for i, _, _ in text(df))
    assert count(whole) == count(now) and whole.agg({"length": "sum"}).first() == now.agg({"length": "sum"}).first()
