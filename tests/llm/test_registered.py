"""The registered queries themselves, over a small folder with awkward rows, and plain twins of what has no SQL."""

import cmath
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import language, media, queries, tokens

from .tables import SCHEMA, rows

LONG_IDS = [r for r in rows() if r[0] is not None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    # One id and text in two sources, and a whole row again.
    more = [(8000, rows()[0][1], "en", "s1", 3, *rows()[0][5:]), (8000, rows()[0][1], "en", "s9", 3, *rows()[0][5:]), rows()[3]]
    spark.createDataFrame(rows() + more, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], i % 2, int(i % 3 == 0)) for i, r in enumerate(LONG_IDS)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows() + more


def ids(found):
    return collections.Counter(r.doc_id for r in found)


def test_fingerprints(spark, folder):
    d, some = folder
    got = queries.QUERIES["op1_weighted_samples"](spark, d).collect()
    assert ids(got) == collections.Counter(r[0] for r in some)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_chars, r.fingerprint))
    for i in {r[0] for r in some}:
        assert {n for n, _ in by[i]} == {len(r[1] or "") for r in some if r[0] == i}
    assert by[0] <= by[1] | by[0] and {f for _, f in by[0]} == {f for _, f in by[1]}  # equal texts
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.edited_sha256) == 64 for r in got)


def test_shards(spark, folder):
    d, some = folder
    got = queries.QUERIES["op2_feistel_shards"](spark, d).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in some)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and {r.law for r in got} == {"rows"}


def test_toxicity(spark, folder):
    d, some = folder
    got = queries.QUERIES["op3_nearest_examples"](spark, d).collect()
    assert ids(got) == collections.Counter(r[0] for r in some)
    known = {r[0] for r in LONG_IDS if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and set(r.evidence) <= known


def brute_pieces(text, capacity=2048):
    n = len(tokens.document_ids(text)) // 4
    return [(k, a, b, zlib.crc32(tokens.document_ids(text)[4 * a : 4 * (a + b)])) for k, (a, b) in enumerate(tokens.cuts(n, capacity))]


@pytest.mark.parametrize("name", ["op4_configuration_packing", "op10_packed_matrix"])
def test_packing(spark, folder, name):
    d, some = folder
    got = queries.QUERIES[name](spark, d).collect()
    want = collections.Counter((r[0], *p) for r in some for p in brute_pieces(r[1]))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    full = collections.defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == list(ends[:-1]) and ends[-1] <= 2048


def brute_landmarks(payload):
    """Peaks and pairs by the definition: a plain transform of each frame, and neighbours one by one."""
    x = [b - 128 for b in payload] + [0] * 64
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * k / 127) for k in range(128)]
    loudest = []
    for at in range(0, len(payload), 64):
        frame = [a * h for a, h in zip(x[at : at + 128], hann, strict=True)]
        power = [math.log1p(abs(sum(v * cmath.exp(-2j * math.pi * k * n / 128) for n, v in enumerate(frame)))) for k in range(1, 65)]
        loudest.append((max(power), power.index(max(power))))
    peaks = [i for i, (p, _) in enumerate(loudest) if p > 1e-6 and all(p >= loudest[j][0] - 1e-6 for j in (i - 1, i + 1) if 0 <= j < len(loudest))]
    pairs = [(peaks[a], (loudest[peaks[a]][1] << 12) | (loudest[peaks[a + k]][1] << 6) | (peaks[a + k] - peaks[a])) for k in (1, 2, 3) for a in range(len(peaks) - k) if peaks[a + k] - peaks[a] <= 63]
    return sorted(pairs)


def test_landmarks(spark, folder):
    d, some = folder
    got = {r.doc_id: r for r in queries.QUERIES["op6_wav_landmarks"](spark, d).collect()}
    assert set(got) == {r[0] for r in some}
    for i, text in [(r[0], (r[1] or "").encode()) for r in some[:8] if r[0] is not None and len(r[1] or "") < 3000]:
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        pairs = brute_landmarks(payload)
        arrays = ",".join(str(t) for t, _ in pairs), ",".join(str(c) for _, c in pairs)
        assert got[i].n_landmarks == len(pairs) and got[i].feature == f"{len(pairs)}:{hashlib.sha256(';'.join(arrays).encode()).hexdigest()}"
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[i].media_sha256 == hashlib.sha256(media.wav_of(payload)).hexdigest()


def brute_prediction(model, text):
    """The mean of the table rows of every run of 1 to 4 bytes of a word with the gaps beside it."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    total, n = np.zeros(len(model.languages)), 0
    for k, word in enumerate(re.findall(r"[^\W\d_]+", text.lower())):
        b = b" " + word.encode() + b" "
        for size in (1, 2, 3, 4):
            for at in range(len(b) - size + 1):
                gram = b[at : at + size]
                # A lone gap, or one at both ends, is no subword.
                if gram == b" " or (size > 1 and gram[0] == gram[-1] == 32) or b" " in gram[1:-1]:
                    continue
                code = 0
                for x in gram:
                    code = (code * 0x100000001B3 + x + 1) % 2**64
                row = (((code + size) * 0x9E3779B97F4A7C15) % 2**64) >> 49
                total += model.table[row]
                n += 1
    z = ((total / n if n else total) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return model.languages[int(p.argmax())], float(p.max() / p.sum())


def test_predictions(spark, folder):
    d, some = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = language.learned(docs, language.held_out(docs["doc_id"], 5) != 0)
    for text in [r[1] for r in some] + ["straße ÉTÉ x1y_z", "a " * 9000]:
        lang, score = brute_prediction(model, text)
        got = model.predict(text)
        assert got[0] == lang and got[1] == pytest.approx(score, abs=1e-5)
    got = queries.QUERIES["op7_language_id"](spark, d).collect()
    assert ids(got) == collections.Counter(r[0] for r in some)


def test_the_whole_pipeline(spark, folder):
    d, some = folder
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted({r.position for r in got}) == list(range(len({r.position for r in got})))
    passes = collections.defaultdict(set)
    for r in got:
        passes[r.doc_id].add(r["pass"])
    assert all(p == set(range(len(p))) for p in passes.values())
    assert {r.doc_id for r in got} <= {r[0] for r in some}
