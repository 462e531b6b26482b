"""Operators 1, 2, 3 and 7 against plain implementations and libraries."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gnosia.llm import bpe, fingerprint, licenses, textvec, tokencount
from gnosia.llm.queries import vocabulary

WORD = re.compile("[^\x20\x09-\x0d]+")
EDGE = ["", "  \n\t", "a", "Ünï çödé 🙂 x", "w " * 70_000 + "end", "<|endoftext|> b<|endoftext|>", "it's we'll 123,456!\x1c\u3000中文 Σίσυφος İ ﬁ ²", "same text here", "same text here", "a\x00b \x85 c"]


def texts(n=300, seed=1):
    rng = random.Random(seed)
    letters = "abcdeéßñ .,!'\n\t 0123456789ABC🙂中"
    return EDGE + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "x", "keep") for i, t in enumerate(texts(60))] + [(None, None, None, None), (3, None, "x", "keep"), (0, "", "x", "keep")]
    return spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string, fingerprint string")


def test_xxh64():
    spans = [bytes(range(65, 65 + n % 60)) * (1 + n // 60) for n in range(150)]
    buf = np.frombuffer(b"".join(spans), np.uint8)
    lens = np.array([len(s) for s in spans])
    got = textvec.xxh64(buf, np.cumsum(lens) - lens, lens, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(s, 42) for s in spans]


def test_words():
    buf, offs = textvec.raw(pa.array(EDGE))
    starts, lens, ptr = textvec.words(buf, offs)
    got = [[bytes(buf[a : a + n]).decode() for a, n in zip(starts[i:j], lens[i:j])] for i, j in zip(ptr, ptr[1:])]
    assert got == [WORD.findall(t) for t in EDGE]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_equals_library(name):
    from tokenizers import Tokenizer

    source = open(vocabulary(name), encoding="utf-8").read()
    lib, own = Tokenizer.from_str(source), bpe.model(source)
    sample = texts(1500) + ["a" * 3000, "ab" * 400, " " * 300]
    ids, ends = own.encode(sample)
    for i, t in enumerate(sample):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids[ends[i] : ends[i + 1]].tolist() == want, t[:80]
        if name.startswith("byte"):
            assert own.decode(ids[ends[i] : ends[i + 1]]) == lib.decode(want, skip_special_tokens=False) == t


def test_bpe_pair_check_is_exact():
    """A pair is compatible if and only if merging its bytes gives the pair again."""
    own = bpe.model(open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read())
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50_000, 3000), rng.integers(0, 3000, 3000)
    ok = own.compatible(a, b)
    want = [own.exact(own.bytes[x] + own.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert ok.tolist() == want and not all(want) and any(want)


def test_bpe_operator(spark, docs):
    got = bpe.encode(docs, vocabulary("byte_bpe_50k.json"), outputs=("n_tokens", "ids", "decoded"))
    assert [c for c in got.columns] == ["doc_id", "text", "fingerprint", "n_tokens", "ids", "decoded"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.decoded == (r.text or "") and len(r.ids) == 4 * r.n_tokens
    back = bpe.decode(got.select("doc_id", "text", "ids"), vocabulary("byte_bpe_50k.json"), into="again").collect()
    assert all(r.again == (r.text or "") for r in back)
    assert bpe.encode(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def shingles(t):
    w = WORD.findall(t)
    return {tuple(w[i : i + 5]) for i in range(max(min(1, len(w)), len(w) - 4))}


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_sketch_is_exact_while_small():
    sample = texts(200)
    s = fingerprint.sketches(pa.array(sample))
    for i in range(len(sample) - 1):
        a, b = shingles(sample[i]), shingles(sample[i + 1])
        if len(a | b) <= fingerprint.K:
            assert fingerprint.resemblance(s[i], s[i + 1]) == pytest.approx(likeness(a, b))
        if len(a) < fingerprint.K:
            assert fingerprint.distinct_count(s[i]) == len(a)


def test_sketch_estimates_and_merges():
    rng = random.Random(0)
    w = [f"w{rng.randint(0, 10**6)}" for _ in range(9000)]
    whole, part = " ".join(w), " ".join(w[:6000])
    a, b = fingerprint.sketches(pa.array([whole, part]))
    assert fingerprint.resemblance(a, b) == pytest.approx(2 / 3, abs=0.15)
    assert fingerprint.containment(b, a) == pytest.approx(1, abs=0.15)
    assert fingerprint.distinct_count(a) == pytest.approx(8996, rel=0.3)
    left, right = fingerprint.sketches(pa.array([" ".join(w[:5000]), " ".join(w[4996:])]))
    assert fingerprint.merge(left, right).tolist() == a.tolist()
    assert fingerprint.from_string(fingerprint.as_string(a)).tolist() == a.tolist()
    # many repeats of few shingles among many words
    t = " ".join(["x y z"] * 3000 + w[:40])
    assert len(fingerprint.sketches(pa.array([t]))[0]) == len(shingles(t))


@pytest.mark.parametrize("parts", [1, 7])
def test_compare_with_next(spark, parts):
    sample = texts(80)
    rows = [(i * 3, t) for i, t in enumerate(sample)] + [(9, None), (30, "same text here")]
    got = fingerprint.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), parts=parts).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], [-ord(c) for c in r[1]] + [1]))
    order.sort(key=lambda r: r[0], reverse=True)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    ids = [i for i, _ in order]
    for k, (i, t) in enumerate(order):
        if ids.count(i) > 1 or ids.count(order[(k + 1) % len(order)][0]) > 1:
            continue
        nxt = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = by_id[i][0]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if len(shingles(t) | shingles(edited) | shingles(nxt)) <= fingerprint.K:
            assert r.near_edited == pytest.approx(likeness(shingles(t), shingles(edited)))
            assert r.near_next == pytest.approx(likeness(shingles(t), shingles(nxt)))
    assert fingerprint.compare_with_next(spark.createDataFrame([], "doc_id long, text string"), parts=parts).count() == 0


def test_fingerprint_operator(spark, docs):
    rows = fingerprint.fingerprint(docs).collect()
    assert len(rows) == docs.count()
    same = {r.fingerprint for r in rows if r.text == "same text here"}
    assert len(same) == 1 and {r.fingerprint for r in rows if not r.text} == {""}


def test_licenses(spark):
    mit = dict((n, t) for n, t in licenses.KNOWN if len(t) > 500)["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,")), (2, "text\nLicensed  under the apache LICENCE -- version 2.0\nmore"), (3, None), (4, ""), (5, "no licence at all"),
        (6, mit.replace("sublicense", "sub-licence")), (6, "Licensed under CC BY 4.0."), (None, "SPDX-License-Identifier: MIT"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, LICENSE string")
    got = licenses.scan(df)
    assert got.columns == ["doc_id", "text", "canonical_sha256", "license", "notices"]
    by = {(r.doc_id, (r.text or "")[:8]): r for r in got.collect()}
    assert len(by) == len(rows)
    assert by[1, "Copyrigh"].license == "MIT" and by[6, mit[:8]].license == "MIT"
    assert by[2, "text\nLic"].notices == "Apache-2.0" and by[2, "text\nLic"].license is None
    assert by[None, "SPDX-Lic"].license == "MIT" and by[None, "SPDX-Lic"].notices == "MIT"
    assert by[3, ""].license is None and by[3, ""].notices is None and by[5, "no licen"].notices is None
    assert by[6, "Licensed"].license == "CC-BY-4.0"
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_of_whole_texts(spark, tmp_path):
    """Every known text, titled, reworded and with its copyright lines, and the notices; rows that share a doc_id or have none. The SQL agrees."""
    import pathlib

    import duckdb

    rows, want = [], []
    for k, (name, text) in enumerate(licenses.KNOWN):
        other = text.upper().replace(" ", "  ").replace("LICENSE", "LICENCE") if "\n" in text else text.replace("Licensed under", ["Released under", "Distributed under", "This work is licensed under the terms of"][k % 3]).replace("the terms of CC", "CC").replace("SPDX", "// SPDX")
        rows.append((7, "Copyright 2001 Some One\nAll rights reserved.\n" + other))
        want.append(name)
    shared = pathlib.Path("/usr/share/common-licenses")
    for file, name in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("LGPL-2.1", "LGPL-2.1")):
        if (shared / file).exists():
            rows.append((None, (shared / file).read_text() + " \n\n"))
            want.append(name)
    rows += [(8, "words\nReleased under the MIT License.\nwords\nSPDX-License-Identifier: ISC"), (8, "words"), (None, "words"), (None, None), (None, "words")]
    want += [None] * 5
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int, `key` string")
    got = {r.k: r for r in licenses.scan(df).collect()}
    assert [got[k].license for k in range(len(rows))] == want
    assert [got[k].notices for k in range(len(rows) - 5, len(rows))] == ["ISC,MIT", None, None, None, None] and got[0]["key"] == "x"
    con = duckdb.connect()
    frame = df.select(F.col("k").cast("long").alias("doc_id"), "text").toPandas()
    con.register("documents", frame)
    assert {*con.execute(licenses.oracle()).fetchall()} == {(k, r.canonical_sha256, r.license, r.notices) for k, r in got.items()}


def brute(table, word):
    """Viterbi for one pre-token, without any sharing."""
    score, unknown = dict(table), min(s for _, s in table) - tokencount.UNKNOWN_PENALTY
    w = tokencount.MARK + word
    best, count = [0.0], [0]
    for end in range(1, len(w) + 1):
        options = [(best[at] + score[w[at:end]], -at, count[at] + 1) for at in range(end) if w[at:end] in score]
        options.append((best[end - 1] + unknown, 1 - end - 0.5, count[end - 1] + len(w[end - 1].encode())))
        top = max(options)
        best.append(top[0])
        count.append(top[2])
    return count[-1]


def test_token_counts(spark, docs):
    table = tokencount.pieces(vocabulary("piece_bpe_32k.model"))
    words = sorted({w for t in texts(300) for w in WORD.findall(t)}) + ["\ue000\ue001x", "hello", "helloworld"]
    assert tokencount.Counter(table).counts(words).tolist() == [brute(table, w) for w in words]
    from tokenizers import Tokenizer, models, pre_tokenizers

    lib = Tokenizer(models.Unigram([("<unk>", -100.0), *table, *[(f"<0x{i:02X}>", -1000.0) for i in range(256)]], 0, True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace()
    plain = [w for w in words if w.isalpha()]
    assert tokencount.Counter(table).counts(plain).tolist() == [len(lib.encode(w, add_special_tokens=False).ids) for w in plain]
    rows = tokencount.count_tokens(docs, table).collect()
    assert len(rows) == docs.count()
    memo = tokencount.Counter(table)
    for r in rows:
        w = WORD.findall(r.text or "")
        assert (r.n_words, r.n_tokens) == (len(w), int(memo.counts(w).sum()) if w else 0)
