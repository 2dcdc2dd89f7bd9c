import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language_id as m

SF = "/root/testdata/sf0.01"


def naive_strings(texts):
    """Counts of all strings of up to ORDER + 1 symbols, as tuples."""
    out = {}
    for t in texts:
        s = [int(v) for v in m.SYMBOLS[np.frombuffer(t, "u1")]]
        for k in range(1, m.ORDER + 2):
            for i in range(len(s) - k + 1):
                out[tuple(s[i : i + k])] = out.get(tuple(s[i : i + k]), 0) + 1
    return out


def naive_bits(own, alphabet, text):
    """Code length by the definition: escapes from the longest known context, then the symbol's share."""
    s = [int(v) for v in m.SYMBOLS[np.frombuffer(text, "u1")]]
    children = {}
    for k, n in own.items():
        children.setdefault(k[:-1], {})[k[-1]] = n
    bits = 0.0
    for i, symbol in enumerate(s):
        contexts = [tuple(s[i - k : i]) for k in range(min(i, m.ORDER), -1, -1)]
        for c in (c for c in contexts if c == () or c in own):
            kept = children.get(c, {})
            total = sum(kept.values()) if c == () else max(own[c], sum(kept.values()))
            if symbol in kept:
                bits -= math.log2(kept[symbol] / (total + len(kept)))
                break
            if kept:
                bits -= math.log2((total - sum(kept.values()) + len(kept)) / (total + len(kept)))
        else:
            bits += math.log2(alphabet + 1)
    return bits


def packed(strings):
    return {sum(v << 8 * (len(k) - 1 - i) for i, v in enumerate(k)): n for k, n in strings.items()}


def test_strings_against_counting():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab é.", k=rng.randint(0, 40))).encode() for _ in range(30)]
    keys, n = m.strings(m.symbols(texts)[0], m.ORDER + 1)
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == packed(naive_strings(texts))


@pytest.mark.parametrize("least, columns", [(1, 512), (3, 7)])
def test_code_lengths_against_the_definition(least, columns, monkeypatch):
    monkeypatch.setattr(m, "COLUMNS", columns)
    rng = random.Random(4)
    make = lambda letters: ["".join(rng.choices(letters, k=rng.randint(1, 60))).encode() for _ in range(25)]
    trees = {}
    for lang, letters in (("aa", "aab bc."), ("bb", "bcc dé "), ("cc", "xyz")):
        kept = {k: n for k, n in naive_strings(make(letters)).items() if n >= least}
        trees[lang] = m._closed(packed(kept))
    model = m.trained(trees, {"aa": 5, "bb": 1, "cc": 2})
    opened = {lang: {tuple(k.to_bytes((k.bit_length() + 7) // 8, "big")): n for k, n in own.items()} for lang, own in trees.items()}
    alphabet = len({k[-1] for own in opened.values() for k in own})
    texts = [*make("abcdé xyzq9Z"), b"", b"a", "Ab. CÉ".encode(), b"aab bc aab bc" * 9]
    got = m.lengths(model, texts)
    for text, row in zip(texts, got, strict=True):
        for lang, bits, prior in zip(model.languages, row, model.prior, strict=True):
            assert bits == pytest.approx(naive_bits(opened[lang], alphabet, text) + prior, abs=1e-6)
    monkeypatch.setattr(m, "SLICE", 5)
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(m.long_length(model, text), row, atol=1e-6)


def test_a_symbols_costs_make_a_code():
    """After any known history the shares of all symbols sum to at most one."""
    kept = m._closed(packed(naive_strings([b"abracadabra abracadabra", b"a cab a bad crab"])))
    model = m.trained({"x": kept}, {"x": 1})
    seen = [s for s in range(1, 256) if model.classes[s] > 1] + [250]
    for history in (b"", b"a", b"abr", b"zz", b"bra a"):
        data = np.concatenate(([0], m.SYMBOLS[np.frombuffer(history, "u1")])).astype("u1")
        state = m.walk(model, data)[-1]
        after = model.step[state][model.classes[seen]]
        bits = model.ahead[0][state] + model.cost[0][after] - model.ahead[0][after]
        assert np.exp2(-bits).sum() <= 1 + 1e-9 and bits.min() > 0


def test_held_out_accuracy(spark):
    got = m.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(out) > 100 and np.mean([r.lang_pred == r.lang for r in out]) > 0.98
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in got)


def test_edges(spark):
    rows = [(k, "der hund und die katze " * 5, "de", 1) for k in range(20)] + [(100 + k, "the dog and the cat " * 5, "en", 2) for k in range(20)]
    odd = [(200, None, "en", 3), (201, "", "de", 3), (202, "12 ²½ -- !", None, 3), (None, "the cat", None, 3), (203, "the dog " * 600_000, None, 3), (203, "Katze", None, 3), (204, "жук", "en", 3)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")
    model = m.fit(docs)
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in m.predicted(docs, model).collect() if r.doc_id is None or r.doc_id >= 200}
    assert {g for g in got if g[0] != 204} == {(200, "und", False), (201, "und", False), (202, "und", False), (None, "en", True), (203, "en", True), (203, "de", True)}
    assert m.predicted(docs.limit(0), model).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert m.fit(nothing) is None
    assert {r.lang_pred for r in m.predicted(docs, None).collect()} == {"und"}


def test_the_sample_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame([(k, "abcdefghij" * 10, "en") for k in range(4000)], "doc_id long, text string, lang string")
    rows = m.learnable(docs)
    size = rows.count() * 100
    one = m.sampled(rows, {"en": size}, 50_000).count() * 100
    assert one == m.sampled(rows.repartition(7), {"en": size}, 50_000).count() * 100 and 35_000 < one < 65_000
