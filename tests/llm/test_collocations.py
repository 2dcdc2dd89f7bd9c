import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import collocations as m

SF = "/root/testdata/sf0.01"


def brute(rows, least, top=2000):
    """By counting every phrase of every lang."""
    by_lang = {}
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        by_lang.setdefault(lang or "und", []).extend(re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", text))
    out = []
    for lang, pieces in by_lang.items():
        f = Counter(tuple(ws[i : i + k]) for ws in pieces for k in range(1, 5) for i in range(len(ws) - k + 1))
        n = sum(c for w, c in f.items() if len(w) == 1)
        candidates = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        kept = []
        for w, a in candidates.items():
            longer = [b for v, b in candidates.items() if len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, _, l, r = min((2000000 * a // (f[w[:k]] + f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(m.SQL)
    assert set(want.columns) == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}
    got = rows_of(m.query(spark, SF))
    assert len(got) > 100 and got == sorted(want.fetchall())


@pytest.mark.parametrize("block, chunk", [(1 << 20, 2 << 20), (20, 30)])
def test_against_brute_force(spark, monkeypatch, block, chunk):
    """With small blocks, pieces are longer than blocks and cut between them."""
    rng = random.Random(block)
    words = ["a", "B", "c", "The", "dog", "é", "of x", "\x00"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "."]) for _ in range(rng.randint(0, 40)))) for _ in range(60)]
    rows += [("en", " ".join(rng.choices(["a", "b", "a b", "c"], k=400))), ("en", None), ("de", ""), ("fr", ".,;"), ("en", "w" * 100 + " a b"), ("en", "x x x x x x x")]
    monkeypatch.setattr(m, "LEAST", 3)
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "CHUNK", chunk)
    columns = spark.createDataFrame([(k, t, lang, 1, "z") for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string").repartition(3)
    sizes, levels = m.phrases(columns)
    in_tasks = list(m._blocks([pa.RecordBatch.from_arrays([pa.array([lang or "und" for lang, _ in rows]), pa.array([t for _, t in rows], pa.string())], ["lang", "text"])]))
    assert len(in_tasks) > 20 if block == 20 else len(in_tasks) == 3
    assert rows_of(m.collocations(columns)) == brute(rows, 3)
    assert rows_of(m.collocations(columns, 5)) == brute(rows, 3, 5)
    assert m.collocations(columns.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    a = 9_000_000_000_000_000
    row = spark.createDataFrame([(a, [a + 1, a], [a + 2, a])], "a long, firsts array<long>, lasts array<long>")
    assert row.select(m._cut(2).score).first()[0] == 2000000 * a // (2 * a + 3)


def test_merge_join():
    left, right = np.array([1, 4, 5, 9]), np.array([2, 3, 5, 6])
    assert [x.tolist() for x in m.joined(left, right)] == [[0, 1, 2], [0, 2, 3]]
    assert [x.tolist() for x in m.joined(left, np.array([], "i8"))] == [[], []]
