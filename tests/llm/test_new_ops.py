"""Whitening, ranked search and repeat removal against plain versions."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wristloom.llm import repeats, search, whitening

from ..duck import connected, rows as duck_rows

SF001 = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- whitening


def symmetric(values, seed=3):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q * np.array(values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 2, 64),
        [5, 5, 5, 1, 1, *[0.5] * 40],
        [1e6, *np.linspace(1, 1.01, 50)],
        [3.0],
        [2.0, 1.0, 0.0],
        [0.0] * 5,
        [7.0, 1e-9, *[0.0] * 30],
    ],
)
def test_jacobi_davidson_finds_the_largest_pairs(values):
    a = symmetric(values)
    found = whitening.jacobi_davidson(lambda block: a @ block, len(a), 4)
    want = np.sort(values)[::-1][:4]
    assert np.allclose(found.values, want, rtol=1e-12, atol=1e-12 * max(want[0], 1e-300))
    assert np.abs(a @ found.vectors - found.vectors * found.values).max() <= 1e-12 * max(want[0], 1e-300)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(len(want)), atol=1e-12)


def test_minres_solves_an_indefinite_system():
    a = symmetric([*np.linspace(-3, -1, 20), *np.linspace(1, 4, 20)])
    b = np.random.default_rng(1).standard_normal((40, 3))
    x = whitening.minres(lambda t: a @ t, b, 80, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-9


def check_whitening(rows, got):
    kept = [(k, v) for k, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = {k: tuple(int(np.floor(256 * float(c))) for c in v) for k, v in kept}
    fit = np.array(sorted(set(x.values())), dtype=float)
    n, sums = len(fit), [sum(int(v) for v in c) for c in fit.T]
    centred = fit - fit.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 4 * len(kept)
    signs = {}
    for r in got:
        c, own = r["component"] - 1, x[r["vec_id"]]
        assert (r["n"], r["deviation"]) == (n, sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True)))
        assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-10) and r["identity_error"] < 1e-10
        want = (np.array(own) - fit.mean(axis=0)) @ u[:, c] / np.sqrt(e[c])
        sign = signs.setdefault(c, np.sign(want * r["whitened"]) or 1)
        assert r["whitened"] == pytest.approx(sign * want, abs=1e-8)


def test_whiten_against_a_dense_solution(spark):
    from wristloom.llm import queries

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    check_whitening(rows, queries.op11_whitening(spark, SF001).collect())


def test_whiten_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in rng.standard_normal(6)]) for k in range(40)]
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0]), (102, [nan] * 6), (103, [inf, 1.0]), (104, []), (105, rows[0][1]), (106, rows[0][1])]
    schema = "vec_id long, embedding array<double>, component string"
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], schema)
    check_whitening(rows + odd, whitening.whiten(table).collect())
    assert whitening.whiten(table.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(table.limit(0)).count() == 0
    # another size than the commonest one goes; a null key stays
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 5.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"] for r in whitening.whiten(mixed).collect()} == {1, None}
    # one vector only: no variance, so whitened is 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(same).collect()
    assert len(got) == 4 and all(r["whitened"] == 0 and r["n"] == 1 and r["deviation"] == 0 for r in got)
    # a deviation beyond a long is null
    huge = spark.createDataFrame([(1, [1e13, 0.0]), (2, [-1e13, 1.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(huge).where("vec_id < 3").collect()} == {None}


# ---------------------------------------------------------------- search


def plain_search(docs, items, k=10):
    from collections import Counter

    cut = lambda t: search.TERM.findall((t or "").encode().lower())
    known = [(d, Counter(cut(t))) for d, t in docs if d is not None and cut(t)]
    n, all_terms = len(known), sum(sum(c.values()) for _, c in known)
    out = []
    for item, text in items:
        rows = []
        for d, c in known:
            m, score = 25 + 75 * sum(c.values()) * n // all_terms, 0
            for t, r in Counter(cut(text)).items():
                df = sum(t in other for _, other in known)
                score += r * search.weight(n, df) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            rows.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(rows)[:k]) if s < 0]
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_best_positions_lose_no_document(data):
    n, terms = data.draw(st.integers(1, 60)), data.draw(st.integers(1, 5))
    cells = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, terms - 1), st.integers(0, 6)), max_size=200, unique_by=lambda c: c[:2]))
    doc, term, impact = (np.array([c[k] for c in cells], dtype=np.int64) for k in range(3))
    found = search.Segment(np.arange(n) + 100, doc, term, impact, terms)
    asked, repeats = np.arange(terms), np.arange(terms) + 1
    total = np.zeros(n, dtype=np.int64)
    np.add.at(total, doc, impact * repeats[term])
    want = sorted((-s, d + 100) for d, s in enumerate(total) if s > 0)[:3]
    step, search.STEP = search.STEP, 1
    try:
        ids, scores = search.Segment.best(found, asked, repeats, 3)
    finally:
        search.STEP = step
    assert sorted((-s, d) for d, s in zip(ids.tolist(), scores.tolist(), strict=True))[:3] == want


def test_best_positions_stop_early():
    n, rng = 5000, np.random.default_rng(2)
    doc, term = np.tile(np.arange(n), 2), np.repeat([0, 1], n)
    impact = np.concatenate([np.sort(rng.integers(1, 10**6, n))[::-1]] * 2)
    ids, _ = search.Segment(np.arange(n), doc, term, impact, 2).best(np.array([0, 1]), np.array([1, 1]), 10)
    assert set(range(10)) <= set(ids.tolist()) and len(ids) < 20


def test_search_equals_sql(spark):
    from wristloom.llm import queries

    assert duck_rows(queries.op12_search(spark, SF001).toArrow()) == duck_rows(connected(SF001).sql(search.search_sql()).to_arrow_table())


def test_search_edges(spark, monkeypatch):
    docs = [(3, "B a"), (1, "a b"), (2, "a, b."), (4, None), (5, ""), (6, " .;"), (None, "a a a"), (1, "a b"), (7, "x" * 5000 + " A"), (8, "é É a"), (9, "nul\x00a b")]
    items = [("q", "A"), ("q", "a b b"), ("n", None), (None, "b"), ("none", "zzz"), ("é", "é")]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    asked = spark.createDataFrame([(*i, "t") for i in items], "item_id string, text string, rank string")
    want = plain_search(docs, items)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(search.search(table, asked)) == want and rows(search.search(table, asked, k=2)) == plain_search(docs, items, 2)
    monkeypatch.setattr(search, "ITEMS_AT_ONCE", 2)
    assert rows(search.search(table, asked)) == want
    assert search.search(table.limit(0), asked).count() == 0 and search.search(table, asked.limit(0)).count() == 0
    assert search.search(table.where("doc_id = 4"), asked).count() == 0


def test_terms_of_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(search, "TEXT_AT_ONCE", 7)
    text = "ab, cd" * 30 + "x" * 40 + " é1Z" * 9
    assert [t for part in search.terms(text) for t in part] == search.TERM.findall(text.encode().lower())


# ---------------------------------------------------------------- repeats


def plain_repeats(rows, length):
    first, out = {}, []
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], d)
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if d is not None and first[raw[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.binary(min_size=12, max_size=12).map(lambda b: bytes(c % 2 for c in b))), min_size=1, max_size=40), st.integers(1, 12))
def test_longest_previous_factors(rows, least):
    suffixes, doc = np.array([list(s) for _, s in rows], dtype=np.uint8), np.array([d for d, _ in rows])
    common = lambda a, b: next((k for k in range(12) if a[k] != b[k]), 12)
    want = [max([common(s, o) for e, o in rows if e < d], default=0) for d, s in rows]
    assert repeats.longest_previous_factors(suffixes, doc, least).tolist() == [w if w >= least else 0 for w in want]


def test_window_runs_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    monkeypatch.setattr(repeats, "PIECE", 64)
    texts = [b"", b"a" * 49, b"a" * 50, b"ab" * 400, bytes(np.random.default_rng(1).integers(0, 4, 1000, dtype=np.uint8)), b"c" * 51]
    data, ends = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts])
    gram, at, n = repeats.window_runs(data, ends, 50)
    begins = np.concatenate([[0], ends[:-1]])
    assert [s + i for s, k in zip(at, n, strict=True) for i in range(k)] == [b + i for b, t in zip(begins, texts, strict=True) for i in range(len(t) - 49)]
    # equal windows have equal grams
    grams, raw = {}, data.tobytes()
    for g, s, k in zip(gram, at, n, strict=True):
        for i in range(s, s + k):
            assert grams.setdefault(raw[i : i + 50], g) == g


@pytest.mark.parametrize(("hot", "bucket"), [(2000, 2048), (1, 2048), (2, 7)])
def test_repeats_against_brute_force(spark, monkeypatch, hot, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = sorted((tuple(r) for r in repeats.repeat_digests(docs, hot=hot).collect()), key=str)
    assert got == plain_repeats([(r["doc_id"], r["text"]) for r in docs.collect()], 50)


@pytest.mark.parametrize("hot", [1, 2000])
def test_repeats_edges(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "BUCKET", 3)
    line, rng = "the very same passage of more than fifty bytes, é and all.", np.random.default_rng(4)
    noise = lambda k: "".join(map(chr, rng.integers(97, 101, k)))
    rows = [(k, noise(30) + line + noise(30)) for k in range(12)]
    rows += [(20, None), (21, ""), (22, line), (22, line), (23, line[:49]), (None, line), (None, noise(80)), (24, "=" * 9000), (25, "=" * 60), (26, line * 3), (26, noise(60) + line), (-5, line[3:]), (27, noise(100) * 2)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, bucket string")
    for length in (50, 20):
        got = sorted((tuple(r) for r in repeats.repeat_digests(table, length, hot).collect()), key=str)
        assert got == plain_repeats(rows, length)
    assert repeats.repeat_digests(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="16"):
        repeats.cut_repeats(table, 10)


def test_cut_repeats_gives_texts_and_spans(spark):
    passage = "a passage that two documents share, long enough to count as one"
    table = spark.createDataFrame([(1, f"first {passage}"), (2, f"{passage} second")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.cut_repeats(table).collect()}
    assert bytes(got[1]["kept"]).decode() == f"first {passage}" and got[1]["spans"] == []
    assert bytes(got[2]["kept"]).decode() == " second" and got[2]["spans"] == [0, len(passage)]
    assert repeats.cut_repeats(table).where(F.size("spans") > 0).count() == 1
