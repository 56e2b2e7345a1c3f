"""PII, tokens, packing, SimHash, line dedup and quality against brute force on small tables with odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wristloom.llm import bitpack, linededup, packing, pii, quality, simhash
from wristloom.llm.tokens import WORD_BPE, CachedEncoder, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF001 = "/root/testdata/sf0.001"
LINE = "This line is long enough to count and stands in many documents."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the woods "
    texts = [
        None, "", " ", "\n\n", base, base, base.upper(), base * 40, base * 40 + "end", "one two", "a" * 50_000, "7" * 40_000,
        f"x\n{LINE}\ny", f"{LINE}", f"  {LINE.upper()}\t\n{LINE}", f"{LINE}\nz", f"{LINE}\n{LINE}", "a@b.com_c@d.org, 1.2.3.4 256.1.1.1 +1 (234) 567-8901 4111 1111 1111 1111",
        "same same same same same same same same same same same same", "line\nline\nother words here to make this one pass as a text", "don't <|endoftext|> Ünï 日本\x1c語 ²", "x" * 3 + "\u00a0y\u2028z",
    ]
    rows = [(k, t, ["en", "de", None][k % 3], ["a", None][k % 2], None) for k, t in enumerate(texts)]
    rows += [(3, "\n\n", "en", "a", 2), (3, f"{LINE} again", "en", "a", 2), (None, LINE, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"fp": F.lit("x"), "node": F.lit(1), "start": F.lit(2), "kept": F.lit("no"), "n": F.lit(0), "label": F.lit(1)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


@pytest.mark.parametrize("text", [
    "a@b.com_c@d.org", "@@a@b@c.d", "a@b a@b.c. x.@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", "4111-1111 1111-1111 1", "+1-(2) 34567890 +49 30 12 34 56 789 0", "+12 3", "++1 2345678",
    "é@b.com a@é.com a@b.c-d", "1.2.3", "4111111111111111 4111111111111112", "a.b%c+d-e_f@g-h.i.j@k.l",
])
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_at_random():
    r = np.random.default_rng(0)
    for _ in range(3000):
        text = "".join(r.choice(list("ab1 2.3@+-()_é:4"), 40))
        assert pii.base_spans(text) == brute_spans(text), text


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(pii.labelled_table(spark))


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty):
    """Nulls in every column, empty and long texts, repeated rows, clashing names, and no rows, through all stages."""
    import corpus_pipeline
    from wristloom.llm.common import written

    long = " ".join(f"word{k} of text{k % 97}" for k in range(4000))
    more = [(100 + k, f"{long[k * 20 : k * 20 + 900]} {LINE}\nand so on it went with number {k}", ("en", None)[k % 2], ("a", None)[k % 3 == 0], None) for k in range(30)]
    more += [(200, long, None, None, None), (None, f"{long[:700]} without a number", None, "a", 5)]
    rows = odd.unionByName(spark.createDataFrame(more * 2, SCHEMA), allowMissingColumns=True)
    for docs in (rows, rows.limit(0), empty):
        names, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, SF001), "odd-stage")
            assert docs.columns == names, name
        kept = docs.select("doc_id", "text").collect()
        assert len(kept) <= n and (not n or {None} <= {r["doc_id"] for r in kept} | {None})
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
        assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in kept}
        if n:
            assert kept and all(r["text"] for r in kept)


def test_field_finds_what_patterns_miss(field):
    held_out = pii.labelled_sentences(8, seed=4242)
    hits = sum(map(_same, held_out, itertools.repeat(field)))
    assert hits / len(held_out) > 0.97
    found = pii.field_spans(["call (555) 123-4567 or write to ann [at] host [dot] com please", "nothing here but plain words"], field)
    assert [k for k, _, _ in found[0]] == ["phone", "email"] and found[1] == []


def _same(sentence, field):
    tokens, tags = sentence
    text, at, want = " ".join(tokens), 0, []
    for token, tag in zip(tokens, tags, strict=True):
        if tag[0] == "B":
            want.append([tag[2:], at, at + len(token)])
        elif tag[0] == "I":
            want[-1][2] = at + len(token)
        at += len(token) + 1
    trim = lambda k, a, b: (k, a + pii.core(text[a:b])[0], a + pii.core(text[a:b])[1])
    return pii.field_spans([text], field)[0] == [trim(*w) for w in want]


def test_scores_are_those_of_the_features(field):
    """The tables by token and kind give what the features of each token give."""
    texts = [["write", "to", "ann", "[AT]", "host", "dot", "com", "or", "call", "(555)", "123-4567", "now."], ["1.2.3.4"], ["x" * 500, "9" * 100, "end"], ["Über,", "ÄB", "USA", "McX", "größe.", "Visa", "ʰª", "Com", "***", "²"]]
    small = pii.Field(field, cache_tokens=3)
    for _ in range(2):
        for got, tokens in zip(small.scores(texts), texts, strict=True):
            assert np.allclose(got, [field.scores(pii.features(tokens, k)) for k in range(len(tokens))])


def test_viterbi_against_enumeration():
    from wristloom.llm.crf import viterbi

    r = np.random.default_rng(2)
    move, first, last = r.normal(size=(3, 3)), r.normal(size=3), r.normal(size=3)
    scores = [r.normal(size=(n, 3)) for n in (1, 4, 2, 5, 5, 3)]
    for cells in (1 << 18, 6):
        for s, path in zip(scores, viterbi(scores, ["a", "b", "c"], move, first, last, cells), strict=True):
            total = lambda p: first[p[0]] + last[p[-1]] + sum(s[k][y] for k, y in enumerate(p)) + sum(move[x, y] for x, y in itertools.pairwise(p))  # noqa: E731, B023
            assert tuple(path) == max(itertools.product(range(3), repeat=len(s)), key=total)


def test_field_reads_capitals_and_bare_words(field):
    found = pii.field_spans(["mail jane [AT] corp [DOT] com today", "ann at host dot com is mine", "she was at the house of a dot", f"{'ab12' * 10} is a digest"], field)
    assert [[k for k, _, _ in x] for x in found] == [["email"], ["email"], [], []]


def test_pii_rows(spark, odd, empty, field):
    got = pii.find_pii(odd, field)
    assert got.count() == odd.count() and pii.find_pii(empty, field).count() == 0
    for r in got.collect():
        assert r["base_sha256"] and r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"] == len(r["spans"].split(",")) * (r["spans"] != "")
    texts = Counter((d, ",".join(f"{k}:{a}:{b}" for k, v in brute_spans(t or "").items() for a, b in v)) for d, t in plain(odd))
    digests = Counter((d, hashlib.sha256(s.encode()).hexdigest()) for d, s in texts.elements())
    assert digests == Counter((r["doc_id"], r["base_sha256"]) for r in got.collect())


# ---------------------------------------------------------------- tokens, files, packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(WORD_BPE))


def test_cached_encoder_is_exact(odd, tokenizer):
    texts = [t or "" for _, t in plain(odd)] + ["It's SHE'll. a_.b x², ⅷ!!. ###, 1,000.5 ‘x’. ΣΑΣ İx ß-Ö", "A.b,C.D e . f", "\x1d.", "<|startoftext|>.x"]
    small = CachedEncoder(public_tokenizers.path(WORD_BPE), cache_words=5)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder().encode(texts) == want and [x for t in texts for x in small.encode([t])] == want


def test_cached_encoder_on_all_letters(tokenizer):
    """Every code point of the basic plane and some beyond, beside stops, commas, capitals and signs."""
    mine = encoder()
    texts = ["İYİ, GÜNLER.", "EDİLDİ.", "TÜRKİYE GENELİ.", "I\u0307. i\u0307, A\u030a.", "\u0958. \ufb1d, \u0344.", "ΑΣ. ΑΣ, Σ.", "x\u0345.y"]
    points = [c for c in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x10400, 0x10450), *range(0x1F300, 0x1F320)]]
    for at in range(0, len(points), 16):
        texts += ["".join(f"a{chr(c)}.B {chr(c)}, {chr(c)}x" for c in points[at : at + 16])]
    texts += [f"{chr(c)}. A{chr(c)}, b" for c in points]
    r = np.random.default_rng(11)
    some = list("aB.,  İıſßΣé\u0307\u0301'!-_²½1") + [chr(int(c)) for c in r.choice(points, 200)]
    texts += ["".join(r.choice(some, 24)) for _ in range(30_000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = mine.encode(texts)
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


@pytest.mark.parametrize("bits", [1, 3, 7, 16, 17, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_pack_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**bits, n, dtype=np.uint64)
    data = bitpack.pack(ids, bits)
    assert len(data) == -(-n // 64) * 8 * bits and np.array_equal(bitpack.unpack(data, bits, n), ids)


def test_random_access(tmp_path):
    files, name = bitpack.open_fs(str(tmp_path / "s.tid"))
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 5, 300, 64, 1, 700)]
    w = bitpack.ShardWriter(files.open_output_stream(name), 13, block_ids=128)
    w.add([1, None, 3], docs[:3])
    w.add([4, 5, 6], docs[3:])
    w.close()
    whole = np.concatenate(docs)
    with files.open_input_file(name) as f:
        r = bitpack.ShardReader(f)
        for a, b in [(0, 1), (0, len(whole)), (127, 129), (500, 501), (5, 5), (1000, 9999)]:
            assert np.array_equal(r.ids(a, b), whole[a:b])
        assert all(np.array_equal(r.document(k), d) for k, d in enumerate(docs))
        assert [d for d, _, _ in r.documents(at_once=10)] == [1, None, 3, 4, 5, 6]
    with pytest.raises(ValueError, match="bits"):
        bitpack.ShardWriter(files.open_output_stream(name), 3, 64).add([1], [np.arange(64, dtype=np.uint32)])


def test_bitpack_rows(odd, empty, tokenizer):
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in bitpack.encode_to_files(odd).collect()))
    order = sorted(((d is not None, d or 0, t or "") for d, t in plain(odd)))
    at, want = 0, []
    for known, d, t in order:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((at, d if known else None, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want and bitpack.encode_to_files(empty).count() == 0


def test_cuts():
    for n in itertools.chain(range(1, 500), range(3900, 4300), (8191, 100_000)):
        parts = packing.cut(n)
        assert sum(parts) == n and all(p == packing.CAPACITY // (packing.CAPACITY // p) or p <= packing.SHORT for p in parts)


def test_packing_rows(odd, empty, tokenizer):
    rows = [r.asDict() for r in packing.harmonic_pack(odd).collect()]
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for seq in by_seq.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(by_seq) == list(range(len(by_seq)))
    used = sum(r["length"] for r in rows)
    assert len(by_seq) * 4096 - used < 2 * 4096
    want = Counter()
    for d, t in plain(odd):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for n in packing.cut(len(ids)):
            want[d, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)] += 1
            at += n
    assert want == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    assert packing.harmonic_pack(empty).count() == 0


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text, shingle, seed=42):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    grams = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, radius):
    """nodes: (id, fingerprint) to the least id reachable over links of radius bits."""
    parent = {k: k for k in range(len(nodes))}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in itertools.combinations(range(len(nodes)), 2):
        if (nodes[i][1] ^ nodes[j][1]).bit_count() <= radius:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for k in range(len(nodes)):
        least[find(k)].append(nodes[k][0])
    return [min(least[find(k)]) for k in range(len(nodes))]


@pytest.mark.parametrize("shingle", [4, 5])
def test_simhash_rows(odd, empty, shingle):
    got = Counter(map(tuple, simhash.near_duplicates(odd, shingle=shingle).collect()))
    docs = [(d, brute_fingerprint(t or "", shingle)) for d, t in plain(odd)]
    known = [x for x in docs if x[0] is not None]
    component = dict(zip([(d, fp) for d, fp in known], brute_components(known, 4), strict=True))
    by_fp = {fp: c for (_, fp), c in component.items()}
    want = Counter((d, f"{fp:016x}", component[d, fp] if d is not None else by_fp.get(fp)) for d, fp in docs)
    assert got == want and simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius, segments", [(4, 4), (4, 3), (3, 2), (6, 4)])
def test_multi_index_hashing_finds_all(spark, radius, segments):
    r = np.random.default_rng(radius * 10 + segments)
    fps = set()
    for _ in range(25):
        c = int(r.integers(0, 2**63)) << 1 | int(r.integers(0, 2))
        for _ in range(10):
            x = c
            for b in r.choice(64, r.integers(0, 9), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
            c = x if r.random() < 0.4 else c
    nodes = list(enumerate(sorted(fps)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(fp), k) for k, fp in nodes], "fp long, node long")
    got = {x["fp"]: x["component"] for x in simhash.near_components(df, radius, segments).collect()}
    assert got == {signed(fp): c for (_, fp), c in zip(nodes, brute_components(nodes, radius), strict=True)}


@pytest.mark.parametrize("find, joins", [
    (simhash.near_duplicates, {"buckets": "bucket", "mixed-buckets": "fp", "links": "bucket"}), (simhash.similar_duplicates, {"similar-buckets": "bucket", "similar-wanted": "node"}),
])
def test_buckets_are_never_broadcast(spark, monkeypatch, find, joins):
    """Spark takes exploded rows for a table of their documents' size, which it would broadcast at any number of rows below 10 MB of those."""
    plans, written, components = defaultdict(str), simhash.written, simhash.components

    def noted(df, label):
        plans[label] += df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(simhash, "written", lambda df, label: written(noted(df, label), label))
    monkeypatch.setattr(simhash, "components", lambda edges: components(noted(edges, "links")))
    monkeypatch.setattr(simhash, "CELL", 4)
    base = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join([*base[: k % 7], f"e{k}", *base[k % 7 + 1 :]])) for k in range(40)]
    assert find(spark.createDataFrame(docs, "doc_id long, text string")).count() == 40
    assert {label: set(re.findall(rf"(\w+)Join \[{column}#", plans[label])) for label, column in joins.items()} == {label: {"SortMerge"} for label in joins}


def test_edited_copies(spark):
    """Copies at a shingle similarity of 0.8 and more are found, other texts of the same words are not."""
    r = np.random.default_rng(8)
    words = [f"w{k}" for k in range(300)]
    docs = []
    for k in range(40):
        base = list(r.choice(words, 400))
        copy = list(base)
        for at in r.choice(400, 5, replace=False):
            copy[at] = "edited"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got = simhash.similar_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["component_id"] in (r["doc_id"], r["doc_id"] - 1) for r in got)
    assert sum(r["component_id"] != r["doc_id"] for r in got) >= 38


def brute_shingles(text, shingle=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}


def edited_texts(edits, pairs, seed, length=400):
    """Pairs of texts (2k, 2k + 1) that differ in so many words."""
    r = np.random.default_rng(seed)
    docs = []
    for k in range(pairs):
        base = [f"w{x}" for x in r.integers(0, 3000, length)]
        copy = list(base)
        for at in r.choice(length // 10, edits, replace=False):
            copy[int(at) * 10 + 2] = f"edit{k}"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    return docs


def similarity(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    return len(a & b) / len(a | b)


def test_every_pair_at_the_threshold_is_linked(spark):
    """No pair just above 0.8 is lost."""
    docs = edited_texts(8, 200, 21)
    assert all(0.8 <= similarity(docs[k][1], docs[k + 1][1]) < 0.83 for k in range(0, 400, 2))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: d // 2 * 2 for d, _ in docs}


def test_no_pair_below_the_threshold_is_linked(spark):
    """Texts at 0.7 to 0.8, many of them within the radius of the wide fingerprints, stay apart."""
    docs = edited_texts(12, 200, 22)
    assert all(0.7 < similarity(docs[k][1], docs[k + 1][1]) < 0.8 for k in range(0, 400, 2))
    got = simhash.similar_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)


def brute_similar(docs):
    """(doc_id, text) to the least doc_id reachable over links of a similarity of 0.8 and more."""
    sets, parent = [brute_shingles(t) for _, t in docs], list(range(len(docs)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in itertools.combinations(range(len(docs)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        least[find(k)] = min(d, least.get(find(k), d))
    return {d: least[find(k)] for k, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("cell", [simhash.CELL, 8])
def test_similar_components_against_all_pairs(spark, monkeypatch, cell):
    """Families of chained edits, around the threshold, against all pairs; buckets in one cell and in many."""
    monkeypatch.setattr(simhash, "CELL", cell)
    r = np.random.default_rng(5)
    docs = []
    for f in range(12):
        texts = [[f"w{x}" for x in r.integers(0, 3000, 120)]]
        for _ in range(14):
            copy = list(texts[int(r.integers(0, len(texts)))])
            for at in r.choice(120, int(r.integers(1, 6)), replace=False):
                copy[int(at)] = f"e{int(r.integers(0, 10**6))}"
            texts.append(copy)
        docs += [(100 * f + k, " ".join(t)) for k, t in enumerate(texts)]
    r.shuffle(docs)
    docs = [(int(d), t) for d, t in docs]
    want = brute_similar(docs)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and len(set(got.values())) > 12


def test_majority_of_samples():
    """A segment's bits are the majority of its voters' bits."""
    found = simhash.shingle_set(" ".join(f"w{k}" for k in range(50)))
    with np.errstate(over="ignore"):
        least = np.array([min(int(h) * int(m) % 2**64 for h in found) for m in simhash._SAMPLE], dtype=np.uint64)
        x = least * simhash._VOTE
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    want = [sum(1 << b for b in range(32) if sum(int(v) >> b & 1 for v in x[at : at + simhash.VOTERS]) > 2) for at in range(0, len(x), simhash.VOTERS)]
    assert simhash.sampled_fingerprint(found).tolist() == want


def test_similar_rows(odd, empty):
    got = simhash.similar_duplicates(odd).collect()
    known = [(d, t) for d, t in plain(odd) if d is not None]
    assert len(got) == odd.count() and simhash.similar_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    least = {r["doc_id"]: r["component_id"] for r in got if Counter(d for d, _ in known)[r["doc_id"]] == 1}
    for d, t in known:
        for e, u in known:
            a, b = brute_shingles(t or ""), brute_shingles(u or "")
            if d in least and e in least and 5 * len(a & b) >= 4 * len(a | b):
                assert least[d] == least[e]


def test_one_of_each(odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    found = simhash.similar_duplicates(odd).groupBy("doc_id").agg(F.min("component_id").alias("c")).where("doc_id <> c")
    gone = {r["doc_id"] for r in found.collect()}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in plain(odd) if d not in gone)


# ---------------------------------------------------------------- quality, lines


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_rows(odd, empty):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality(odd).collect())
    assert got == Counter((d, *brute_quality(t or "")) for d, t in plain(odd))
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    want = Counter(r["doc_id"] for r in quality.quality(odd).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == want and want


def test_thresholds_adapt(spark):
    """A group where a third of words carry signs keeps its usual documents; the same text fails elsewhere."""
    clean, signs = "words and more words that differ each from other in some way " * 1, "a# b# c# d# e# f# g# h# i# j# k# l#"
    rows = [(k, signs, "en", "code", 0) for k in range(300)] + [(1000 + k, clean, "en", "web", 0) for k in range(300)] + [(5000, signs, "en", "web", 0)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] and got[1000] and not got[5000]


def test_limits_come_from_sketches(spark):
    """Quartiles of a group are those of its values, to a bucket's width, and groups differ in their limits."""
    r = np.random.default_rng(4)
    rows = []
    for k in range(1200):
        marks = int(r.integers(0, 3 if k % 2 else 9))
        rows.append((k, " ".join(["word"] * 30 + ["#" * (1 + int(x)) for x in r.integers(0, 3, marks)]), "en", "ab"[k % 2], 0))
    stats = quality.statistics(spark.createDataFrame(rows, SCHEMA), ["lang", "source"])
    got = {r["source"]: r for r in quality.thresholds(quality.sketches(stats), prior=0).collect()}
    for source in "ab":
        values = sorted(1000 * (len("".join(t.split())) - 120) // len("".join(t.split())) for _, t, _, s, _ in rows if s == source)
        for q, c in ((0.25, "marks_q1"), (0.75, "marks_q3")):
            want = values[max(0, -(-len(values) * int(100 * q) // 100) - 1)]
            assert got[source][c] == want - want % (1 << max(0, want.bit_length() - quality.BITS))
    assert got["a"]["marks_range"] > got["b"]["marks_range"]


def test_small_groups_lean_on_their_language(spark):
    """Limits are quartiles of a group's counts and those of the levels above, scaled to `prior` documents each."""
    r = np.random.default_rng(8)
    rows, values = [], defaultdict(Counter)
    for k in range(900):
        lang = ("en", "de")[k % 3 == 0]
        source = ("big", "small")[k % 40 == 0]
        n = int(r.integers(20, 60)) + 40 * (lang == "de") + 60 * (source == "small")
        rows.append((k, " ".join(["word"] * n), lang, source, 0))
        values[lang, source][n] += 1
    stats = quality.statistics(spark.createDataFrame(rows, SCHEMA), ["lang", "source"])
    sketch = quality.sketches(stats)
    for prior in (0, 30, 200, 10**6):
        got = {(x["lang"], x["source"]): x["median_words"] for x in quality.thresholds(sketch, prior).collect()}
        every = sum(values.values(), Counter())
        for (lang, source), own in values.items():
            of_lang = sum((c for (x, _), c in values.items() if x == lang), Counter())
            n_lang, n_all = sum(of_lang.values()), sum(every.values())
            up = {v: (of_lang[v] + prior * every[v] / n_all) / (n_lang + prior) for v in every}
            share = {v: (own[v] + prior * up[v]) / (sum(own.values()) + prior) for v in every}
            upto, want = 0.0, None
            for v in sorted(share):
                upto += share[v]
                if upto >= 0.5 - 1e-12:
                    want = v
                    break
            assert got[lang, source] == want, (prior, lang, source)
    tiny = {(x["lang"], x["source"]): x["median_words"] for x in quality.thresholds(sketch, 0).collect()}
    assert tiny["en", "small"] > tiny["en", "big"] + 30


def test_symbols_decide_by_themselves(spark):
    """A text with signs of markup fails among prose of many other marks, which keeps its own."""
    r = np.random.default_rng(3)

    def prose(left, right):
        names = ["".join(chr(97 + int(c)) for c in r.integers(0, 26, 6)) for _ in range(40)]
        return " ".join(f"{left}{w}{right}" if k % 4 == 0 else w for k, w in enumerate(names))

    rows = [(k, prose("(", ")"), "en", "a", 0) for k in range(300)] + [(900, prose("#", "|"), "en", "a", 0)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] and not got[900]


def brute_lines(docs, least_chars=40, least_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= least_chars:
                holders[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def test_line_rows(odd, empty):
    want = brute_lines(plain(odd))
    assert sum(x[2] for x in want) >= 4
    assert Counter(map(tuple, linededup.line_dedup(odd).collect())) == Counter(x[:4] for x in want)
    cleaned = linededup.without_common_lines(odd)
    assert cleaned.columns == odd.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in cleaned.collect()) == Counter((x[0], x[4]) for x in want)
    assert linededup.line_dedup(empty).count() == 0


def test_field_finds_what_the_patterns_miss(spark):
    crf = pii.fit(pii.labelled_table(spark))
    found = {
        "tel. 030 1234567 bitte": ("phone", "030 1234567"), "ring me on 0207 946 0958 after six": ("phone", "0207 946 0958"), "contact: jane(at)corp.de now": ("email", "jane(at)corp.de"),
        "Telefon 089/1234567.": ("phone", "089/1234567"), "write to bob [at] corp [dot] com today": ("email", "bob [at] corp [dot] com"),
    }
    for text, want in found.items():
        assert [(k, text[a:b]) for k, a, b in pii.field_spans([text], crf)[0]] == [want]
    for text in ("IBAN DE89 3704 0044 0532 0130 00 here", "we sold 120 4567 of them", "in 1998 or 2004 there were 300 400 500", "paid 1,234 for 5678 items on 2020-01-02", "the number 0312 was out"):
        assert pii.field_spans([text], crf)[0] == []


def test_field_on_sentences_it_has_not_seen(spark):
    """Precision and recall of entities on sentences of another seed than the training table's."""
    crf = pii.fit(pii.labelled_table(spark))
    hits = made = real = 0
    for tokens, tags in pii.labelled_sentences(per_template=6, seed=12345):
        text = " ".join(tokens)
        starts = np.cumsum([0, *(len(t) + 1 for t in tokens)])
        want, k = set(), 0
        while k < len(tags):
            if tags[k].startswith("B-"):
                end = k + 1
                while end < len(tags) and tags[end] == f"I-{tags[k][2:]}":
                    end += 1
                a, b = pii.core(text[starts[k] : starts[end] - 1])
                want.add((tags[k][2:], int(starts[k]) + a, int(starts[k]) + b))
                k = end
            else:
                k += 1
        got = set(pii.field_spans([text], crf)[0])
        hits, made, real = hits + len(got & want), made + len(got), real + len(want)
    assert real > 200 and hits / real > 0.9 and hits / made > 0.9
