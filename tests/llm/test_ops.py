import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF, run_duckdb, same
from pyspark.sql import functions as F

import corpus_pipeline
from sphereweave.llm import decontaminate, embed_dedup, langid, license_scan, lm_score, minhash, mixing, pii, registry, toxicity, warc
from sphereweave.llm.common import min_labels

DOC = "doc_id long, text string, lang string, source string, n_chars long, hit string, key string"


def docs_of(spark, texts):
    rows = [(i, t, "en", None if i is None else f"src{i % 3}", None if t is None else len(t), "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, DOC)


#: null and empty texts, no letters, ties, repeats, a long text, a null id
ODD = [(0, None), (1, ""), (2, "... 123 !!!"), (3, "Some plain words stand here."), (3, "Some plain words stand here."), (4, "Some plain words stand here."), (None, "A row without an id."), (5, "long " * 30000)]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), run_duckdb(registry.ORACLES[name]))


def test_odd_rows_everywhere(spark):
    d, empty = docs_of(spark, ODD), docs_of(spark, [])
    bench = spark.createDataFrame([(7, "plain words stand"), (8, None), (None, "row without"), (9, "")], "item_id long, text string")
    model = (["en"], np.zeros((1 << langid.BITS, 1), np.float32))
    tox = (np.zeros(1 << toxicity.BITS), -3.0)
    for x, n in ((d, 8), (empty, 0)):
        assert decontaminate.contamination(x, bench).count() == n
        assert decontaminate.decontaminate(x, bench, "spans").count() == n
        assert license_scan.license_matches(x).count() == n
        assert langid.identify(x, model).count() == n
        assert toxicity.toxicity(x, tox).count() == n
        assert pii.sanitise(x).count() == n
        assert mixing.mix(x, share=1.0, epochs=1).count() == n
        counts = lm_score.word_counts(x)
        assert lm_score.score(x, counts, lm_score.fit(counts, x, steps=2)).count() == n
    assert {(r.doc_id, r.kept) for r in minhash.near_duplicates(d).collect()} == {(2, True), (3, True), (3, False), (4, False), (5, True)}
    assert minhash.dedup(d).count() == 6 and minhash.dedup(empty).count() == 0
    hits = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(d, bench).collect()}
    assert hits[3] == (5, 3, ["7"]) and hits[None] == (5, 2, []) and hits[0] == (0, 0, [])
    assert decontaminate.decontaminate(d, bench, "documents").columns == d.columns
    assert [r["__l_pred"] for r in langid.identify(d, model).where("doc_id < 3").collect()] == ["und"] * 3


def test_components(spark):
    r = random.Random(1)
    path = r.sample(range(10_000, 20_000), 700)
    basins = [*range(20_300, 20_000, -2), *range(20_001, 20_301, 2)]  # two ends rise to one middle, and fall to another
    ring, hub, star = [*range(30_000, 30_200), 30_000], [(39_999, k) for k in range(39_000, 39_999)], [(40_000, k) for k in range(40_001, 40_500)]
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)] + hub + star + [p for x in (path, basins, ring) for p in zip(x, x[1:])]
    r.shuffle(pairs)
    up = {}

    def top(v):
        while up.get(v, v) != v:
            v = up[v]
        return v

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r.id: r.label for r in min_labels(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: top(v) for p in pairs if p[0] != p[1] for v in p}
    assert min_labels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_budget_goes_to_siblings_before_ancestors(spark):
    sizes = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "x", "s4", 1000)], "domain string, language string, source string, tokens long")
    w = {"domain": {}, "language": {}, "source": {}}
    got = {r.source: r.alloc for r in mixing.budgets(sizes, w, None, 800, 1).collect()}
    assert got == {"s1": 10, "s2": 190, "s3": 200, "s4": 400}
    short = {r.source: r.alloc for r in mixing.budgets(sizes, w, None, 2800, 1).collect()}
    assert sum(short.values()) == 2800 and short["s1"] == 10 and short["s4"] == 1000
    assert {r.alloc for r in mixing.budgets(sizes, w | {"source": {"s4": 0}}, None, 800, 1).where("source = 's4'").collect()} == {0}


def test_decontamination_by_shuffle_and_spans(spark):
    d = docs_of(spark, [(1, "keep this, one two three four five six seven eight nine ten eleven and keep that"), (2, "nothing here"), (3, "One TWO")])
    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "ONE two")], "item_id long, text string")
    small = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(d, b).collect()}
    assert small == {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(d, b, max_broadcast=0).collect()}
    assert small == {1: (11, ["1", "2"]), 2: (0, []), 3: (2, ["2"])}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(d, b, "spans").collect()}
    assert re.findall(r"\w+", cut[1]) == ["keep", "this", "and", "keep", "that"] and cut[2] == "nothing here"
    assert [r.doc_id for r in decontaminate.decontaminate(d, b).collect()] == [2]


def brute_dice(text):
    """Without the operator's own normaliser: words are cut out one by one."""
    best, words, gram = {}, [x for y in re.findall(r"[a-z0-9.]+", text.lower()) if (x := y.rstrip("."))], lambda w: {" ".join(p) for p in zip(w, w[1:])} or set(w)
    for i, t in license_scan.TEMPLATES:
        own = [x for y in re.findall(r"[a-z0-9.]+", t.lower()) if (x := y.rstrip("."))]
        b = gram(own)
        for k in range(len(words) - 1):
            if f"{words[k]} {words[k + 1]}" in b:
                a = gram(words[k: k + len(own)])
                if (d := 2 * len(a & b) / (len(a) + len(b))) >= 0.8:
                    best[i] = max(best.get(i, 0), d)
    for unit in {*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text}:
        a = set(license_scan._py_bigrams(unit))
        for i, t in license_scan.TEMPLATES:
            b = set(license_scan._py_bigrams(t))
            if a and (d := 2 * len(a & b) / (len(a) + len(b))) >= 0.8:
                best[i] = max(best.get(i, 0), d)
    return best


def test_license_scan_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs_of(spark, [(10**6, "x\nReleased under the  MIT License!\ny"), (10**6 + 1, "Released under MIT License."), (10**6 + 2, "licensed"),
                           (10**6 + 3, "int x; Copyright 2020 Jane Doe. Released under the MIT License. And code."), (10**6 + 4, " * " + "\n * ".join(license_scan.TEMPLATES[13][1].split(" or ")) + "\nint main")])
    d = docs.select("doc_id", "text").union(extra.select("doc_id", "text"))
    want = {r.doc_id: brute_dice(r.text or "") for r in d.collect()}
    for r in license_scan.license_matches(d).collect():
        got = {}
        for m in r.matches:
            got[m.id] = max(got.get(m.id, 0), m.dice)
        assert got == pytest.approx(want[r.doc_id])
        assert r.doc_id < 10**6 + 3 or got
    few, license_scan.GROUP = license_scan.GROUP, 5  # more templates than one expression takes
    try:
        assert sorted(map(str, license_scan.license_matches(extra).collect())) == sorted(str(r) for r in license_scan.license_matches(d).where("doc_id >= 1000000").collect())
    finally:
        license_scan.GROUP = few


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 8))
    x = np.concatenate([base, base[:80] + 0.12 * rng.standard_normal((80, 8)), base[:5]]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [None] * 8, 0), (904, [1.0], 0), (905, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    lab = np.arange(len(u))
    while True:
        new = np.minimum(lab, np.where(near, lab[None, :], 10**9).min(1))
        if (new == lab).all():
            break
        lab = new
    for sizes in ({}, {"cell": 40, "block": 10}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, **sizes).collect()}
        assert len(got) == len(rows)
        assert {i: (int(near[i].sum()), int(lab[i]), bool(lab[i] == i)) for i in range(len(u))} == {i: got[i] for i in range(len(u))}
        assert all(got[i] == (0, i, True) for i in range(900, 906))


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_banded_alignment_is_exact():
    r = random.Random(2)
    for _ in range(1500):
        s = r.choice([2, 5, 30])
        a = [r.randrange(s) for _ in range(r.randint(0, 25))]
        b = [x if r.random() > 0.15 else r.randrange(s) for x in a if r.random() > 0.1] if r.random() < 0.7 else [r.randrange(s) for _ in range(r.randint(0, 25))]
        x, y, d = np.array(a, np.uint32), np.array(b, np.uint32), edit(a, b)
        assert minhash.similar(x, y, 0.8) == (d <= minhash.most_edits(len(a), len(b), 0.8))
        for k in (1, 4, 12):
            if k < max(len(a), len(b)):
                assert minhash.banded_distance(x, y, k) == min(d, k + 1)


def test_near_duplicates_planted(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts, group = [], {}
    for g in range(12):
        base = [word() for _ in range(120)]
        for c in range(r.choice([1, 2, 5, 90])):
            t = list(base)
            for _ in range(2 if c else 0):
                t[r.randrange(120)] = word()
            group[len(texts)] = g
            texts.append((len(texts), " ".join(t)))
    for _ in range(90):  # share a passage, but are different texts
        group[len(texts)] = 100 + len(texts)
        texts.append((len(texts), passage + " " + " ".join(word() for _ in range(60))))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert got == {i: first[g] for i, g in group.items()}


def plain(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_pii_against_plain_patterns():
    r = random.Random(4)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", "@@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0123", "+12", "++49 30 1234567", " ", "\n", "é", ".", "-", "000.0.0.0", "word", "5"]

    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("0" * 6000 + ".1.1.1") == [("ip", 0, 6006)]


def test_pii_finds_disclosing_terms(spark):
    r = random.Random(5)
    w = lambda: r.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(r.randrange(9))
    texts = [(i, " ".join(w() for _ in range(60)) + (f" mailbox u{i}@mail.org " if i % 5 == 0 else " ") + " ".join(w() for _ in range(60))) for i in range(200)]
    d = docs_of(spark, texts)
    terms = pii.disclosing_terms(d)
    assert terms["email"] == {"mailbox"} and not terms["ip"]
    out = {x.doc_id: (x.text, x.n_chars) for x in pii.sanitise(d, terms).collect()}
    assert "[term] [EMAIL]" in out[0][0] and "@" not in out[0][0] and out[0][1] == len(out[0][0]) and out[1][0] == texts[1][1]


def test_pii_support_does_not_grow_with_the_corpus(spark):
    """A term with the highest PMI passes at the same count however many other words stand near entities."""
    r = random.Random(7)
    w = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    line = lambda k: f"{w()} {w()} {w()} {'revealer' if k % 200 == 0 else w()} u{k}@mail.org {w()} {w()} {w()}"
    texts = [(i, ". ".join(f"{line(20 * i + k)} {' '.join(w() for _ in range(12))}" for k in range(20))) for i in range(220)]
    d = docs_of(spark, texts)
    assert sum(t.count("revealer") for _, t in texts) == 22  # of some 26,000 near words
    assert pii.disclosing_terms(d)["email"] == {"revealer"}
    few, many = [{x.doc_id: (x.text, x.n_chars) for x in pii.sanitise(d, max_broadcast=m).collect()} for m in (10, 0)]
    assert few == many and len(few) == 220 and "[term] [EMAIL]" in few[0][0] and "revealer" not in few[0][0]


def test_pii_terms_far_from_entities_and_without_one(spark):
    r = random.Random(8)
    w = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    texts = [(i, f"Farname {w(30)} u{i}@mail.org {w(9)} farname" if i % 5 == 0 else w(30)) for i in range(150)] + [(150, f"{w(3)} farname {w(3)}")]
    d = docs_of(spark, texts)
    assert pii.disclosing_terms(d)["email"] == {"farname"}
    few, many = [{x.doc_id: x.text for x in pii.sanitise(d, max_broadcast=m).collect()} for m in (10, 0)]
    assert few == many == {i: re.sub("(?i)farname", "[term]", re.sub(r"u[0-9]+@mail.org", "[EMAIL]", t)) for i, t in texts}
    # a long word counts whole, and near ends by terms, not characters
    long = "x" * 150
    t = f"one {long} two, a@b.c {long} three four"
    assert sorted(pii.near_words(pii.outside(t, pii.base_spans(t)), pii.base_spans(t), 3)["email"]) == sorted(["one", long, "two", long, "three", "four"])


def test_language_and_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    got = langid.op7_langid(spark, SF).toPandas()
    h = got[got.held_out]
    assert (h.lang_pred == docs.loc[h.doc_id].to_numpy()).mean() > 0.9 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == x for i, x in zip(got.doc_id, got.held_out))
    t = toxicity.op4_toxicity(spark, SF).toPandas()
    assert t.score.between(0, 1).all() and ((t.score >= 0.5) == (t.predicted == 1)).all()


def test_toxicity_locates_sentences():
    good, bad = "the sun is up over the hill", "you are a vile toad"
    texts = [f"{good}. {bad}. {good}" if i % 2 else f"{good}. {good}" for i in range(200)]
    model = toxicity.train(texts, [i % 2 for i in range(200)])
    assert [k for k, _ in toxicity.offending(texts[1], model)] == [1] and not toxicity.offending(texts[0], model)


def test_language_model(spark):
    got = lm_score.op2_lm_score(spark, SF, steps=150).toPandas().set_index("doc_id")
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), "\n"] for i, t in rows.items()}
    from collections import Counter
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        g = got.loc[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(ws), sum(w in c for w in ws), n)
        assert abs(g.base_score - sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6 * len(ws)
    assert np.isfinite(got.score).all() and (got.score < 0).all()


def test_language_model_is_a_distribution_and_windows_agree():
    freq = np.random.default_rng(0).integers(0, 50, 3001)
    v = lm_score.Vocabulary(freq)
    f = lm_score._tables(lm_score._init(v))
    seq = np.random.default_rng(1).integers(0, 3000, 100)
    total = lm_score.score_batch(f, v, [seq, seq[:5], seq[:0]])
    alone = [lm_score.score_batch(f, v, [s])[0] for s in (seq, seq[:5], seq[:0])]
    assert np.allclose(total, alone, rtol=1e-5)
    nxt = [lm_score.score_batch(f, v, [np.array([k])])[0] for k in range(3000)]  # one id, then the end
    ends = []
    h = np.maximum(f["EW"][[0] * 3001] + lm_score._attend(f, np.zeros((1, lm_score.WINDOW), int))[5][0, :1] @ f["W"][lm_score.DIM:], 0)
    ends = lm_score._log_probs(f, h.astype(np.float32), v.of[np.arange(3001)], v.cls, v.mem) + v.tail[np.arange(3001)]
    assert abs(np.exp(ends).sum() - 1) < 1e-3 and len(nxt) == 3000


def test_warc_with_magic_inside_and_small_splits(spark):
    inner = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "http://a/é\r\nX: y", "x" * 150), (2, None, "x" * 150), (3, "u", inner), (4, "u", None), (5, "u", "WARC/1.1\r\n" * 3 + "tail\r\n\r\n"), (6, "u", ""), (None, "u", "x" * 150), (7, "u", "é" * 80 + inner + inner), (1, "u", "x" * 150)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, first string").coalesce(1)
    path = warc.shared_path(spark, "warc")
    warc.write_warc(df, path)
    for size in ("128m", "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = sorted(((r.page_id, r.bytes, r.digest, r.type, r.refers_to) for r in warc.read_records(spark, path).collect()), key=str)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        want = []
        for i, u, h in pages:
            b = (h or "").encode()
            again = b == b"x" * 150 and (i, u) != (1, pages[0][1])
            want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 1 if again else None))
        assert got == sorted(want, key=str)
    assert warc.read_records(spark, (warc.write_warc(df.limit(0), path + "-none"), path + "-none")[1]).count() == 0
    blocks = {r.page_id: bytes(r.block) for r in warc.read_payloads(spark, path).where("type = 'response'").collect()}
    assert blocks[3] == inner.encode() and blocks[5].endswith(b"tail\r\n\r\n") and blocks[7] == ("é" * 80 + inner + inner).encode()


def test_pii_query_against_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pii.op9_pii(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want, r = plain(t), got[i]
        joined = ",".join(f"{k}:{x}:{y}" for k, x, y in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in ("email", "ip", "card", "phone"))


def components(ids, pairs):
    up = {i: i for i in ids}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {i: top(i) for i in ids}


def brute_groups(texts):
    """Components of pairs whose five-word shingles are similar by 0.8, and of all that align by 0.8."""
    words = {i: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", "".join(c.lower() if c < "\x80" else c for c in t)) for i, t in texts.items()}
    words = {i: w for i, w in words.items() if w}
    num = {}
    ids = {i: np.array([num.setdefault(x, len(num)) for x in w], np.uint32) for i, w in words.items()}
    grams = {i: {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    order, close, aligned = sorted(words), [], []
    for x, i in enumerate(order):
        for j in order[x + 1:]:
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                close.append((i, j))
            if minhash.similar(ids[i], ids[j], 0.8):
                aligned.append((i, j))
    return components(order, close), components(order, aligned)


def assert_groups(found, texts):
    """No close pair is lost, and no group goes beyond what aligns."""
    close, aligned = brute_groups(texts)
    for i, top in close.items():
        assert found[i] == found[top]
    for i, top in found.items():
        assert aligned.get(i, i) == aligned.get(top, top)


def test_near_duplicates_query_against_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = minhash.op5_minhash(spark, SF).collect()
    assert {r.doc_id for r in got} == texts.keys() and len(got) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) and r.component_id <= r.class_id <= r.doc_id for r in got)
    assert_groups({r.doc_id: r.component_id for r in got}, texts)


def test_dedup_when_an_id_stands_on_several_texts(spark):
    a, b, c = ("one two three four five six seven eight", "red green blue black white grey pink brown", "sun moon star sky rain wind snow ice")
    d = docs_of(spark, [(1, a), (5, a), (5, b), (5, b), (5, b.upper()), (6, b), (7, c), (7, a), (8, None), (8, None)])
    left = sorted((r.doc_id, (r.text or "").lower()) for r in minhash.dedup(d).collect())
    assert left == [(1, a), (5, b), (7, c), (8, ""), (8, "")]
    assert left == sorted((r.doc_id, (r.text or "").lower()) for r in minhash.dedup(d, broadcast_rows=0).collect())


def test_embeddings_query_against_brute_force(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    u = {i: np.array(v, np.float64) for i, v in rows.items()}
    order = sorted(u)
    x = np.array([u[i] / np.linalg.norm(u[i]) for i in order])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    top = components(order, [(order[a], order[b]) for a, b in np.argwhere(near)])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.op3_embed_dedup(spark, SF).collect()}
    assert got == {i: (int(near[k].sum()), top[i], top[i] == i) for k, i in enumerate(order)}
    assert embed_dedup.near_duplicates(spark.read.parquet(f"{SF}/embeddings.parquet").limit(0)).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").toPandas()
    bad, fine = got[got.toxic == 1], got[got.toxic == 0]
    assert len(bad) > 50 and bad.predicted.mean() > 0.9 and fine.predicted.mean() < 0.02


def test_toxicity_scores_sentences_as_it_learns_them():
    """Distinct features of a sentence with words, however often a word stands there."""
    rng = np.random.default_rng(6)
    w, bias = rng.standard_normal(1 << toxicity.BITS), -1.0
    r = random.Random(6)
    score = toxicity.scorer(w, bias)
    for _ in range(200):
        t = "".join(r.choice(["toad ", "toads ", "Sun ", "hill", " é ", ". ", "!!", "\n", "12 "]) for _ in range(r.randint(0, 30)))
        want = [1 / (1 + np.exp(-(w[f].sum() + bias))) for f in toxicity.bag(t)]
        assert np.allclose(score(t), want), t


def test_ids_beside_nulls_are_unchanged(spark):
    big = 2**53 + 1
    d = docs_of(spark, [(big, "one two"), (None, "three"), (-big, None)]).coalesce(1)
    counts = lm_score.word_counts(d)
    known, terms = pii.with_terms(d, {k: set() for k in pii.KINDS})
    for out in (toxicity.toxicity(d, (np.zeros(1 << toxicity.BITS), -3.0)), lm_score.score(d, counts, lm_score.fit(counts, d, steps=1))):
        assert {r.doc_id for r in out.collect()} == {big, None, -big}


def test_toxicity_and_language_queries_against_plain_scores(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    w, bias = toxicity.train(*toxicity.sample(docs, labels, 4000, 64_000_000))
    for r in toxicity.op4_toxicity(spark, SF).collect():
        clean = 1.0
        for f in toxicity.bag(texts[r.doc_id]):
            clean *= 1 - 1 / (1 + np.exp(-(w[f].sum() + bias)))
        assert abs(r.score - (1 - clean)) < 1e-4 and r.predicted == (r.score >= 0.5)
    names, weights = langid.fit(docs.where(~corpus_pipeline.held_out(F.col("doc_id"), 5)))
    for r in langid.op7_langid(spark, SF).collect():
        c = langid.codes(texts[r.doc_id])
        s = np.bincount(langid.features(c), minlength=1 << langid.BITS) @ weights.astype(float) / max(1, len(langid.features(c)))
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert (r.lang_pred, r.score) == (names[p.argmax()], pytest.approx(p.max(), abs=1e-4)) if len(c) else r.lang_pred == "und"
    empty = docs.where("doc_id < 0")
    assert toxicity.train(*toxicity.sample(empty, labels, 10, 10))[0].sum() == 0 and langid.fit(empty)[0] == []


def test_language_sample_takes_every_language_and_letter(spark):
    rows = [(k, "word " * 400, "en", "s", 0, "", "") for k in range(300)] + [(1000 + k, f"lang {k} " * 3, f"l{k}", "s", 0, "", "") for k in range(70)] + [(5000, "\U00030000\U00030001", "zh", "s", 0, "", "")]
    d = spark.createDataFrame(rows, DOC)
    texts, langs = langid.sample(d, 500, 100_000)
    assert len(set(langs)) == 72 and sum(map(len, texts)) < 110_000 and langs.count("en") > 20
    assert len(langid.codes("\U00030000")) == 3


def test_recall_of_pairs_that_align():
    """Of pairs that align at 0.8 and above, by replaced, added and dropped words, at least 0.9 meet in a band at any share of edits, at 0.98 in all."""
    r, met = np.random.default_rng(1), []
    word = lambda: np.uint64(r.integers(0, 1 << 60))
    for n in (8, 20, 50, 90, 101, 130, 300):
        for share in (0.02, 0.05, 0.1, 0.15, 0.2):
            hit = []
            while len(hit) < 40:
                a = r.integers(0, 1 << 60, n).astype(np.uint64)
                b = list(a)
                for _ in range(int(share * n)):
                    kind, at = r.integers(3), r.integers(len(b))
                    b[at: at + (kind != 1)] = [] if kind == 2 else [word()]
                b = np.array(b, np.uint64)
                if minhash.similar(a.astype(np.uint32), b.astype(np.uint32), 0.8):
                    hit.append(len(np.intersect1d(minhash.keys_of(a, 0.8), minhash.keys_of(b, 0.8))) > 0)
            assert np.mean(hit) >= 0.85, (n, share)
            met += hit
    assert np.mean(met) > 0.98


def test_drifting_versions_are_one_group(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    t, texts = [word() for _ in range(100)], []
    for k in range(400):
        texts.append(((k * 7919) % 400, " ".join(t)))
        for _ in range(3):
            t[r.randrange(100)] = word()
    got = minhash.near_duplicates(docs_of(spark, texts)).collect()
    assert {x.component_id for x in got} == {0} and sum(x.kept for x in got) == 1


def test_mixing_hot_ids_zero_weights_and_clashing_names(spark):
    rows = [(None, f"a b c{k}", "en", "s1", k, "q", 1) for k in range(50)] + [(7, "same words here", "en", "s2", 1, "q", 1)] * 60 + [(8, None, "en", "s3", 0, "", 0), (9, "x y z", "en", "s3", 0, "", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, bound string, room int")
    m = mixing.mix(d, budget=90, epochs=1, weights={"domain": {}, "language": {}, "source": {"s3": 0}}, domain=F.lit("d")).collect()
    assert m[0].__fields__[:7] == d.columns and sum(r["__m_tokens"] for r in m) == 90 and {r.source for r in m} == {"s1", "s2"}
    assert sum(r.source == "s2" for r in m) == 15 and len({r.text for r in m}) == 16
    assert {r.alloc for r in mixing.budgets(spark.createDataFrame([("a", "b", "c", 10**6)], "domain string, language string, source string, tokens long"), {}, 0.0004, None, 1).collect()} == {400}


def test_model_score_against_plain_evaluation():
    """Texts of one window: every probability by a full softmax over classes and members, one position at a time."""
    freq = np.random.default_rng(0).integers(0, 50, 3001)
    v = lm_score.Vocabulary(freq)
    p = lm_score._init(v)
    seq = np.random.default_rng(2).integers(0, 3000, 15)
    ids, total = [v.end, *v.of[seq]], 0.0
    for k, full in enumerate([*seq, 3000]):
        q = p["E"][ids[k]] @ p["Q"] / np.sqrt(lm_score.ATTN)
        s = np.array([q @ (p["E"][ids[j]] @ p["K"]) + p["R"][k - j] for j in range(k + 1)])
        a = np.exp(s) / np.exp(s).sum()
        o = sum(a[j] * (p["E"][ids[j]] @ p["V"]) for j in range(k + 1))
        h = np.maximum(np.concatenate([p["E"][ids[k]], o]) @ p["W"] + p["b"], 0)
        y = v.of[full]
        c = h @ p["C"] + p["c"]
        m = h @ p["M"][v.cls[y]] + p["m"][v.cls[y]]
        total += c[v.cls[y]] - np.log(np.exp(c).sum()) + m[v.mem[y]] - np.log(np.exp(m).sum()) + v.tail[full]
    assert abs(lm_score.score_batch(lm_score._tables(p), v, [seq])[0] - total / np.log(10)) < 1e-3


def test_pieces_cover_whole_texts_and_models_are_averaged(spark):
    text = " ".join(f"w{k}" for k in range(3000))
    d = docs_of(spark, [(1, text), (2, None), (3, "short one")])
    rows = lm_score.pieces(d, 0.0, 1.1).collect()
    words = [w for r in rows for w in lm_score.piece_words(r.piece, r["first"], r["last"])]
    assert len(rows) == -(-len(text) // lm_score.PIECE) + 1 and set(words) <= {w.encode() for w in text.split()} | {b"short", b"one"} and len(words) > 2980
    counts = lm_score.word_counts(d)
    model, vocab = lm_score.fit(counts, d, steps=2)
    mean = lm_score._averaged(d, model, vocab, lm_score.VOCAB_PATH, 2, 2, 0.0)
    assert mean.keys() == model.keys() and all(mean[k].shape == model[k].shape and np.isfinite(mean[k]).all() for k in model)


def test_decontamination_in_several_passes(spark):
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = sorted(map(str, decontaminate.contamination(d, b).collect()))
    assert plain == sorted(map(str, decontaminate.contamination(d, b, max_broadcast=3, max_table=1 << 10).collect()))


def test_pipeline_stages(spark):
    """Each stage against a plain version of it, on what the one before kept."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    stages, docs = dict(corpus_pipeline.STAGES), d.toPandas().set_index("doc_id", drop=False)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "decontamination", "pii", "mixing"]

    def step(name, df):
        out = corpus_pipeline.cut(stages[name](spark, df, SF))
        if name != "mixing":
            assert out.columns == d.columns
        return out, out.toPandas().set_index("doc_id", drop=False)

    names, weights = langid.fit(d.where(~corpus_pipeline.held_out(F.col("doc_id"), 5)))

    def likely(t):
        c = langid.codes(t or "")
        s = np.bincount(langid.features(c), minlength=1 << langid.BITS) @ weights.astype(float) / max(1, len(langid.features(c)))
        return len(c) and 1 / np.exp(s - s.max()).sum() >= corpus_pipeline.LEAST_LANGUAGE_SCORE

    one, kept = step("language_id", d)
    assert set(kept.doc_id) == {i for i, t in docs.text.items() if likely(t)} and len(kept) == kept.doc_id.nunique()
    before, (two, kept) = kept, step("minhash_dedup", one)
    close, aligned = brute_groups(before.text.fillna("").to_dict())
    gone = set(before.doc_id) - set(kept.doc_id)
    assert all(aligned.get(i, i) in {aligned[k] for k in kept.doc_id if k in aligned} for i in gone)  # each group keeps a row
    assert all(sum(close[i] == g for i in kept.doc_id if i in close) <= 1 for g in set(close.values()))
    before, (three, kept) = kept, step("decontamination", two)
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    windows = {tuple(w[k: k + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := words(r.text)) for k in range(max(1, len(w) - 9))}
    lens = {len(w) for w in windows}
    hit = {i for i, t in before.text.items() if any(tuple(w[k: k + n]) in windows for w in [words(t)] for n in lens for k in range(len(w) - n + 1))}
    assert hit and set(kept.doc_id) == set(before.doc_id) - hit
    assert not any(pii.disclosing_terms(three).values())
    before, (four, kept) = kept, step("pii", three)
    for i, t in before.text.items():
        out, last = "", 0
        for a, b, k in sorted((a, -b, k) for k, a, b in plain(t)):
            if -b > last:
                out, last = out + t[last:max(a, last)] + f"[{k.upper()}]", -b
        assert kept.text[i] == out + t[last:] and kept.n_chars[i] == len(kept.text[i])
    assert (before.text != kept.text.loc[before.index]).any()
    five, mixed = step("mixing", four)
    import duckdb
    c = duckdb.connect()
    c.register("documents", kept.reset_index(drop=True))
    want = c.sql(mixing.ORACLE).df()
    pick = lambda x, e, t: sorted(zip(x.doc_id, x[e], x[t]))
    assert len(mixed) and pick(mixed, "mix_epoch", "mix_tokens") == pick(want, "epoch", "n_tokens")


def test_large_buckets_block_by_block(spark, monkeypatch):
    """Every pair of a key's texts that is in two components is compared, whatever the blocks."""
    rng = np.random.default_rng(8)
    passage, texts = rng.integers(0, 1 << 32, 40, dtype=np.uint32), []
    for n in rng.integers(45, 160, 90):
        texts.append(np.concatenate([passage, rng.integers(0, 300, n - 40).astype(np.uint32)]))
        if rng.random() < 0.4:  # a copy with some words replaced, around the bound
            t = texts[-1].copy()
            at = rng.choice(n, int(rng.uniform(0.02, 0.25) * n), replace=False)
            t[at] = rng.integers(1 << 20, 1 << 21, len(at))
            texts.append(t)
    linked = {(i, j) for i in range(len(texts)) for j in range(i) if minhash.similar(texts[i], texts[j], 0.8)}

    def parts(links):
        up = list(range(len(texts)))
        for _ in texts:
            for a, b in links:
                up[a] = up[b] = min(up[a], up[b])
        return up

    members = spark.createDataFrame([(key, i, sum(map(len, texts)), i) for key in (1, 2) for i in range(len(texts))], "key long, cid long, words long, lab long")
    held = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "cid long, w binary")
    for words in (1 << 17, 1500):
        monkeypatch.setattr(minhash, "BLOCK_WORDS", words)
        found = {(max(r.a, r.b), min(r.a, r.b)) for r in minhash._block_links(members, held, 0.8).collect()}
        assert found <= linked and parts(found) == parts(linked)
    assert linked


def test_rarest_runs_lose_no_pair(spark, monkeypatch):
    """Texts that share a passage: all similar ones in different components are linked, whatever the table of runs."""
    rng = np.random.default_rng(9)
    passage, texts = rng.integers(0, 1 << 32, 30, dtype=np.uint32), [np.array([5], np.uint32), np.array([5, 6], np.uint32)]
    for n in [*rng.integers(2, 12, 40), *rng.integers(45, 130, 80)]:
        texts.append(np.concatenate([passage[: n // 2], rng.integers(0, 40 if n % 2 else 5000, n - n // 2).astype(np.uint32)]))
        t = texts[-1].tolist()
        for _ in range(int(rng.uniform(0, 0.25) * n)):  # words replaced, added and dropped, up to the bound and beyond
            at = int(rng.integers(0, len(t)))
            t[at: at + int(rng.integers(0, 2))] = rng.integers(0, 5000, int(rng.integers(0, 2))).tolist()
        texts.append(np.array(t or [1], np.uint32))
    texts.append(texts[-1])
    lab = [i if i % 7 else 0 for i in range(len(texts))]
    pool = spark.createDataFrame([(i, x) for i, x in enumerate(lab)], "cid long, lab long")
    held = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "cid long, w binary").repartition(5)

    def parts(links):
        up = list(lab)
        for _ in texts:
            for a, b in links:
                x, y = sorted((up[a], up[b]))
                up = [x if v == y else v for v in up] if x != y else up
        return up

    for threshold, slots, row in ((0.8, 1 << 24, 1 << 16), (0.8, 16, 4), (0.7, 1 << 12, 1 << 8), (0.9, 1 << 24, 1 << 16)):
        monkeypatch.setattr(minhash, "SLOTS", slots)
        monkeypatch.setattr(minhash, "SLOT_ROW", row)
        linked = {(i, j) for i in range(len(texts)) for j in range(i) if lab[i] != lab[j] and minhash.similar(texts[i], texts[j], threshold)}
        found = {(max(r.a, r.b), min(r.a, r.b)) for r in minhash._run_links(pool, held, threshold).collect()}
        assert linked and found <= linked and parts(found) == parts(linked)
    assert not minhash._run_links(pool.limit(0), held, 0.8).count()


def test_embeddings_disk_does_not_grow_with_the_pairs(spark):
    """Vectors without any structure, in many cells and blocks, whose pairs must nearly all be compared."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[2990:] = x[:10] * 2 + 0.01
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sum(e.totalShuffleWrite() for e in [sc.statusStore().executorList(True).apply(0)])

    before = written()
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, cell=60, block=20).collect()}
    assert written() - before < 5 * x.nbytes
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.95).sum(1) - 1).tolist()))


def test_language_model_learns_from_every_piece(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FIRST", 20)
    monkeypatch.setattr(lm_score, "PER_WORKER", 40)
    d = docs_of(spark, [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(1200))) for i in range(40)])
    total, drawn, pieces = lm_score.pieces(d, 0.0, 1.0).count(), [], lm_score.pieces
    monkeypatch.setattr(lm_score, "pieces", lambda *a: drawn.append(pieces(*a).count()) or pieces(*a))
    counts = lm_score.word_counts(d)
    model, vocab = lm_score.fit(counts, d, steps=30)
    assert total > 80 and max(drawn) == total
    # and from every id of a piece, once
    lens = np.array([2, 25, 26, 49, 100])
    first = np.cumsum(lens) - lens
    for shift in (0, 7):
        hit = np.bincount((lm_score.window_starts(first, lens, shift)[:, None] + np.arange(1, lm_score.WINDOW + 1)).ravel(), minlength=400)
        assert all((hit[a + 1: a + n] >= 1).all() for a, n in zip(first, lens))
    at = [lm_score.window_starts(np.array([0]), np.array([n])).tolist() for n in lens]
    assert at == [[0], [0], [0, 24], [0, 24], [0, 24, 48, 72, 96]]


def test_language_model_gradients():
    """A step's gradient lowers the loss: training on one text makes it likely."""
    v = lm_score.Vocabulary(np.ones(3001))
    seq = np.random.default_rng(3).integers(0, 1500, 60)
    ids = np.concatenate([[v.end], v.of[seq], [v.end]])
    plain, learned = (lm_score.score_batch(lm_score._tables(lm_score.train([ids], v, steps, batch=8)), v, [seq])[0] for steps in (0, 150))
    assert learned > 0.5 * plain


def test_large_buckets_are_not_joined_member_by_member(spark, monkeypatch):
    """Texts that share half of their words fill large buckets: the pool holds all their classes, and few memberships meet the buckets' keys again."""
    rng = np.random.default_rng(15)
    texts = [" ".join([f"p{k}" for k in range(75)] + [f"w{x}" for x in rng.integers(0, 100_000, 75)]) for _ in range(150)]
    d = docs_of(spark, list(enumerate(texts)))
    monkeypatch.setattr(minhash, "SMALL", 8)
    held = {}
    for r in minhash.sketches(d, 0.8).collect():
        for k in set(r["keys"]):
            held.setdefault(k, set()).add(r.doc_id)
    large = [x for x in held.values() if len(x) > 8]
    seen, real = [], minhash._run_links

    def joined(node):
        if "AdaptiveSparkPlan" in node.nodeName():
            return joined(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return joined(node.plan())
        own = int(node.metrics().apply("numOutputRows").value()) if "LeftSemi" in node.toString().split("\n")[0] else 0
        return own + sum(joined(node.children().apply(i)) for i in range(node.children().size()))

    def spy(pool, *rest):
        rows = pool.collect()
        seen.append((len(rows), joined(pool._jdf.queryExecution().executedPlan())))
        return real(pool, *rest)

    monkeypatch.setattr(minhash, "_run_links", spy)
    assert minhash.near_duplicates(d).where("kept").count() == len(texts)
    assert seen[0][0] == len(set().union(*large)) and 0 < seen[0][1] < sum(map(len, large)) / 3


def test_mixing_shuffles_no_texts(spark):
    """Long texts, some of them repeated: the mix holds what choose() tells, and the texts stay where they are."""
    words = np.random.default_rng(16).integers(0, 10**9, (400, 300))
    d = docs_of(spark, [(i, " ".join(map(str, w))) for i, w in enumerate(words)] + [(5, "one two")] * 9).localCheckpoint()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")  # as on a large table
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    try:
        for weights in (mixing.WEIGHTS, {"domain": {}, "language": {}, "source": {"src0": 3}}):
            before = written()
            got = mixing.mix(d, weights).select("doc_id", "text", "__m_epoch", "__m_tokens").collect()
            assert written() - before < 400 * 1000
            want = mixing.choose(d, weights).collect()
            assert got and sorted((r.doc_id, r["__m_epoch"], r["__m_tokens"]) for r in got) == sorted((r.doc_id, r["__m_epoch"], r["__m_tokens"]) for r in want for _ in range(r["__m_take"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_language_model_step_costs(monkeypatch):
    """Models that a worker trains one after another share the vocabulary and the words' ids, and a step's gradients go by these sums."""
    loads, encoding, encoded = [], lm_score.encoding, []
    monkeypatch.setattr(lm_score, "encoding", lambda path: loads.append(path) or encoding(path))
    monkeypatch.setattr(lm_score.Encoder, "many", lambda self, words, many=lm_score.Encoder.many: encoded.extend(words) or many(self, words))
    v = lm_score.Vocabulary(np.ones(60_000))
    a, b = (lm_score._sequences([(0.5, "alpha beta alpha qqzq", True, True)], v, lm_score.VOCAB_PATH) for _ in range(2))
    assert len(loads) <= 1 and len(encoded) <= 3 and len(a) == 1 and a[0].tolist() == b[0].tolist()
    rng = np.random.default_rng(7)
    for n in (1, 9, 500):
        x, begin = rng.standard_normal((n, 5)), np.unique(np.append(0, rng.integers(0, n, n // 6)))
        assert np.allclose(lm_score._sums(x, begin), np.add.reduceat(x, begin))
    s, share, target = rng.standard_normal((6, 32)).astype(np.float32), np.full(6, 0.5, np.float32), np.arange(6)
    e = np.exp(s.astype(float))
    want = 0.5 * (e / e.sum(1, keepdims=True) - np.eye(6, 32))
    assert np.allclose(lm_score._softmax_less_target(s.copy(), share, target), want, atol=1e-6)
    assert np.allclose(lm_score._softmax_less_target(s + np.float32(1000), share, target), want, atol=1e-4)  # beyond what exp holds
