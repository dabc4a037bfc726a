"""Every operator on awkward and on empty tables, and against brute force."""

import base64
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("groma.llm")
from groma.llm import discriminant, mixing, neardup, nearest, personal, repeats, rules, secrets, warc  # noqa: E402
from groma.llm.common import cut_out, listed, scratch_path  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_mixing_takes_whole_copies(spark, awkward, nothing):
    got = rows_of(mixing.mix(awkward))
    assert len(got) == awkward.count()
    for r in got:
        size = len(WORD.findall(r["text"] or ""))
        assert r["size"] == size and r["taken"] == r["copies"] * size <= 2 * size and r["target"] <= 2 * r["source_size"]
    assert got and sum(r["copies"] for r in got) == mixing.emit(mixing.mix(awkward)).count()
    assert mixing.mix(nothing).count() == 0


def test_mixing_comes_near_its_targets_and_agrees_with_itself(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want")).collect()
    assert all(abs(r.t / r.want - 1) < 0.1 for r in got)
    assert sorted(map(str, rows_of(mixing.mix(docs)))) == sorted(map(str, rows_of(mixing.mix(docs.repartition(7)))))


def components_by_hand(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(lower))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_near_duplicates_against_all_pairs(spark):
    rng, vocabulary = random.Random(11), [f"w{i}" for i in range(900)]
    docs = []
    for _ in range(25):  # families that drift, so that links form chains
        body = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(1, 14)):
            docs.append((len(docs), " ".join(body)))
            if rng.random() < 0.8:
                body = list(body)
                for _ in range(rng.randint(1, 3)):
                    body[rng.randrange(len(body))] = rng.choice(vocabulary)
    docs += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  B"), (1004, "a b c d e")]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == components_by_hand(docs)


def test_near_duplicates_around_a_shared_passage(spark, monkeypatch):
    """Documents that quote one passage are close to no hub: what the rounds leave is joined pair by pair, with the same result."""
    rng = random.Random(12)
    passage, docs = [f"p{i}" for i in range(64)], []
    for i in range(60):
        body = passage + [f"u{i}x{j}" for j in range(72)]
        docs.append((2 * i, " ".join(body)))
        if i % 3 == 0:
            body[rng.randrange(len(body))] = "other"
            docs.append((2 * i + 1, " ".join(body)))
    df, want = spark.createDataFrame(docs, "doc_id long, text string"), components_by_hand(docs)
    assert sum(not kept for _, _, kept in want.values()) == 20
    anew, whole = [], neardup.banded
    for rounds, deep in ((neardup.ROUNDS, neardup.DEEP), (1, 0.99)):
        monkeypatch.setattr(neardup, "ROUNDS", rounds)
        monkeypatch.setattr(neardup, "DEEP", deep)
        monkeypatch.setattr(neardup, "banded", lambda *a: anew.append(1) or whole(*a))
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()} == want
    assert anew


def stock_documents(n):
    """Documents put together from five of fifty stock passages, every tenth one copied with a word changed."""
    rng = random.Random(n)
    stock = [[f"s{i}w{j}" for j in range(40)] for i in range(50)]
    docs = []
    for i in range(n):
        body = [w for p in rng.sample(stock, 5) for w in p]
        docs.append((2 * i, " ".join(body)))
        if i % 10 == 0:
            body[rng.randrange(len(body))] = f"x{i}"
            docs.append((2 * i + 1, " ".join(body)))
    return docs


def test_near_duplicates_of_stock_passages_cost_as_much_as_their_number(spark, monkeypatch):
    """Rows of every join grow with the documents, not with the square of those that share a passage; components are those of all pairs."""
    rows, spied = {}, {name: getattr(neardup, name) for name in ("starred", "banded", "confirmed")}
    for n in (500, 1000, 2000):
        counts = rows.setdefault(n, [])
        for name, whole in spied.items():
            monkeypatch.setattr(neardup, name, lambda *a, whole=whole, counts=counts: (out := whole(*a), counts.append(out.count()))[0])
        docs = stock_documents(n)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        if n < 2000:
            assert got == components_by_hand(docs)
        assert sum(not kept for *_, kept in got.values()) >= n // 10
    assert sum(rows[2000]) < 2.6 * sum(rows[1000]) < 2.6 * 2.6 * sum(rows[500])


def test_near_duplicates_of_one_large_group(spark):
    """One text with few to many words replaced, left out or put in: links, chains, and members linked with nothing."""
    rng = random.Random(13)
    base, docs = [f"b{i}" for i in range(150)], []
    for i in range(400):
        body = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 8, 16])):
            at = rng.randrange(len(body))
            body[at : at + 1] = rng.choice([[f"n{rng.randrange(40)}"], [], [body[at], f"n{rng.randrange(40)}"]])
        docs.append((i, " ".join(body)))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = components_by_hand(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want and sum(k for _, _, k in want.values()) > 20


def test_near_duplicates_of_awkward_and_no_rows(spark, awkward, nothing):
    got = rows_of(neardup.near_duplicates(awkward))
    assert len(got) == awkward.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1)} == {0}
    assert neardup.near_duplicates(nothing).count() == 0


def spans_by_hand(text, patterns):
    found = []
    for n, (kind, pattern, good) in enumerate(patterns):
        found += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text) if good(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def luhn(m):
    d = [int(c) for c in re.sub(r"\D", "", m[0])][::-1]
    return 14 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m[0])) <= 15),
]
PARTS = ["password", "TOKEN", "api_key", '"', "'", ":", "=", " ", "  ", "abc", "0f" * 13, "AKIA", "ABCD1234EFGH5678", ".", "-", "+", "1", "22", "256", "4111111111111111", "@", "x.y", "(555)", "\n", "é", "\U0001f600", "s3cret_", "a1b2c3"]


def test_base_spans_on_fuzzed_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for module, patterns in ((secrets, SECRETS), (personal, PERSONAL)):
        got = df.select("doc_id", listed(module.sorted_spans([module.base_spans(F.col("text"))], module.KINDS)).alias("s")).collect()
        for r in got:
            assert r.s == spans_by_hand(texts[r.doc_id], patterns), texts[r.doc_id]


def test_secrets_beyond_the_patterns(spark, awkward, nothing):
    # identifiers need a vocabulary to learn from: words of alternating consonants and vowels
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 5)))
    model = secrets.train(secrets.labelled_samples(spark.createDataFrame([(" ".join(word() for _ in range(200)),) for _ in range(100)], "text string")))
    keys = [base64.b64encode(hashlib.sha256(b"%d" % i).digest()).decode().rstrip("=") for i in range(60)]
    names = [f"{word()}_{word()}_{word()}{i}" for i in range(60)] + [f"{word().title()}{word().title()}{word().title()}{i}" for i in range(60)]
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(keys + names)], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.found] for r in secrets.scan(df, model).collect()}
    assert sum(got[i] == ["random"] for i in range(60)) >= 50
    assert not any(got[i] for i in range(60, 180))
    masked = secrets.scan(df.filter("doc_id in (0, 60)"), model).select("doc_id", secrets.redact(F.col("text"), F.col("found")).alias("t"), F.size("found").alias("n")).collect()
    assert all(r.t == ("see [SECRET] there" if r.n else df.filter(df.doc_id == r.doc_id).first().text) for r in masked)
    assert secrets.scan(awkward, model).count() == awkward.count() and secrets.scan(nothing, model).count() == 0


def test_secrets_of_awkward_rows(awkward, nothing):
    never = [-1.0] * secrets.SIZE**2
    got = secrets.scan(awkward, never)
    assert got.columns == [c for c in awkward.columns if c not in ("base", "found")] + ["base", "found"]
    rows = got.collect()
    text = next(r.text for r in rows if r.doc_id == 9)
    assert [(r.doc_id, [(s.kind, text[s.start : s.end]) for s in r.found]) for r in rows if r.found] == [(9, [("assign", "password = hunter2hunter2")])]
    assert len(rows) == awkward.count() and secrets.scan(nothing, never).count() == 0


def test_secrets_model_when_copies_come_first(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 5)))
    texts = ["all seven words come from one copy"] * 800 + [" ".join(word() for _ in range(200)) for _ in range(100)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    model = secrets.train(secrets.labelled_samples(docs))
    assert model == secrets.train(secrets.labelled_samples(docs.distinct().orderBy(F.desc("text"))))
    keys = [base64.b64encode(hashlib.sha256(b"%d" % i).digest()).decode().rstrip("=") for i in range(60)]
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(keys)], "doc_id long, text string")
    assert sum([s.kind for s in r.found] == ["random"] for r in secrets.scan(df, model).collect()) >= 50


def test_secrets_of_letters_only(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 5)))
    model = secrets.train(secrets.labelled_samples(spark.createDataFrame([(" ".join(word() for _ in range(200)),) for _ in range(100)], "text string")))
    keys = ["".join(rng.choice(letters) for _ in range(24)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(40)]
    plain = [f(word() + word() + word() + word()) for f in (str.lower, str.upper) for _ in range(20)] + [f"{word()}_{word()}_{word()}_{word()}".upper() for _ in range(20)]
    plain += ["-" * 40, "=" * 24, "a" * 20, "x" + "-" * 30, "-=" * 12, "2024-01-15-10-30-00", "4539-1488-0343-6467"]
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(keys + plain)], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.found] for r in secrets.scan(df, model).collect()}
    assert all(sum(got[i] == ["random"] for i in part) >= 35 for part in (range(40), range(40, 80)))
    assert not any(got[80 + i] for i in range(len(plain)))


def test_personal_contexts_find_new_identifiers(spark, awkward, nothing):
    """Nine e-mail addresses and twelve phones teach two contexts; identifiers of other forms there are found, equal ones elsewhere are not."""
    rng = random.Random(21)
    texts = [f"please call my number +1 (415) 555-{1000 + 37 * i} soon" for i in range(12)] + [f"write to contact: user{i}@mail.example.com thanks" for i in range(9)]
    new = ["write to contact: 5551234567@local thanks", "write to contact: user77@mailhost thanks", "please call my number (743) 555-3824 soon", "Please call my number 0800/555123 soon!"]
    plain = [f"{rng.choice('abcdef')} box holds {10000 + i} parts" for i in range(30)] + ["the parts list has 5551234 lines", "my number was lost", "contact: nobody"]
    got = personal.find(spark.createDataFrame(list(enumerate(texts + new + plain)), "doc_id long, text string")).collect()
    by = {r.doc_id: [(s.kind, (texts + new + plain)[r.doc_id][s.start : s.end]) for s in r.found] for r in got}
    assert all(by[i][0][0] == ("phone" if i < 12 else "email") and len(by[i]) == 1 for i in range(21))
    assert [by[21 + i] for i in range(4)] == [[("context", x)] for x in ("5551234567@local", "user77@mailhost", "(743) 555-3824", "0800/555123")]
    assert not any(by[i] for i in range(25, len(by)))
    # however long it is: an identifier in groups, of more than 64 characters
    wide = "please call my number " + " ".join(["0800/5551", "234-99"] * 6) + " soon"
    one = personal.find(spark.createDataFrame([*enumerate([*texts, wide])], "doc_id long, text string")).filter(F.col("doc_id") == len(texts)).first()
    assert [(s.kind, wide[s.start : s.end]) for s in one.found] == [("context", wide[22:-5])]
    found = personal.find(awkward).collect()
    assert len(found) == awkward.count() and sum(len(r.found) for r in found) == 1 and personal.find(nothing).count() == 0


def test_spans_of_very_many_matches(spark):
    text = " ".join(f"ann{i}@example.org" for i in range(64_000))
    began = time.time()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = df.select(personal.base_spans(F.col("text")).alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1)["end"].alias("end")).first()
    assert (got.n, got.end) == (64_000, len(text)) and time.time() - began < 20


def test_cutting_out(spark):
    rng = random.Random(31)
    rows = []
    for i in range(200):
        text = "".join(rng.choice(["a", "é", "\U0001f600", "\ufeff", " ", "\n"]) for _ in range(rng.randint(1, 700)))
        cuts = sorted((a, min(len(text), a + rng.randint(1, 9))) for a in (rng.randrange(len(text)) for _ in range(rng.randint(1, 400))))
        rows.append((i, text, cuts))
    df = spark.createDataFrame(rows, "i int, text string, cuts array<struct<start:int,stop:int>>")
    got = {r.i: r.t for r in df.select("i", cut_out(F.col("text"), F.col("cuts"), "<>").alias("t")).collect()}
    for i, text, cuts in rows:
        at, out = 0, []
        for a, b in cuts:
            if a >= at:
                out += [text[at:a], "<>"]
            at = max(at, b)
        assert got[i] == "".join(out) + text[at:]


def test_discriminant_on_held_out_rows(spark, awkward, nothing):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "slowly", "evening", "letter", "garden"]) + rng.choice(["", ",", "."]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY", "!!!", "$$$", "click", "#1", "FREE"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = discriminant.train(docs, docs.select("doc_id", "quality"), ~discriminant.held_out(F.col("doc_id")))
    held = docs.filter(discriminant.held_out(F.col("doc_id")))
    assert all(r.predicted == r.quality for r in discriminant.score(held, model).collect())
    scored = rows_of(discriminant.score(awkward, model))
    assert len(scored) == awkward.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert discriminant.score(nothing, model).count() == 0
    none = discriminant.train(docs, docs.select("doc_id", "quality").filter("quality = 1"), F.lit(True))
    assert {r.score for r in discriminant.score(awkward, none).collect()} == {0.5}


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    x = [[float(v) for v in centres[i % 20] + 0.3 * rng.standard_normal(16)] for i in range(3000)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (5004, []), (100, x[100])]
    df = spark.createDataFrame([*enumerate(x), *odd], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    a, hits = np.array(x), 0
    assert set(got) == set(range(0, 3000, 100))
    for q, found in got.items():
        d = np.sqrt(((a - a[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({v for v, _ in found.values()} & set(np.argsort(d, kind="stable")[:10].tolist()))
        assert all(abs(d[v] - s) < 1e-9 for v, s in found.values()) and sorted(found) == list(range(1, 11))
    assert hits >= 0.9 * 10 * len(got)


def test_neighbours_where_half_the_vectors_are_copies(spark):
    """Copies and near copies make the usual distance vanish; queries outside their groups need their own."""
    rng = np.random.default_rng(3)
    single = rng.standard_normal((1400, 64)) + rng.standard_normal((14, 64))[np.arange(1400) % 14]
    groups = np.concatenate([np.repeat(single[:1], 1000, axis=0), single[1] + 1e-6 * rng.standard_normal((600, 64))])
    a = np.concatenate([single, groups])
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(a)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, (F.col("vec_id") % 35 == 5) | (F.col("vec_id") == 2000)).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    recalls = {}
    for q, found in got.items():
        d = np.sqrt(((a - a[q]) ** 2).sum(1))
        d[q] = np.inf
        assert len(found) == 10
        recalls[q] = np.mean([s <= np.sort(d)[9] + 1e-6 for _, s in found])
    outside = [v for q, v in recalls.items() if q < 1400]
    assert len(outside) == 40 and np.mean(outside) >= 0.9 and recalls[2000] == 1


def test_probes_come_in_the_order_of_their_chances():
    rng = np.random.default_rng(4)
    held = nearest.Hashes(rng.standard_normal((200, 8)), 1.0, 1, 4, 3.0, 2, 0.9, 1)
    chance = rng.dirichlet(np.ones(5), 4)
    moves, enough = held.agenda(chance)
    products = np.prod(chance[np.arange(4)[None], moves + 2], axis=1)
    every = np.sort([a * b * c * d for a in chance[0] for b in chance[1] for c in chance[2] for d in chance[3]])[::-1]
    assert enough and len(set(map(tuple, moves))) == len(moves) and np.allclose(products, every[: len(moves)])
    assert products.sum() >= 0.9 > products[:-1].sum()


def test_neighbours_of_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in nearest.search(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert nearest.search(df.filter("false"), F.lit(True)).count() == 0


def test_warc_round_trip(spark):
    big = "<p>héllo</p>" * 20
    rows = [(3, "http://a/ b", big), (1, None, big), (2, "http://c", "tiny"), (4, "http://d", "tiny"), (5, "http://e", None), (None, "http://f", big), (6, "http://g", "y" * 700_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, frame int")
    root = scratch_path(spark, "test-warc")
    index = warc.write(pages, root)
    got = {r.page_id: r for r in warc.read(index, root, payloads=True).collect()}
    assert len(got) == len(rows) and {k: (r.record_type, r.refers_to) for k, r in got.items()} == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 1), 6: ("response", None)}
    for page, _, html in rows:
        data = (html or "").encode()
        assert got[page].payload_bytes == len(data) and got[page].payload_digest == hashlib.sha256(data).hexdigest()
        assert got[page].record_type == "revisit" or bytes(got[page].payload) == data
    one = warc.fetch(index, root, spark.createDataFrame([(2,)], "page_id long")).collect()
    assert [bytes(r.payload) for r in one] == [b"tiny"]
    none = warc.write(pages.filter("false"), f"{root}-none")
    assert warc.read(none, f"{root}-none").count() == 0


def test_rules_statistics_by_hand(spark, awkward, nothing):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a ", "b ", "cc ", "# ", "\n", "\t", "x|y "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        n = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        inside = {k for j in range(len(w) - 7) if n[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)
    assert rules.judge(awkward).count() == awkward.count() and rules.judge(nothing).count() == 0


def test_repeated_units_keep_the_first(spark, awkward, nothing):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen. Fourteen fifteen sixteen seventeen eighteen nineteen twenty more words to come now."
    docs = spark.createDataFrame([(2, f"Quoted here {long[4:]}\nshort\nAll rights reserved."), (1, f"head start {long.upper()}\nAll rights reserved."), (3, None), (4, ""), (5, f"new start. {long} new end")], "doc_id long, text string")
    gone = {(r.doc_id, r.unit): r for r in repeats.repeated(repeats.units(docs), run_words=10).collect()}
    assert {k: r.removed for k, r in gone.items()} == {(2, 1): True, (2, 3): False, (5, 2): True}
    assert (gone[2, 1].first_doc_id, gone[2, 1].first_unit) == (1, 1) and gone[2, 1].run_words == 12
    cut = {r.doc_id: r.text for r in repeats.cut(docs, repeats.repeated(repeats.units(docs), run_words=10)).collect()}
    assert cut[2] == "Quoted here two three four five six seven eight nine ten eleven twelve thirteen. short\nAll rights reserved." and cut[3] is None
    whole = repeats.cut(awkward, repeats.repeated(repeats.units(awkward)))
    assert whole.columns[:-1] == [c for c in awkward.columns if c != "cuts"] and whole.count() == awkward.count()
    assert {r.text for r in whole.filter("doc_id = 0").collect()} == {awkward.filter("doc_id = 0").first().text}  # equal rows stay together
    assert repeats.repeated(repeats.units(nothing)).count() == 0 and repeats.cut(nothing, repeats.repeated(repeats.units(nothing))).count() == 0


def test_repeated_units_by_hand(spark):
    rng = random.Random(41)
    sentence = lambda: " ".join(rng.choice(["red", "Red", "blue", "sea", "sky", "old"]) for _ in range(rng.randint(1, 7))) + rng.choice([". ", ".\n", "! ", "\n", " "])
    pool = [sentence() for _ in range(40)]
    docs = [(i, "".join(rng.choice(pool) if rng.random() < 0.7 else sentence() for _ in range(rng.randint(0, 20)))) for i in range(150)]
    tile, seen, want = re.compile(repeats.TILES["sentence"]), set(), {}
    for i, t in docs:
        run, spots = [], []
        flush = lambda: spots.extend(f"{a}:{b}" for a, b, _ in run) if sum(n for *_, n in run) >= repeats.RUN_WORDS else None  # noqa: B023, E731
        for m in tile.finditer(t):
            w = WORD.findall(m[0])
            if not w:
                continue
            key = " ".join(w).lower()
            if key in seen:
                run.append((m.start(), m.end(), len(w)))
            else:
                flush()
                run = []
                seen.add(key)
        flush()
        want[i] = ",".join(spots)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    gone = repeats.repeated(repeats.units(df)).filter("removed").collect()
    got = {i: "" for i, _ in docs}
    for r in sorted(gone, key=lambda r: r.start):
        got[r.doc_id] += ("," if got[r.doc_id] else "") + f"{r.start}:{r.stop}"
    assert got == want and any(want.values())


def test_repeated_units_query_on_awkward_rows(spark, awkward, nothing, tmp_path):
    """Null ids, equal rows and rows that share an id alone are counted apart, against plain loops."""
    first, second = "alpha beta gamma delta epsilon zeta eta theta.", "iota kappa lambda mu nu xi omicron pi."
    rows = [(None, f"{first} {second}"), (None, None), (1, f"{first} {second}"), (1, f"{first} {second}"), (2, "only this."), (2, f"{second} and more."), (3, ""), (3, None)]
    rows += [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = repeats.query(spark, str(tmp_path)).collect()
    tile = re.compile(repeats.TILES["sentence"])
    units = {(d, t or ""): [" ".join(WORD.findall(m[0])).lower() for m in tile.finditer(t or "") if WORD.findall(m[0])] for d, t in rows}
    # every place of a unit but its first one is a repeat; equal rows are one document
    every = Counter(u for own in units.values() for u in own)
    assert sum(r.n_repeated for r in set(got)) == sum(n - 1 for n in every.values())
    assert sorted(r.n_units for r in got) == sorted(len(units[d, t or ""]) for d, t in rows)
    assert [r.n_units for r in got if r.doc_id is None] and {r.n_units for r in got if r.doc_id == 2} == {1, 2}
    assert {r.n_units for r in got if r.doc_id == 1 and r.n_units} >= {2}
    assert repeats.counted(nothing, repeats.units(nothing)).count() == 0


def test_discriminant_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (60, 9)), rng.normal(0.7, 1.5, (40, 9))])
    label = np.array([0] * 60 + [1] * 40)
    model = discriminant.fit(pd.DataFrame({"x": list(x), "label": label}), {0: 600, 1: 400})
    pooled = sum((x[label == c] - x[label == c].mean(0)).T @ (x[label == c] - x[label == c].mean(0)) for c in (0, 1)) / len(x)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "i int, x array<double>")
    got = {r.i: r for r in df.select("i", model[0].log_density(F.col("x")).alias("a"), model[1].log_density(F.col("x")).alias("b")).collect()}
    for c, name in ((0, "a"), (1, "b")):
        own = x[label == c]
        cov = 0.7 * np.cov(own.T, bias=True) + 0.3 * pooled
        cov = 0.9 * cov + 0.1 * (np.trace(cov) / 9 + 1e-6) * np.eye(9)
        for i, row in enumerate(x):
            d = row - own.mean(0)
            want = np.log((0.6, 0.4)[c]) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.solve(cov, d)
            assert abs(got[i][name] - want) < 1e-8


def test_discriminant_with_clashing_names_and_repeated_ids(spark, awkward):
    labels = spark.createDataFrame([(0, 1, "x"), (1, 1, "x"), (2, 1, "x"), (7, 0, "x"), (8, 0, "x"), (None, 0, "x")], "doc_id long, quality int, label string")
    model = discriminant.train(awkward, labels, F.lit(True))
    many = awkward.unionByName(awkward.filter("doc_id = 0")).unionByName(awkward.filter("doc_id = 0"))
    again = discriminant.train(many, labels, F.lit(True))
    assert np.array_equal(model[1].mean, again[1].mean)
    scored = discriminant.score(awkward, model)
    assert scored.count() == awkward.count() and {r.label for r in scored.collect()} == {r.label for r in awkward.collect()}


def test_rules_expectation_maximisation_by_hand(spark):
    rng = np.random.default_rng(2)
    truth = rng.random(400) < 0.7
    accuracy = {"a": 0.9, "b": 0.75, "c": 0.6}
    votes = {k: np.where(rng.random(400) < 0.2, 0, np.where((rng.random(400) < p) == truth, 1, -1)) for k, p in accuracy.items()}
    table = pd.DataFrame(votes).groupby(list(votes)).size().reset_index(name="n")
    prior, own = 0.8, dict.fromkeys(votes, 0.8)
    post = lambda: 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + sum(table[k] * np.log(own[k] / (1 - own[k])) for k in own))))
    for _ in range(rules.ROUNDS):
        p, n = post(), table["n"]
        before = dict(own)
        own = {k: ((n * np.where(table[k] == 1, p, np.where(table[k] == -1, 1 - p, 0))).sum() + 4) / (n[table[k] != 0].sum() + 5) for k in own}
        prior = ((n * p).sum() + 4) / (n.sum() + 5)
        if max(abs(before[k] - own[k]) for k in own) < rules.SETTLED:
            break
    model = rules.fit(spark.createDataFrame(table), list(votes))
    assert abs(model["prior"] - prior) < 1e-9 and all(abs(model["accuracy"][k] - own[k]) < 1e-9 for k in own)
    assert model["accuracy"]["a"] > model["accuracy"]["b"] > model["accuracy"]["c"]
    got = spark.createDataFrame(table).select(*votes, rules.posterior(model).alias("p")).toPandas().sort_values(list(votes))
    assert np.allclose(got["p"], post()[table.sort_values(list(votes)).index])
    even = {"prior": 0.5, "accuracy": {"a": 0.5, "b": 0.5, "c": 0.5}}
    assert spark.createDataFrame(table).filter(rules.posterior(even) >= rules.KEEP_AT).count() == len(table)  # a tie is kept


def test_rules_of_awkward_rows(awkward):
    got = {}
    for r in rules.judge(awkward).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [(r.n_words, r.base_failed, r.kept) for r in got[3] + got[4] + got[5]] == [(0, True, False)] * 3
    assert len(got[0]) == 2 and got[0][0] == got[0][1] and got[0][0].n_words == 23 and not got[0][0].base_failed
    assert (got[7][0].n_words, got[7][0].word_chars) == (1, 60_000) and got[8][0].n_repeat_words == 18_000 and got[8][0].base_failed


def test_tables_of_tokens_are_not_broadcast(spark, monkeypatch):
    """They grow with the documents, and rows take many times the bytes of their files; the driver would hold them whole."""
    plans, scratch = [], neardup.scratch
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(neardup, "scratch", lambda df, name: scratch(plan(df), name))
    rng = random.Random(12)
    stock = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    # a passage that grows: neighbours in it are linked, those far apart are not
    docs = [(i, " ".join(stock[: 60 + 5 * i])) for i in range(60)] + [(100 + i, " ".join(stock[: 60 + 5 * i])) for i in range(60)]
    got = plan(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == components_by_hand(docs)
    keys = [k for p in plans for k in re.findall(r"(?:BroadcastHashJoin|SortMergeJoin) \[(.*?)\], \[", p)]
    sent = [k for p in plans for k in re.findall(r"BroadcastHashJoin \[(.*?)\], \[", p)]
    assert [k for k in keys if re.match(r"token#\d+L, lower#", k)] and not [k for k in sent if "token#" in k]
    assert not [k for k in re.findall(r"BroadcastHashJoin \[(.*?)\], \[", plans[-1]) if re.match(r"cls#\d+L$", k)]


def test_pipeline_stages_take_effect(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "slowly", "evening", "letter", "garden", "window", "bread", "north"]) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["BUY", "!!!", "$$$", "click", "#1", "FREE"]) for _ in range(80))
    texts = [good() if i % 3 else bad() for i in range(150)]
    texts[2] = texts[1]
    texts[4] += " password = hunter2hunter2"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:4]:
        kept = stage(spark, kept, str(tmp_path)).persist()
        assert kept.columns == docs.columns, name
        ids = {r.doc_id for r in kept.collect()}
        assert not any(i % 3 == 0 for i in ids) and (name == "quality classifier" or 2 not in ids)
    assert all("hunter2" not in r.text for r in kept.collect())
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in kept.collect())
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in got)


def test_pipeline_stages_on_awkward_rows_and_none(spark, awkward, nothing, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    awkward.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    rows = awkward.count()
    # labels of one class only: every score is 0.5, and all rows stay
    want = {"quality classifier": rows, "near-duplicates": None, "secret scan": rows, "mixing sources": None}
    for name, stage in pipeline.STAGES:
        got = stage(spark, awkward, str(tmp_path))
        kept = got.collect()
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name
        if name != "token ids":
            assert got.columns == awkward.columns, name
            assert want[name] is None or len(kept) == want[name]
        if name == "near-duplicates":
            # 1 equals 0 and 2 is close to it; rows without id stay together, and one of them is linked with nothing
            assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [0, 0, 3, 4, 5, 6, 7, 8, 9, None, None]))
        if name == "secret scan":
            assert [r.text for r in kept if r.doc_id == 9] == [awkward.filter("doc_id = 9").first().text.replace("password = hunter2hunter2", "[SECRET]")]
        if name == "token ids":
            assert len(kept) == rows and all(r.agrees for r in kept)


def test_pipeline_against_brute_force(spark, tmp_path):
    """The rows of run(), from a plain Python version of every stage but the classifier's own scores."""
    pipeline = pytest.importorskip("corpus_pipeline")
    pieces = pytest.importorskip("groma.llm.pieces")
    rng = random.Random(19)
    words = ["river", "stone", "walks", "slowly", "evening", "letter", "garden", "window", "bread", "north", "colour", "winter"]
    texts = []
    for i in range(160):
        if i % 4 == 0:
            texts.append(" ".join(rng.choice(["BUY", "!!!", "$$$", "click", "#1", "FREE"]) for _ in range(70)))
        elif i % 9 == 5:  # near copies of the one before
            body = texts[-1].split(" ")
            body[rng.randrange(len(body))] = "changed"
            texts.append(" ".join(body))
        else:
            texts.append(" ".join(rng.choice(words) + (f" token: {rng.randrange(10**9):09d}xyz" if rng.random() < 0.02 else "") for _ in range(rng.randint(30, 110))))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    model = discriminant.train(docs, labels, ~discriminant.held_out(F.col("doc_id")))
    left = {r.doc_id: r.text for r in discriminant.score(docs, model).filter("score >= 0.5").collect()}
    left = {d: left[d] for d, (_, _, kept) in components_by_hand(list(left.items())).items() if kept}
    masked = {}
    for d, t in left.items():
        spots = [(m.start(), m.end()) for _, p, good in SECRETS for m in re.finditer(p, t) if good(m)]
        out, at = "", 0
        for a, b in sorted(spots):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        masked[d] = out + t[at:]
    assert any("[SECRET]" in t for t in masked.values()) and len(masked) < 120
    sizes = {d: len(WORD.findall(t)) for d, t in masked.items()}
    of = {s: sum(n for d, n in sizes.items() if d % 3 == s) for s in range(3)}
    weight, target, free = {0: 3, 1: 1, 2: 2}, {}, {0, 1, 2}
    rest = 1.5 * sum(of.values())
    while free:  # shares are dealt by weight until no source is above twice its size
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * of[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * of[s] for s in full}
        rest -= sum(2.0 * of[s] for s in full)
        free -= full
    want = Counter()
    own = pieces.vocabulary(pieces.model_bytes())
    for d, t in masked.items():
        rate = target[d % 3] / of[d % 3]
        draw = int(hashlib.md5(f"{d}|mix-1".encode()).hexdigest()[:13], 16) / 16**13
        copies = int(rate) + (draw < rate - int(rate))
        ids = own.library.encode(t, add_eos=True)
        if copies:
            want[d, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.library.decode(ids).encode()).hexdigest()] = copies
    got = Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
