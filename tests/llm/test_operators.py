"""Each operator against brute force on a small table, and on a table of odd rows."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import ann, binary, bpe, decontam, language, licenses, neardup, pii, quality, sharding
from lodestone.llm.queries import ORACLE_SQL, QUERIES
from lodestone.llm.tokens import cut, default_path

ODD = [
    (1, "", "en", "a", 0, "x"), (2, None, None, None, None, "x"), (3, "One two three. One two three.", "en", "a", 30, None),
    (3, "One two three. One two three.", "en", "a", 30, None), (None, "an id is missing here", "en", "b", 21, "y"),
    (4, "é   x  <|endoftext|> y\t\n z ", "fr", "b", 20, "y"), (5, "word " * 30_000, "en", "a", 150_000, "y"), (6, "12345 --- 678", "en", None, 10, "y"),
    (7, "one  TWO three. one two three.", None, "a", 30, "z"), (8, " ", "de", "a", 1, "z"), (9, "Released under the MIT License.\nCopyright (c) 2020 X", "en", "c", 40, "z"),
    (10, "\U0001f600 mail a.b@c.de, or 10.0.0.1 and 4111 1111 1111 1111, call +49 (30) 1234567.", "de", "c", 80, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, license string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_shards(docs, odd, none):
    got = rows(sharding.interleave(docs, 7))
    n = len(got)
    assert n == docs.count() and {r["law"] for r in got} == {"rows"}
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == 7 and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    text = {r["doc_id"]: (r["text"], r["source"]) for r in rows(docs)}
    for r in got:
        assert r["size"] == len(text[r["doc_id"]][0].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]][0].encode())
    sources = Counter(s for _, s in text.values())
    for s in counts:
        mix = Counter(text[r["doc_id"]][1] for r in got if r["shard"] == s)
        assert all(abs(mix[x] - sources[x] / 7) < 2 for x in sources)
    got = rows(sharding.interleave(odd, 40))
    assert len(got) == len(ODD) and {r["size"] for r in got if r["doc_id"] == 2} == {16}
    assert rows(sharding.interleave(none, 40)) == []


def test_shards_of_one_hot_source(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as text", "if(id % 3 = 0, 'hot', concat('s', id % 50)) as source")
    got = sharding.interleave(df, 40).join(df, "doc_id").groupBy("shard").agg({"*": "count"}).collect()
    assert {r[1] for r in got} == {125}


def test_licenses(spark, odd, none):
    got = {r["doc_id"]: r for r in rows(licenses.scan(odd))}
    assert got[9]["text_license"] == "MIT" and got[9]["line_licenses"] == "MIT" and got[9]["n_license_lines"] == 1
    assert got[2]["text_digest"] is None and got[1]["text_digest"] is None and len(rows(licenses.scan(odd))) == len(ODD)
    assert rows(licenses.scan(none)) == []
    same = spark.createDataFrame([(1, "released under THE mit   licence\n(c) 1999 Someone\n")], "doc_id long, text string")
    assert rows(licenses.scan(same))[0]["text_license"] == "MIT"


def test_real_license_files(spark):
    """LICENSE files as projects hand them on, named by licence and project, and what holders fill in."""
    folder = os.path.join(os.path.dirname(__file__), "licenses")
    some = [(f[:-4].rpartition("-")[0], open(os.path.join(folder, f), encoding="utf-8").read()) for f in sorted(os.listdir(folder))]
    mit = next(t for n, t in some if n == "MIT")
    body = mit[mit.index("Permission is hereby granted") :]
    some += [("MIT", f"{head}\n\n{body}") for head in ("MIT License\n\nCopyright (c) Someone", "Copyright (c) Someone\nAll rights reserved.", "The MIT License (MIT)\n\nCopyright 2011-2013 A, B", "Copyright npm, Inc.")]
    some += [(None, body.replace("without limitation", "with limitation")), (None, "Copyright (c) Someone\nAll rights reserved."), (None, "A text on software. " + body)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(some)], "doc_id long, text string")
    got = {r["doc_id"]: r["text_license"] for r in rows(licenses.scan(df))}
    assert got == {i: n for i, (n, _) in enumerate(some)}
    known = [(r["license"], r["digest"]) for r in rows(licenses.known_whole(spark))]
    assert len({d for _, d in known}) == len(known) > 100


def test_license_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(tuple, con.execute(ORACLE_SQL["op2_licenses"]).fetchall()))
    got = sorted(tuple(r) for r in QUERIES["op2_licenses"](spark, sf).select("doc_id", "text_digest", "text_license", "line_licenses", "n_license_lines").collect())
    assert got == want and any(r[4] for r in got)


def test_language(docs, odd, none):
    got = {r["doc_id"]: r for r in rows(language.identify(docs))}
    held = [r for r in rows(docs) if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held)
    assert all(got[r["doc_id"]]["held_out"] for r in held) and all(0 <= r["score"] <= 1 for r in got.values())
    got = rows(language.identify(odd))
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 6, 8)} == {"und"} and len(got) == len(ODD)
    assert rows(language.identify(none)) == []


def test_language_scores_like_the_plain_formula(docs, odd):
    """Counts, log-probabilities, priors and posteriors again, n-gram by n-gram."""

    def bucket(gram):
        codes, key = [ord(c) for c in gram], ord(gram[0])
        for c in codes[1:]:
            key = (key * 0x110000 + c if len(gram) < 4 else (key << 16) ^ c) % 2**64
        return int(language.mix64(np.array([key], np.uint64), len(gram))[0]) >> 48

    def grams(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        t = f" {' '.join(letters.split())} "
        return Counter(t[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)) if t.strip() else Counter()

    some = docs.filter("doc_id < 60 and length(text) < 3000")
    learn = [r for r in rows(some) if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"]]
    langs = sorted({r["lang"] for r in learn})
    seen: dict[str, int] = {}
    counts = {x: Counter() for x in langs}
    for r in learn:
        for g, n in grams(r["text"]).items():
            seen[g] = seen.get(g) or bucket(g)
            counts[r["lang"]][seen[g]] += n
    totals = {x: sum(counts[x].values()) + 0.5 * 65536 for x in langs}
    got = {r["doc_id"]: r for r in rows(language.identify(some, per_lang=10**6))}
    for r in rows(some):
        mine = grams(r["text"])
        n = sum(mine.values())
        whole, logs = [], []
        for x in langs:
            logp = sum(c * np.log((counts[x][seen.setdefault(g, bucket(g))] + 0.5) / totals[x]) for g, c in mine.items())
            prior = np.log(sum(q["lang"] == x for q in learn) / len(learn))
            whole.append(logp + prior)
            logs.append(logp / n * 32 + prior)
        p = np.exp(np.array(logs) - max(logs))
        best = int(np.argmax(whole))
        assert got[r["doc_id"]]["lang_pred"] == langs[best] and abs(got[r["doc_id"]]["score"] - p[best] / p.sum()) < 1e-9


def test_language_of_skewed_priors_and_long_texts():
    """Multinomial naive Bayes: the sum over a long text outweighs any prior; on a short one the prior decides."""
    sums, counts = np.array([[-700.0, -800.0], [-2.0, -2.5], [-9.0, -3.0]]), np.array([1000, 3, 5])
    prior = np.log(np.array([0.02, 0.98]))
    best, score = language.decide(sums, counts, prior)
    assert best.tolist() == [0, 1, 1] and ((score >= 0) & (score <= 1)).all() and score[0] < 0.5


def test_language_of_a_rare_language(spark):
    """One text in fifty is of a language whose words share most letters with the other; held-out ones are found all the same."""
    r = np.random.default_rng(8)
    words = {"a": ["kilo", "lima", "mike", "oscar"], "b": ["kilu", "limu", "miku", "oscur"]}
    some = [(i, " ".join(r.choice(words[x], 200)), x) for i in range(1000) for x in ["b" if i % 50 == 0 else "a"]]
    got = {x["doc_id"]: x["lang_pred"] for x in rows(language.identify(spark.createDataFrame(some, "doc_id long, text string, lang string")))}
    assert all(got[i] == x for i, _, x in some)


def test_language_in_pieces(monkeypatch):
    """Long texts in pieces, many texts at once: the same sums."""
    matrix = np.random.default_rng(1).standard_normal((language.BUCKETS, 3))
    texts = [language._letters(t) for t in ("one two three", "a", "fünf sechs " * 40, "x y")]
    want = language.totals(texts, matrix)
    monkeypatch.setattr(language, "PIECE", 20)
    got = language.totals(texts, matrix)
    assert (got[1] == want[1]).all() and np.allclose(got[0], want[0]) and want[1][1] == 3 + 2 + 1


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(default_path())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB1é ' \t\n  \x1c​.<|>中😀")) | st.characters(codec="utf-8")))
def test_cuts_keep_the_encoding(text):
    tok = Tokenizer.from_file(default_path()) if not hasattr(test_cuts_keep_the_encoding, "tok") else test_cuts_keep_the_encoding.tok
    test_cuts_keep_the_encoding.tok = tok
    assert "".join(cut(text)) == text
    assert [i for p in cut(text) for i in tok.encode(p, add_special_tokens=False).ids] == tok.encode(text, add_special_tokens=False).ids


def test_binary_files(docs, odd, none, tok, tmp_path):
    for df in (docs, odd.filter("doc_id is not null and doc_id <> 3")):
        start, want = 0, []
        for r in sorted(rows(df), key=lambda r: r["doc_id"]):
            ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, binary.encode_files(df).collect())) == want
    assert len(rows(binary.encode_files(odd))) == len(ODD) and rows(binary.encode_files(none)) == []
    files = binary.write(docs, str(tmp_path / "f"))
    path = files.first()["path"] + ".rec"
    data = bytearray(open(path, "rb").read())
    assert binary.unframe(bytes(data), 0)[0]
    data[14] ^= 1
    with pytest.raises(ValueError):
        binary.unframe(bytes(data), 0)
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        binary.read(files).collect()


def brute_components(texts, width=2):
    sets = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    ids = sorted(sets)

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(spark, docs, odd, none):
    import random

    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    copies = [(10_000 + i, " ".join(w if rng.random() > 0.05 else f"x{rng.randrange(10**6)}" for w in base)) for i in range(120)]
    chain = [(20_000 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 60))) for i in range(25)]
    texts = [(r["doc_id"], r["text"]) for r in rows(docs)] + copies + chain + [(30_000, "a B"), (30_001, "A b"), (30_002, "a"), (30_003, None), (30_004, " \n")]
    got = rows(neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    got = rows(neardup.near_duplicates(odd))
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] == 3} == {3}
    assert [r["kept"] for r in got if r["doc_id"] is None] == [False]
    assert rows(neardup.near_duplicates(none)) == []
    assert neardup.keep_one(odd).columns == odd.columns


def test_keep_one_of_repeated_rows(spark):
    """Against brute force: repeated rows, rows without an id, and empty texts."""
    one, two, three = (" ".join(f"{c}{j}" for j in range(30)) for c in "abc")
    some = [(1, one), (1, one), (2, one), (None, one), (None, two), (None, two), (3, three), (4, ""), (4, ""), (5, three.upper()), (6, "x y z")] + [(7, "p q r s t u v")] * 3 + [(8, None)] * 2 + [(None, None)] * 2
    comps = brute_components([(i, t) for i, t in some if i is not None], 5)
    want, seen = [], {t.lower() for i, t in some if i is not None and t}
    for i, t in dict.fromkeys(some):
        if comps[i][1] == i if i is not None else not t or t.lower() not in seen:
            want.append((i, t))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    df = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(some)], "n long, doc_id long, text string").repartition(3)
    got = neardup.keep_one(df)
    assert got.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_cross_pairs_reach_every_component(spark, monkeypatch):
    """Links that no star finds: blocks of two, so that blocks meet in pairs."""
    monkeypatch.setattr(neardup, "BLOCK", 2)
    chain = [(i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 60))) for i in range(40)]
    got = rows(neardup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(chain)


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6))
def test_sketches_fill(n, seed):
    x = np.unique(np.random.default_rng(seed).integers(0, 2**63, n).astype(np.uint64))
    s = neardup.sketches([x, x[:1]])
    assert (s != neardup.FULL).all() and (neardup.sketches([x])[0] == s[0]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (200, 201)]
    got = {r["id"]: r["component"] for r in rows(neardup.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {i: 0 for i in range(31)} | {50: 50, 70: 50, 100: 50, 200: 200, 201: 200}


def test_nearest(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    more = [(10**6 + i, [0.5] * 64, 1) for i in range(60)] + [(2 * 10**6, None, 1), (2 * 10**6 + 1, [0.0] * 64, 1), (2 * 10**6 + 2, [float("nan")] * 64, 1), (2 * 10**6 + 3, [None] * 64, 1), (None, [1.0] * 64, 1), (7, [1.0] * 3, 1)]
    table = df.union(spark.createDataFrame(more, df.schema))
    data = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in rows(df)} | {i: np.array(v) for i, v, _ in more[:60]}
    ids = np.array(sorted(data))
    matrix = np.array([data[i] for i in ids])
    got = {}
    for r in rows(ann.nearest(table)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        s = matrix @ data[q]
        best = [int(i) for i in ids[np.lexsort((ids, -np.round(s, 12)))] if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - data[f[1]] @ data[q]) < 1e-12 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(best))
        total += 20
    assert hits >= 0.9 * total
    assert [f[1] for f in sorted(got[10**6])] == [10**6 + i for i in range(1, 21)]
    assert rows(ann.nearest(table.limit(0))) == []


def test_chi_square():
    x = np.random.default_rng(1).chisquare(ann.DIMENSIONS, 200_000)
    for q in (8.0, 16.0, 24.0):
        assert abs((x < q).mean() - ann.chi_square(np.float64(q))) < 0.01
    assert abs(ann.chi_square(ann.quantile(0.95)) - 0.95) < 1e-9


@pytest.mark.parametrize(("spread", "most"), [(None, 0.8), (0.3, 0.25)])
def test_verified_share_and_recall(spread, most):
    """How much of a shard is compared on its original coordinates: isotropic vectors, and 200 clusters of unequal length."""
    rng = np.random.default_rng(2)
    v = rng.standard_normal((8000, 64))
    if spread is not None:
        v = rng.standard_normal((200, 64))[rng.integers(0, 200, 8000)] + spread * v
    v *= rng.uniform(1e200, 1.1e200, (8000, 1)) if spread is not None else 1 / np.linalg.norm(v, axis=1, keepdims=True)
    tree, hits, asked = ann.Tree(np.arange(8000), v, 20), 0, range(0, 8000, 200)
    small = v / np.abs(v).max()
    with np.errstate(over="ignore"):
        for q in asked:
            s = small @ small[q]
            s[q] = -np.inf
            hits += len(set(np.argsort(-s)[:20].tolist()) & {i for _, i in tree.search(q, v[q], 20, 0.95)})
    assert hits >= 0.95 * 20 * len(asked) and tree.verified <= most * 8000 * len(asked)


def test_nearest_of_one_id_with_two_vectors(spark):
    """Each vector of an id asks and is found; the best score counts."""
    some = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.0, 2.0]), (2, [0.1, 0.1]), (2, [0.1, 0.1])]
    df = spark.createDataFrame(some, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    assert [tuple(r) for r in ann.nearest(df).orderBy("rank").collect()] == [(0, 1, 2, 2.0), (0, 2, 1, 0.9)]


def test_bpe(docs, odd, none, tok, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 20_000)
    for df in (docs, odd):
        want = []
        for r in rows(df):
            ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
            said = tok.decode(ids, skip_special_tokens=False)
            want.append((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
        assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(df).collect()) == sorted(want)
    got = {r["doc_id"]: r for r in rows(bpe.encode(odd))}
    assert got[3]["decoded"] == "One two three. One two three." and got[3]["ids"] == tok.encode(got[3]["decoded"]).ids and got[2]["ids"] == []
    assert rows(bpe.digests(none)) == []


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    for kind, p in BASE.items():
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "phone" and 8 <= len(d) <= 15 or kind == "card" and 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0:
                yield kind, m.start(), m.end()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+%1 259(é\n", max_size=60))
def test_base_patterns(text):
    assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == list(plain_spans(text))


def test_pii(spark, docs, odd, none):
    for df in (docs, odd):
        got = rows(pii.find(df))
        want = {}
        for r in rows(df):
            spans = list(plain_spans(r["text"] or ""))
            want[r["doc_id"]] = ([sum(k == x for k, *_ in spans) for x in pii.KINDS], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest(), {f"{k}:{s}:{e}" for k, s, e in spans})
        for r in got:
            n, sha, spans = want[r["doc_id"]]
            assert [r[f"n_{k}"] for k in pii.KINDS] == n and r["base_sha256"] == sha and spans <= set(r["spans"].split(",")) - {""}
    assert len(got) == len(ODD) and rows(pii.find(none)) == []
    known = [(i, f"please write to user{i}@mail{i}.org for details", "x") for i in range(20)]
    df = spark.createDataFrame([*known, (99, "please write to jane@intranet for details", "x"), (98, "we met jane@intranet today", "x"), (97, "it costs 12345 now", "x")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in rows(pii.find(df))}
    assert got[99]["spans"] == "email:16:29" and got[99]["n_email"] == 0 and got[98]["spans"] == "email:7:20" and got[97]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in rows(pii.redact(df))}
    assert clean[99] == "please write to <EMAIL> for details" and clean[3] == clean[99] and clean[97] == "it costs 12345 now"
    assert pii.redact(odd).columns == odd.columns and len(rows(pii.redact(odd))) == len(ODD)


def test_quality(spark, docs, odd, none, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in rows(quality.classify(docs, labels))}
    held = [(got[r["doc_id"]]["score"], r["quality"]) for r in rows(labels) if got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert len(got) == docs.count() and sum(a > b for a in good for b in bad) >= 0.8 * len(good) * len(bad)
    again = {r["doc_id"]: r["score"] for r in rows(quality.classify(docs, labels))}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in got.items())
    odd_labels = spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 1, 0), (5, 0, 1), (5, 0, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(rows(quality.classify(odd, odd_labels))) == len(ODD)
    assert {r["score"] for r in rows(quality.classify(odd, odd_labels.limit(0)))} == {0.5}
    assert rows(quality.classify(none, labels)) == [] and quality.keep_good(odd, odd_labels).columns == odd.columns
    named = quality.keep_good(odd.withColumn("score", F.lit("mine")), odd_labels, threshold=0.0)
    assert {r["score"] for r in rows(named)} == {"mine"} and named.count() == len(ODD)


def edit_window(pattern, text, k):
    row = list(range(len(pattern) + 1))
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (p != c)))
        row = new
        if row[-1] <= k:
            return True
    return row[-1] <= k


def test_decontamination(spark, docs, odd, none, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).cache()
    items = rows(bench)
    rng = np.random.default_rng(3)
    edited = []
    for n, r in enumerate(items[:6]):
        t = list(r["text"])
        for p in rng.choice(len(t), len(t) // 30, replace=False):
            t[p] = "q"
        edited.append((5000 + n, "Some words before it. " + "".join(t) + " and words after."))
    some = [(r["doc_id"], r["text"][:3000]) for r in rows(docs.limit(25))] + edited
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontam.find(df, bench))}
    want = set()
    for i, text in some:
        t = decontam.normal(text)
        for r in items:
            if any(edit_window(w, t, decontam.budget(len(w))) for w in decontam.windows(decontam.normal(r["text"]))):
                want.add((i, r["item_id"]))
    assert got == want and {i for i, _ in got} >= {i for i, _ in edited}
    assert {(r["doc_id"], r["item_id"]) for r in rows(decontam.find(df, bench, block_bytes=900))} == got
    assert {r["doc_id"] for r in rows(decontam.clean(df, bench))} == {i for i, _ in some} - {i for i, _ in got}
    odd_bench = spark.createDataFrame([(1, None), (2, ""), (None, "one two three one two three"), (3, "x"), (4, "one two three. one two THREE")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in rows(decontam.find(odd, odd_bench))} == {(3, 4), (7, 4), (9, 3)}  # a short item is a whole word
    assert {r["doc_id"] for r in rows(decontam.clean(odd, odd_bench))} == {r[0] for r in ODD} - {3, 7}
    assert rows(decontam.find(odd, odd_bench.limit(0))) == [] and rows(decontam.find(none, bench)) == []
    assert decontam.clean(odd, odd_bench).columns == odd.columns


def test_quotes_of_part_of_an_item(spark, sf):
    """Any 13 words and any 64 characters of an item in foreign text, held against a plain search; shorter quotes are no finding."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(9001, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (9002, "x" * 40 + "".join(chr(0x4E00 + 7 * i) for i in range(90)))]
    index = decontam.Index(items)
    rng = np.random.default_rng(5)
    for n, (i, text) in enumerate(items):
        t = decontam.normal(text)
        words = t.split(b" ")
        spans = [b" ".join(words[k : k + 13]) for k in rng.integers(0, max(1, len(words) - 12), 3) if len(words) >= 13]
        spans += [t[k : k + 64] for k in rng.integers(0, max(1, len(t) - 63), 3) if len(t) >= 64]
        for span in spans:
            got = index.matches(b"zqj wvk 77 " + span + b" 88 kvw jqz")
            assert {items[g][0] for g in got} >= {k for k, x in items if span in decontam.normal(x)} >= {i}
        short = b" ".join(words[:4])
        if len(words) > 20 and len(short) < 30:
            assert n not in index.matches(b"zqj wvk 77 " + short + b" 88 kvw jqz")
    some = [(1, "zqj wvk " + " ".join(items[-2][1].split(" ")[5:18]) + " kvw jqz"), (2, "zqj wvk " + " ".join(items[-2][1].split(" ")[5:17]) + " kvw jqz")]
    df, bench = spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert [tuple(r) for r in decontam.find(df, bench).collect()] == [(1, 9001, 0, 8, 33, 0)]
    assert [r["doc_id"] for r in rows(decontam.clean(df, bench))] == [2]


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert os.path.exists(default_path())


def test_words_are_encoded_once_a_batch(monkeypatch):
    """Whatever white space and special tokens do at their ends, words put together as lines give the ids of the whole texts; each is encoded once."""
    from lodestone.llm import binary, tokens

    blob = tokens.read_blob(None)
    tok = tokens.tokenizer(blob)
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n", "\n a", "a\nb c\td", "　b c", "x" * 300 + " y", "a b c", "é  z", "<|endoftext|> a", "it's <s> 12 345 </s>", "tab\t end\r\n more"]
    counted = []

    class Counting:
        def __getattr__(self, name):
            return getattr(tok, name)

        def encode_batch_fast(self, some, **k):
            counted.extend(some)
            return tok.encode_batch_fast(some, **k)

    monkeypatch.setattr(binary, "tokenizer", lambda b: Counting())
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert binary._encode(texts, blob, "<u2") == want and binary._encode([], blob, "<u2") == []
    counted.clear()
    binary._encode([f"same words {i} and again the same words" for i in range(500)], blob, "<u2")
    assert len(counted) < 10
    sizes = [len(b) for b in binary._pieces(pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": ["ab", None, "x" * 50, "c"]}), 3)]
    assert sizes == [2, 1, 1]


def test_words_of_earlier_batches_are_not_encoded_again(monkeypatch):
    """A worker keeps the ids of words for its later batches, up to a bound; with the bound reached, or none kept, ids are the same."""
    from lodestone.llm import binary, tokens

    blob = tokens.read_blob(None)
    tok = tokens.tokenizer(blob)
    counted = []

    class Counting:
        def __getattr__(self, name):
            return getattr(tok, name)

        def encode_batch_fast(self, some, **k):
            counted.append(sum(map(len, some)))
            return tok.encode_batch_fast(some, **k)

    monkeypatch.setattr(binary, "tokenizer", lambda b: Counting())
    batches = [["x " + " ".join(f"word{i * j}\tz" for i in range(400)) + " é", "", "y  z"] for j in (1, 1, 3, 1)]
    for most in (1 << 20, 300, 0):
        tokens.worker_store("words").clear()
        monkeypatch.setattr(binary, "KNOWN", most)
        each = []
        for texts in batches:
            counted.clear()
            assert binary._encode(texts, blob, "<u2") == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
            each.append(sum(counted))
        assert each[1] < 100 < each[0] if most > 400 else each[1] == each[0]
    tokens.worker_store("words").clear()
