"""Inputs that once lost rows or crashed, hot groups, small bounds that force the large path, and brute-force versions."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import binary, bpe, common, decontam, neardup, pii, quality, sharding
from lodestone.llm.tokens import default_path

from test_operators import ODD, SCHEMA, brute_components, plain_spans, rows


def frame(spark, some, schema="doc_id long, text string"):
    return spark.createDataFrame(some, schema)


CLASHES = ("further", "text_hash", "__id", "__text", "score", "Of_id", "digest", "vid", "size", "row")


@pytest.fixture(scope="module")
def clashing(spark):
    df = frame(spark, ODD, SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("mine"))
    return df


def test_clashing_columns(spark, clashing, sf):
    bench, labels = frame(spark, [(1, "one two three. one two three.")], "item_id long, text string"), frame(spark, [(1, 1), (3, 0)], "doc_id long, quality int")
    for df in (pii.redact(clashing), quality.keep_good(clashing, labels, threshold=0.0), neardup.keep_one(clashing), decontam.clean(clashing, bench)):
        got = rows(df)
        assert df.columns == clashing.columns and got and all(r[c] == "mine" for r in got for c in CLASHES)
    for df in (pii.find(clashing), sharding.interleave(clashing, 5), neardup.near_duplicates(clashing), bpe.digests(clashing), binary.encode_files(clashing)):
        assert df.count() == len(ODD)


# --- personal data


def test_long_runs_of_zeros(spark):
    text = "0" * 5000 + ".0.0.0 and 255.0255.00.1 but 256.1.1.1 and 1.1.1.0300"
    assert [s[0] for s in pii.base_spans(text)] == [1, 1]
    assert rows(pii.find(frame(spark, [(1, text)])))[0]["n_ip"] == 2


def plain_learned(texts, support, rounds, sure):
    """kind of each instance, from the graph of patterns and instances as nested dictionaries."""
    graph, may = defaultdict(dict), {}
    for t in texts:
        spans = pii.base_spans(t)
        for s, e, k in [(s, e, k) for k, s, e in spans] + [(s, e, -1) for s, e in pii._others(t, spans)]:
            may[t[s:e]] = [i for i in range(4) if pii.could_be(i, t[s:e])]
            for p in pii._contexts(t, s, e):
                graph[p][t[s:e]] = max(k, graph[p].get(t[s:e], -1))
    score = {}
    for _ in range(rounds):
        new = defaultdict(float)
        for p, instances in graph.items():
            for kind in range(4):
                known = [1.0 if k == kind else score.get((i, kind), 0.0) if k < 0 else 0.0 for i, k in instances.items()]
                firm = sum(k == kind or k < 0 and score.get((i, kind), 0.0) >= sure for i, k in instances.items())
                if firm >= support:
                    for i, k in instances.items():
                        if k < 0 and kind in may[i]:
                            new[i, kind] = max(new[i, kind], sum(known) / len(known))
        score = dict(new)
    best = {}
    for (i, kind), c in sorted(score.items(), key=lambda x: (-x[1], x[0][1])):
        if c >= sure:
            best.setdefault(i, kind)
    return best


def bootstrapped():
    known = [f"please write to user{i}@mail{i}.org for details" for i in range(40)]
    first = [f"please write to staff{i}@intranet for details" for i in range(7)]  # found in round 1
    first += [f"the desk of staff{i}@intranet answers soon" for i in range(7)]  # and so support another pattern
    return known + first + ["the desk of jane@branch answers soon", "we met jane@branch today", "it costs 12345 now", '{"tel":"555 123 4567","n":"' + "9" * 150 + '"}']


def test_bootstrapping_goes_beyond_one_step(spark):
    texts = bootstrapped()
    df = frame(spark, list(enumerate(texts)))
    want = plain_learned(texts, 5, 3, 0.8)
    assert want["jane@branch"] == 0 and "jane@branch" not in plain_learned(texts, 5, 1, 0.8)
    for r in rows(pii.find(df, 5, 3, 0.8)):
        t = texts[r["doc_id"]]
        spans = pii.base_spans(t)
        spans += [(want[t[s:e]], s, e) for s, e in pii._others(t, spans) if t[s:e] in want]
        assert r["spans"] == pii.spans_string(spans)
    clean = {r["doc_id"]: r["text"] for r in rows(pii.redact(df, 5, 3, 0.8))}
    assert clean[55] == "we met <EMAIL> today"


def test_candidates_in_unspaced_and_grouped_text():
    t = '{"id":"ab12345","tel":"555 123 4567","long":"' + "7" * 300 + '"},x@host,(030) 12 34 56x 1-2'
    got = [t[s:e] for s, e in pii._others(t, [])]
    assert sorted(got) == sorted(["ab12345", "555 123 4567", "7" * 300, "x@host"])
    assert [s for s, _ in pii._others("1 " * 200_000 + "1x", [])] == []


def test_pii_past_the_broadcast_bound(spark, monkeypatch):
    df = frame(spark, list(enumerate(bootstrapped())))
    want = sorted(map(tuple, pii.find(df).collect()))
    monkeypatch.setattr(pii, "ROWS", 0)
    assert sorted(map(tuple, pii.find(df).collect())) == want


# --- near duplicates


def test_one_id_with_several_texts(spark):
    """Rows of one id are documents of their own; what stands nowhere else stays."""
    one, two = (" ".join(f"{c}{j}" for j in range(30)) for c in "ab")
    some = [(1, one), (3, one), (3, two), (3, two), (None, two), (None, "c d e f g h"), (None, "C d e f g h"), (9, two + " x")]
    df = frame(spark, some)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(neardup.near_duplicates(df))), key=repr)
    assert got == sorted([(1, 29, 1, True), (3, 29, 1, False), (3, 29, 3, True), (3, 29, 3, True), (None, 29, 3, False), (9, 30, 3, False), (None, 5, None, False), (None, 5, None, False)], key=repr)
    kept = sorted(((r["doc_id"], r["text"].lower()) for r in rows(neardup.keep_one(df))), key=repr)
    assert kept == sorted([(1, one), (3, two), (None, "c d e f g h")], key=repr)
    named = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {(r["doc_id"], r["component_id"]) for r in rows(neardup.near_duplicates(named))} == {("d1", "d1"), ("d3", "d1"), ("d3", "d3"), (None, "d3"), ("d9", "d3"), (None, None)}


def groups():
    """Two groups of near copies that share a long passage, 300 of each, and a chain."""
    rng = np.random.default_rng(4)
    passage, out = [f"p{i}" for i in range(70)], []
    for g in "ab":
        own = [f"{g}{i}" for i in range(60)]
        out += [" ".join(passage + [w if rng.random() > 0.008 else f"x{rng.integers(10**9)}" for w in own]) for _ in range(300)]
    return list(enumerate(out + [" ".join(f"c{j}" for j in range(6 * i, 6 * i + 60)) for i in range(12)]))


def test_two_groups_in_one_bucket_cost_no_pairs(spark, monkeypatch):
    seen = []
    near = neardup._near_others

    def counted(rows):
        out = common.stored(near(rows), "near")
        seen.append((rows.filter("vid is not null").count(), out.count()))
        return out

    monkeypatch.setattr(neardup, "_near_others", counted)
    monkeypatch.setattr(neardup, "BLOCK", 64)
    texts = groups()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(neardup.near_duplicates(frame(spark, texts)))}
    assert got == brute_components(texts)
    assert seen[0][0] > 200 and seen[0][1] < seen[0][0] / 5  # members of mixed buckets, and those that are compared with others at all


@pytest.mark.parametrize("bound, most", [("BLOCK", 3), ("SHINGLES", 30)])
def test_near_duplicates_past_the_broadcast_bound(spark, monkeypatch, bound, most):
    monkeypatch.setattr(neardup, "IDS", 0)
    monkeypatch.setattr(neardup, bound, most)
    texts = groups()[280:320] + groups()[-12:] + [(5000, groups()[290][1])] * 3
    df = frame(spark, texts)
    want = brute_components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(neardup.near_duplicates(df))} == want
    assert sorted(r["doc_id"] for r in rows(neardup.keep_one(df, 2))) == sorted(i for i, (_, c) in want.items() if i == c)


def test_links_just_above_the_threshold():
    """Sketches of pairs of similarity 0.8 to 0.82: all agree in enough places and meet in a band."""
    rng, met = np.random.default_rng(7), 0
    for _ in range(300):
        common_, own = rng.integers(0, 2**63, 800).astype(np.uint64), rng.integers(0, 2**63, 198).astype(np.uint64)
        a, b = neardup.sketches([np.unique(np.concatenate([common_, own[:99]])), np.unique(np.concatenate([common_, own[99:]]))])
        brief = neardup.mix64(np.stack([a, b]), 99).astype(np.uint8)
        met += (brief[0] == brief[1]).sum() >= neardup.AGREE and (a.reshape(32, 5) == b.reshape(32, 5)).all(axis=1).any()
    assert met == 300


# --- the others


def test_string_ids(spark):
    df = frame(spark, [("b", "two words"), ("a", "one"), (None, "x"), ("10", "zehn")], "doc_id string, text string")
    got = rows(binary.encode_files(df))
    ends = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in got)
    assert [e[1] for e in ends] == [None, "10", "a", "b"] and all(a[0] + a[2] == b[0] for a, b in zip(ends, ends[1:]))
    bench = frame(spark, [("q1", "a first benchmark item of some length to be found"), ("q2", "zehn"), ("q2", "zehn")], "item_id string, text string")
    found = rows(decontam.find(df.union(frame(spark, [("c", "so: a first Benchmark item of some length, to be found!")], "doc_id string, text string")), bench))
    assert {(r["doc_id"], r["item_id"]) for r in found} == {("c", "q1"), ("10", "q2")} and len(found) == 2


def test_more_files_for_more_bytes_and_a_small_memo(spark, monkeypatch):
    tok = Tokenizer.from_file(default_path())
    monkeypatch.setattr(binary, "MEMO", 2000)
    some = [(i // 4, f"text {i} " + "unspaced" * (i % 50)) for i in range(200)]
    df = frame(spark, some).repartition(2)
    folder = common.scratch(spark, "records")
    files = binary.write(df, folder, file_bytes=500)
    assert files.count() > 8
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows(binary.read(files)))
    ids = [(i, tok.encode(t, add_special_tokens=False).ids + [2]) for i, t in some]
    assert got == sorted((i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in ids)


def test_hits_in_slices(monkeypatch):
    item = ("the quick brown fox jumps over the lazy dog and runs away from seven hungry wolves " * 3).strip()
    index = decontam.Index([(1, item), (2, "a" * 300), (3, "another item that stands nowhere in the text below, at all")])
    text = decontam.normal("some words " * 50 + item + " other words " * 50 + "a" * 200 + item[:150])
    want = index.matches(text)
    assert set(want) == {0, 1}
    monkeypatch.setattr(decontam, "HITS", 50)
    assert index.matches(text) == want


def test_repeated_letters_stay_bounded():
    """2 MB of one letter against an item of it: hits are expanded slice by slice."""
    import tracemalloc

    index, text = decontam.Index([(1, "z" * 500)]), b"z" * 2_000_000
    tracemalloc.start()
    at, j = index.shared(text)
    n = sum(1 for _, _ in zip(range(1000), index.regions(text, at, j)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1000 and peak < 300 << 20


def test_words_of_many_blocks(spark, monkeypatch):
    """Blocks of a few texts that meet two by two; nothing is left behind in the catalog."""
    monkeypatch.setattr(bpe, "BLOCK", 300)
    monkeypatch.setattr(bpe, "TOGETHER", 2)
    tok = Tokenizer.from_file(default_path())
    some = [(i, f"word {i % 7} and some more words to fill it {i}" * (i % 5)) for i in range(80)]
    got = {r["doc_id"]: r["ids"] for r in rows(bpe.encode(frame(spark, some)))}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids for i, t in some}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lodestone_bpe")]


def test_shards_again_from_the_ranks(spark, monkeypatch):
    """Ranks, fractions, order and cuts recomputed in Python from the hash of each row; counts of few ranges summed at once."""
    monkeypatch.setattr(sharding, "WIDE", 3)
    df = spark.range(3000).selectExpr("if(id % 50 = 1, null, id) as doc_id", "concat('t', id) as text", "case when id % 3 = 0 then 'hot' when id % 7 > 0 then concat('s', id % 7) end as source")
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(17), "text")).otherwise(F.xxhash64(F.lit(17), "doc_id"))
    some = df.select("text", "source", F.conv(F.hex(h), 16, 10).cast("decimal(20,0)").alias("h"), h.alias("signed"), F.xxhash64(F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))).alias("s"), F.crc32(F.col("text").cast("binary")).alias("crc")).collect()
    order = []
    for source in {r["source"] for r in some}:
        own = sorted((r for r in some if r["source"] == source), key=lambda r: (int(r["h"]) >> 56, r["signed"]))
        order += [((2 * i + 1) / (2 * len(own)), r["s"], r["crc"]) for i, r in enumerate(own)]
    got = {r["position"]: r["text_crc32"] for r in rows(sharding.interleave(df, 7))}
    assert [got[i] for i in range(3000)] == [crc for _, _, crc in sorted(order)]


def test_quality_by_a_plain_learner(spark):
    """Features and updates with dictionaries, weight by weight."""
    texts = [f"good text number {i} with plain words in it" if i % 2 else f"BUY $$$ NOW {i} !!! cheap cheap cheap" for i in range(40)]
    docs, labels = frame(spark, list(enumerate(texts))), frame(spark, [(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality.train(docs, labels, epochs=2)
    mix = lambda x, s: int(quality.mix64(np.array([x], np.uint64), s)[0])
    word = lambda t: __import__("xxhash").xxh3_64_intdigest(t.encode())

    def features(text):
        tokens = re.findall(r"\w+|[^\w\s]+", text)
        w, s = [word(t) for t in tokens], [word(quality._shape(t)) for t in tokens]
        out = [mix(x, 1) for x in w] + [mix(x, 2) for x in s]
        pairs = [mix(a, 3) ^ b for a, b in zip(w, w[1:])]
        out += [mix(p, 4) for p in pairs] + [mix(mix(a, 5) ^ b, 6) for a, b in zip(s, s[1:])]
        out += [mix(int((1 - len(set(pairs)) / len(pairs)) * 10), 7)] * max(1, len(tokens) // 4)
        count = Counter(x >> 46 for x in out)
        value = {k: 1 + np.log(n) for k, n in count.items()}
        norm = np.sqrt(sum(v * v for v in value.values()))
        return {0: 1.0} | {k: float(np.float32(v / norm)) for k, v in value.items() if k}

    hashes = {r["doc_id"]: r["h"] for r in rows(docs.select("doc_id", F.xxhash64(F.lit(11), "doc_id").alias("h")))}
    use = sorted((i for i in hashes if zlib.crc32(str(i).encode()) % 5), key=hashes.get)
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= 0.05 else -(z[k] - np.sign(z[k]) * 0.05) / ((1 + np.sqrt(n[k])) / 0.3 + 0.5)
    for _ in range(2):
        for i in use:
            f = features(texts[i])
            w = {k: weight(k) for k in f}
            error = 1 / (1 + np.exp(-sum(w[k] * v for k, v in f.items()))) - i % 2
            for k, v in f.items():
                g = error * v
                z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / 0.3 * w[k]
                n[k] += g * g
    assert set(np.flatnonzero(got).tolist()) == {k for k in z if weight(k)} and all(abs(got[k] - weight(k)) < 1e-5 for k in z)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


# --- the pipeline


def test_stages_on_odd_tables(spark, clashing, tmp_path):
    frame(spark, [(1, 1), (3, 1), (4, 1), (77, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    frame(spark, [(1, "an item that stands in none of the documents here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (clashing, clashing.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.stored(stage(spark, docs, str(tmp_path)), "odd")
            assert docs.columns == clashing.columns
        ids = rows(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)))
        assert len(ids) == docs.count()


def test_stages_against_brute_force(spark):
    """Near duplicates, benchmark, personal data and token ids of a small table, each from a plain version of the stage."""
    some = [(i, t) for i, t in groups()[290:310]] + [(900, "mail me at a.b@c.de or 10.0.0.1, please"), (901, "w " * 30 + "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (902, None)]
    bench = frame(spark, [(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    df = neardup.keep_one(frame(spark, some))
    one = {i for i, (_, c) in brute_components(some, 5).items() if i == c}
    assert {r["doc_id"] for r in rows(df)} == one
    df = decontam.clean(df, bench)
    assert {r["doc_id"] for r in rows(df)} == one - {901}
    df = pii.redact(df)
    want = {}
    for i, t in some:
        spans = sorted(((s, e, k) for k, s, e in plain_spans(t or "")), reverse=True)
        for s, e, k in spans:
            t = t[:s] + f"<{k.upper()}>" + t[e:]
        want[i] = t
    masked = {r["doc_id"]: r["text"] for r in rows(df)}
    assert masked == {i: want[i] for i in one - {901}} and masked[900] == "mail me at <EMAIL> or <IP>, please"
    tok = Tokenizer.from_file(default_path())
    assert {r["doc_id"]: r["n_tokens"] for r in rows(bpe.digests(df))} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in masked.items()}
