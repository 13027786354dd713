import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from votelake.llm import decontamination, substrings, urls

from . import data


def brute(rows, length):
    """(id, bytes, removed, spans, digest) for (id, text)."""
    raws = [(t or "").encode() for _, t in rows]
    many = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws):
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if many[r[k : k + length]] > 1:
                gone[k : k + length] = True
        gone = gone[: len(r)]
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((i, len(r), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("given", ["rows", "empty"])
def test_substrings_awkward(spark, tmp_path, given):
    rows = data.rows() if given == "rows" else []
    sf = data.save(spark, tmp_path, rows)
    assert Counter(tuple(r) for r in substrings.op4_substrings(spark, sf).collect()) == brute([(r[0], r[1]) for r in rows], 200)


def test_substrings_tell_rows_without_id_apart(spark):
    """Two texts whose 32-bit hashes are equal, of which one shares bytes with a third text."""
    rng = random.Random(0)
    say = lambda k: "".join(rng.choice("abcdefghijklmnop ") for _ in range(k))
    shared = say(300)
    texts = spark.range(200_000).select(F.concat(F.lit(shared), F.md5(F.concat(F.lit("a"), F.col("id")))).alias("a"), F.concat(F.lit(say(300)), F.md5(F.concat(F.lit("b"), F.col("id")))).alias("b"))
    both = texts.select(F.hash("a").alias("h"), "a").join(texts.select(F.hash("b").alias("h"), "b"), "h").orderBy("a", "b").first()
    assert both is not None
    rows = [(None, both.a), (None, both.b), (3, shared + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 200)


def test_substrings_random(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé\x00") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))))
        rows.append((i, " ".join(parts)))
    rows += [(200, "ab" * 300), (201, "x" + "ab" * 120), (202, "q" * 450), (203, "q" * 199), (204, shared[0][:150] + "!" + shared[0][150:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length, anchor in ((200, 48), (60, 20), (20, 8)):
        got = substrings.remove_repeats(docs, length, anchor).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        assert Counter(tuple(r) for r in got.collect()) == brute(rows, length), length


def test_columns_in_files(monkeypatch, tmp_path):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(substrings, "IN_MEMORY", 10)
    rows = rng.integers(97, 100, (40, 24)).astype(np.uint16)
    columns = substrings.Columns(24, str(tmp_path))
    for k in range(0, 40, 8):
        columns.add(rows[k : k + 8])
    assert isinstance(columns.blocks[0], np.ndarray) and not isinstance(columns.blocks[-1], np.ndarray) and len(list(tmp_path.iterdir())) == 3
    group, first, end = np.sort(rng.integers(0, 6, 40)), rng.integers(0, 4, 40), rng.integers(18, 25, 40)
    hit = np.zeros((40, 21), bool)
    for row, a, b in substrings.repeated_runs(columns, group, 4, first, end):
        for i, x, y in zip(row, a, b):
            assert not hit[i, max(0, x - 1) : y + 2].any()  # runs are maximal
            hit[i, x : y + 1] = True
    for i in range(40):
        for j in range(21):
            assert hit[i, j] == (first[i] <= j and j + 4 <= end[i] and any(k != i and group[k] == group[i] and (rows[k, j : j + 4] == rows[i, j : j + 4]).all() for k in range(40)))
    columns.close()
    assert not list(tmp_path.iterdir())


def test_urls_brute_force(spark, tmp_path):
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "com", "org", "example", "A", "x-y"])
    pages = [(i, f"http://{'.'.join(label() for _ in range(rng.randint(1, 4)))}{rng.choice(['', '/', '/a', '/a/b', '/ab/', '/b?x=/', '#/a'])}") for i in range(400)]
    pages += [(900, None), (901, "no scheme"), (902, "http://"), (903, "ftp://example.org/es/x?y"), (903, "ftp://example.org/es/x?y"), (None, "http://EXAMPLE.org/en/12"), (904, "a://b://c/d"), (905, "http://a..com/a"), (906, "http://u\nv.com/a\nb")]
    rules = [(h, p, v) for h, p, v in [("com", "/", "allow"), ("a.com", "/a", "block"), ("com", "/ab", "block"), ("b.a.com", "/", "allow"), ("a.com", "", "block"), ("org", "/a/", "block"), ("x-y", "/", "block")]]
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = urls.filter_urls(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fit = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[2], max(fit)[1]) if fit else (host, path, None, "allow")

    assert Counter(tuple(r) for r in got) == Counter((i, *judge(u)) for i, u in pages)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(empty, spark.createDataFrame(rules, "host string, path string, verdict string")).collect() == []


def corpus(rng, n=120):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, f"{say(20)}. {say(12).capitalize()}?") for i in range(12)]
    rows = [[i, say(rng.randint(30, 300))] for i in range(n)]
    planted = set()
    for i in range(0, 48, 4):
        item, text = items[i // 4]
        if i % 8:
            parts = text.split()
            text = " ".join(w if k % 6 else rng.choice(words) for k, w in enumerate(parts))  # a paraphrase keeps five words of six
        head, tail = rows[i][1][:80], rows[i][1][80:]
        rows[i][1] = f"{head} {text.upper()} {tail}"
        planted.add((i, item))
    return rows, items, planted


def test_decontamination(spark, tmp_path):
    rows, items, planted = corpus(random.Random(8))
    data.save(spark, tmp_path, [(i, t, "en", "s", 1, 1, 1, 1, 1) for i, t in rows] + [(900, None, None, None, 1, 1, 1, 1, 1), (901, "", None, None, 1, 1, 1, 1, 1), (902, "a", None, None, 1, 1, 1, 1, 1)])
    spark.createDataFrame(items + [(50, None), (51, "too short"), (None, rows[100][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontamination.op2_decontamination(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted | {(100, None)}
    none = decontamination.drop_leaks(data.make(spark), spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == len(data.rows())


def brute_matches(text, items):
    """item ids that some window's surroundings hold, by the subsequence and answer checks alone."""
    words, out = decontamination.words_of(text), set()
    for name, item in items:
        own = decontamination.words_of(item)
        if len(own) < decontamination.MIN_WORDS:
            if own and any(words[i : i + len(own)] == own for i in range(len(words))):
                out.add(name)
            continue
        n, answer = len(own), decontamination.words_of(item.strip().split(". ")[-1])
        for s in range(max(1, -(-len(words) // 8) - 1)):
            around = words[max(0, 8 * s - n) : 8 * s + 16 + n]
            if subsequence(own, around) >= 0.6 * n and subsequence(answer, around) >= 0.5 * len(answer):
                out.add(name)
                break
    return out


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_decontamination_recall(spark, monkeypatch):
    """The gate loses nothing, and the cosine step keeps 0.9 of what a search of all windows finds."""
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    items = [(k, " ".join(rng.choices(names, k=rng.choice((10, 12, 16, 30)))) + f". say only{k} {names[k]}") for k in range(40)]
    items += [(None, " ".join(names[:20])), (70, "short item here"), (71, "of four words only"), (72, "")]
    texts = [" ".join(rng.choices(names, k=rng.choice((60, 100, 140)))) for _ in range(90)]
    for k in range(90):
        cut = rng.randrange(300)
        said = " ".join(w if rng.random() < 0.8 else rng.choice(names) for w in items[k % 42][1].split())
        texts[k] = f"{texts[k][:cut]} {said} {texts[k][cut:]}"
    texts += ["", "a", " ".join(names[:20]), " ".join(names[3:18]), "of four words", "of  FOUR words, only"]
    plain = [(k, " ".join(rng.choices(names, k=120))) for k in range(100)]
    (searcher,) = decontamination.searchers(spark.createDataFrame(plain, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert all(searcher.weights[searcher.terms.slots[f"only{k}".encode()]].any() for k in range(40))
    want = [brute_matches(t, items) for t in texts]
    found = lambda: [{m["item_id"] for m in searcher.matches(t)} for t in texts]
    got = found()
    assert sum(map(len, want)) > 60 and all(g <= w for g, w in zip(got, want)) and sum(map(len, got)) >= 0.9 * sum(map(len, want))
    monkeypatch.setattr(decontamination, "COSINE", -2.0)
    assert found() == want


def test_latent_basis_is_of_all_documents(spark):
    """The basis of 24,000 documents and the benchmark is that of their whole window matrix."""
    rng = random.Random(6)
    names = [f"w{k}" for k in range(20)] + ["other"]
    texts = [" ".join(rng.choices(names, [k % 7 + 1 + 9 * (i > 20_000) * (k > 10) for k in range(21)], k=rng.randint(0, 20))) for i in range(24_000)]
    items = [" ".join(names[:20]), " ".join(names[19::-1])]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, None), (None, " \t")], "doc_id long, text string").repartition(4)
    latent = decontamination.Latent(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    at = {w.encode(): k for k, w in enumerate(sorted(names[:20]))}
    df, gram = np.zeros(20), np.zeros((20, 20))
    for text in texts:
        df[sorted({at[w] for w in text.encode().split() if w in at})] += 1
    idf = np.log((len(texts) + 3) / (df + 1)) + 1
    for text in texts + items:
        words = text.encode().split()
        for a in range(0, len(words), 8):
            v = np.zeros(20)
            for w in words[a : a + 8]:
                if w in at:
                    v[at[w]] += idf[at[w]]
            norm = sum(idf[at[w]] ** 2 for w in words[a : a + 8] if w in at)
            gram += np.outer(v, v) / max(norm, 1e-9)
    inverse = np.linalg.inv(gram)  # of all directions V / s, V / s * (V / s)' is the inverse of A'A
    got = latent.weights[:20] @ latent.weights[:20].T / np.outer(idf, idf)
    assert latent.df[:20].tolist() == df.tolist()
    assert np.allclose(got / np.trace(got), inverse / np.trace(inverse), atol=2e-4)


def test_pipeline_fits_on_all_documents(spark, tmp_path, monkeypatch):
    """The stage's basis comes from each document and item once, whatever their number."""
    spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w1 w2 t"), F.col("id")).alias("text"))
    seen, fit = [], decontamination.latent_basis
    monkeypatch.setattr(decontamination, "latent_basis", lambda texts, *rest: seen.append((texts.count(), texts.distinct().count())) or fit(texts, *rest))
    assert corpus_pipeline.clean(spark, docs, str(tmp_path)).count() == 24_000
    assert seen == [(24_001, 24_001)]


def test_slots_of_texts():
    """Slots of Arrow texts are those of the texts' words, with words by slot and by hash."""
    texts = [None, "", "  a b ", "\tA-b\x00c", "é É ünï", "x" * 300, "a\u3000b", *(r[1] for r in data.rows())]
    for words in ([b"a", b"b", b"fox", "é".encode()], [b"%d" % k for k in range(decontamination.SLOTS + 1)]):
        terms = decontamination.Terms(words)
        for given in (pa.array(texts, pa.string()), pa.array(["lead", *texts], pa.string())[1:], pa.array(texts, pa.string())[:0]):
            ids, many = terms.of_texts(given)
            want = [terms.of(decontamination.words_of(t)) for t in given.to_pylist()]
            assert many.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w.tolist()]


def test_decontamination_in_blocks(spark, monkeypatch):
    rows, items, planted = corpus(random.Random(8), 60)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in decontamination.find_leaks(docs, bench).collect()}
    assert {r[:2] for r in whole} == planted
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 5)
    assert {tuple(r) for r in decontamination.find_leaks(docs, bench).collect()} == whole
    assert {r.doc_id for r in decontamination.drop_leaks(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in planted}
    monkeypatch.setattr(decontamination, "SLOTS", 64)  # words share slots
    assert {r.doc_id for r in decontamination.find_leaks(docs, bench).collect()} <= {i for i, _ in planted}


def test_common_words_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 12))], [rng.choice([b"a", b"b", b"c", b"e"]) for _ in range(rng.randint(0, 12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.common_words(decontamination.places(a), len(a), b) == t[-1][-1]


@pytest.mark.parametrize("given", ["rows", "empty"])
def test_pipeline(spark, tmp_path, given):
    rows, items, planted = corpus(random.Random(9))
    both = [(i, t, "en", "s" + str(i % 3), len(t), 1, 1, 1, 1) for i, t in rows] + [(1000 + i, t, "en", "s1", len(t), 1, 1, 1, 1) for i, t in rows[:20]]
    sf = data.save(spark, tmp_path, both + data.rows() if given == "rows" else [])
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    if given == "empty":
        assert out == []
        return
    ids = {r.doc_id for r in out}
    assert not ids & {i for i, _ in planted} and not ids & set(range(1000, 1020))
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
    assert [k for k, _ in corpus_pipeline.STAGES][0] == "quality" and len(corpus_pipeline.STAGES) == 5
