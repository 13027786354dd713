import hashlib
import random
import re
import time
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.orc
import pytest

from votelake.llm import alignment, token_files, variants

from . import data

BYTE, PIECE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = ["a▁b", "  two  blanks \n\n and tabs\t.", "<|endoftext|> <s> </s> <unk> <|startoftext|> <|ENDOFTEXT|>", "名前 は 日本 です", "don't we'll I'M", "\x00\x1c\x85 \xa0 x", "e ́ é ᄀ ᅡ 가", "🙂🙃 " * 30, "ÀÉ İ ß ﬁ Ǆ"]


@pytest.fixture(scope="module", params=["rows", "empty"])
def sf(request, spark, tmp_path_factory):
    given = data.rows() + [(100 + i, t, "en", "s1", 1, 1, 1, 1, 1) for i, t in enumerate(ODD)]
    return data.save(spark, tmp_path_factory.mktemp(request.param), given if request.param == "rows" else [])


def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def random_text(rng):
    return "".join(rng.choice("aab  eé\ń\x85\xa0 7.,'!s▁<|>İß中🙂") for _ in range(rng.randint(0, 60)))


def brute_alignment(rows):
    """Every token occurrence by its end, without windows."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    left.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    assert sorted(alphabet.values()) == list(range(256))
    docs, count = [], Counter()
    for doc_id, text in rows:
        a = left.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        of_a = [bytes(alphabet[c] for c in left.id_to_token(i)) for i in a]
        of_b = [bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [right.id_to_piece(i)]]
        if not text or not b"".join(of_a) == b"".join(of_b) == f" {text}".encode():
            a = b = of_a = of_b = []
        ends = [np.cumsum([len(x) for x in of]).tolist() for of in (of_a, of_b)]
        shared = sorted({*ends[0]} & {*ends[1]})
        at_a, at_b = dict(zip(ends[0], a)), dict(zip(ends[1], b))
        links = [(at_a[e], at_b[e]) for e in shared]
        count.update(links)
        groups = [[",".join(map(str, ids[bisect_right(own, low) : bisect_right(own, high)])) for ids, own in ((a, ends[0]), (b, ends[1]))] for low, high in zip([0, *shared], shared)]
        docs.append((doc_id, len(a), len(b), links, ";".join("|".join(g) for g in groups)))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(i, n_a, n_b, len(ls), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if ls else "") for i, n_a, n_b, ls, g in docs]


def test_alignment_against_every_token_end(spark, sf):
    got = alignment.op11_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_alignment(docs(spark, sf)))


def test_alignment_of_random_texts_and_windows(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    rows = [(i, random_text(rng)) for i in range(300)]
    at = data.save(spark, tmp_path, [(i, t, None, None, 1, 1, 1, 1, 1) for i, t in rows])
    assert Counter(tuple(r) for r in alignment.op11_alignment(spark, at).collect()) == Counter(brute_alignment(rows))
    windows = alignment.Windows(alignment.byte_side(BYTE), alignment.piece_side(PIECE))
    monkeypatch.setattr(alignment, "WINDOWS", 6)  # forgetting windows changes nothing
    small = alignment.Windows(windows.left, windows.right)
    assert all(alignment.align(t, windows) == alignment.align(t, small) for _, t in rows) and len(small) <= 6
    text = "the same words and the same windows again and again " * 50
    windows.clear()
    alignment.align(text, windows)
    assert len(windows) < 14


def test_pieces_of_long_texts_encode_like_the_whole():
    rng = random.Random(4)
    windows = alignment.Windows(alignment.byte_side(BYTE), alignment.piece_side(PIECE))
    for _ in range(200):
        text = random_text(rng) + " and some words, with 3 numbers " * 3 + random_text(rng)
        assert alignment.align(text, windows, most=7) == alignment.align(text, windows)
    assert len(alignment.pieces("some words here and there", 4)) == 4


def test_encoding_by_rank_equals_the_file(spark):
    from tokenizers import Tokenizer

    plain, side = Tokenizer.from_file(BYTE), alignment.byte_side(BYTE)
    plain.encode_special_tokens = True
    rng = random.Random(9)
    settled = [chr(c) for c in range(0x2060) if alignment.SETTLED.fullmatch(chr(c))] + ["€"]
    texts = [f"a{c}b {c} 1{c}{c} {c}' {c}\n" for c in settled] + ["".join(rng.choices(settled[:128] * 3 + settled, k=60)) for _ in range(3000)] + [random_text(rng) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    assert sum(bool(alignment.SETTLED.fullmatch(t)) for t in texts) > 3500
    assert all(side.encode(t) == plain.encode(" " + t, add_special_tokens=False).ids for t in texts)


def test_pairs_stay_within_the_vocabularies_bound(spark, sf):
    aligned = alignment.align_tokens(spark.read.parquet(f"{sf}/documents.parquet"), BYTE, PIECE)
    width = len(alignment.piece_side(PIECE).sizes)
    rows = alignment.count_pairs(aligned, width).collect()
    bound = alignment.pair_bound(BYTE, PIECE)
    left, right = alignment.byte_side(BYTE).entries, alignment.piece_side(PIECE).entries
    assert len(rows) <= bound < 600_000
    assert all(left[r.id_a].endswith(right[r.id_b]) or right[r.id_b].endswith(left[r.id_a]) for r in rows)
    assert all(r.pair == r.id_a * width + r.id_b for r in rows)


def brute_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    ids = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows]
    return [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids], sum(len(x) for _, x in ids)


def test_token_files_hold_every_id_in_order(spark, sf):
    want, total = brute_tokens(docs(spark, sf))
    got = token_files.op12_token_files(spark, sf).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [2**63 - 1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and sum(r.n_tokens for r in got) == total


def test_words_encode_like_whole_texts(spark, monkeypatch):
    rng = random.Random(5)
    words = token_files.WordIds(WORD)
    texts = [random_text(rng) for _ in range(2000)] + ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["Ähm, Ähm. well!! a'b, c,d. don't, x́, é́.", "words " * 3, "WORDS, Words. <|EndOfText|> x", "123 a1 1a, e2e."]
    assert all(words.by_words(t or "") == words.whole(t or "") for t in texts)
    monkeypatch.setattr(token_files, "WORDS", 8)  # forgetting words changes nothing
    small = token_files.WordIds(WORD)
    assert all(small.by_words(t or "") == words.by_words(t or "") for t in texts[:300])


def test_groups_of_texts_encode_like_each(monkeypatch):
    """New words of a group go to the library in few calls, whatever their letters; texts with special tokens stand between others."""
    rng = random.Random(7)
    say = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(30))
    texts = ["", *(say(x) for x in ("abcé", "жизнь", "日本語", "a'b1,.", "e\u0301\u0344x")), " \t", "a <|EndOfText|> b", "<|endoftext|", "<|<|", " x ", "<|startoftext|>", *ODD]
    texts = [t or "" for t in texts]
    words = token_files.WordIds(WORD)
    want = [words.whole(t) for t in texts]
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(token_files, "GROUP_BYTES", size)
        own, given, got = token_files.WordIds(WORD), pa.array(["lead", *texts], pa.string())[1:], []
        for a, b in token_files.groups(given):
            ids, many = own.of_texts(given[a:b])
            assert ids.dtype == np.dtype("<u4") and len(many) == b - a
            got += [x.tobytes() for x in np.split(ids, many.cumsum())[:-1]]
        assert got == want
    calls, fresh = [], token_files.WordIds(WORD)
    whole = fresh.whole
    monkeypatch.setattr(fresh, "whole", lambda t: calls.append(t) or whole(t))
    fresh.of_texts(pa.array([say("жизнь") + " " + say("abc") for _ in range(50)]))
    assert len(calls) == 2


def test_closed_words_encode_like_the_library():
    """Heads of every kind with every closing mark, whether the head was known before or not."""
    heads = ["abc", "été", "École", "ÀÖØß", "don't", "it's", "a1", "7", "#", "™", "x×", "e\u0301", "жизнь", "(abc", "", "-"]
    marks = ["", *".,;:!?|)", "...", "?!", ").", "#.", ".a", "='"]
    words = token_files.WordIds(WORD)
    for texts in ([h + m for h in heads for m in marks], [m + h for m in marks for h in heads]):
        ids, many = words.of_texts(pa.array(["abc. abc 7.", *texts], pa.string())[1:])
        assert [x.tobytes() for x in np.split(ids, many.cumsum())[:-1]] == [words.whole(t) for t in texts]


def test_known_words_cost_little_beside_the_library():
    """Words that a worker has met go from Arrow to ids in a small part of the CPU time that the library takes for them."""
    rng = random.Random(8)
    runs = list({"".join(rng.choices("abcdefghijkl", k=9)) for _ in range(60_000)})
    text, given = " ".join(runs), pa.array([" ".join(r + rng.choice(["", "."]) for r in runs[k : k + 600]) for k in range(0, len(runs), 600)])
    words = token_files.WordIds(WORD)
    words.of_texts(given)

    def least(call):
        took = []
        for _ in range(5):
            began = time.thread_time()
            call()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: words.of_texts(given)) < 0.17 * least(lambda: words.whole(text))


def scanned(df):
    """Rows that the scans of token files hand on, and the filters that they push down."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = re.findall(r"PushedFilters: \[([^\]]*doc_id[^\]]*)\]", plan)

    def leaves(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return leaves(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return leaves(p.plan())
        if name == "FileSourceScanExec":
            return [p]
        kids = p.children()
        return [x for k in range(kids.size()) for x in leaves(kids.apply(k))]

    scans = leaves(df._jdf.queryExecution().executedPlan())
    rows = [s.metrics().apply("numOutputRows").value() for s in scans if "tokens" in s.relation().location().rootPaths().toString()]
    return sum(rows), pushed


def test_lookups_prune_by_index_and_bloom_filter(spark, tmp_path):
    # even ids alone: an odd one lies inside a row group's range, and only its Bloom filter can rule it out
    docs = spark.range(0, 40000, 2).selectExpr("id AS doc_id", "concat('some words of document ', id) AS text")
    at = str(tmp_path / "t")
    token_files.write_tokens(docs, at, WORD, stripe_bytes=1 << 16)
    files = list((tmp_path / "t" / "tokens").glob("*.orc"))
    assert sum(pyarrow.orc.ORCFile(f).nrows for f in files) == 20000
    assert any(pyarrow.orc.ORCFile(f).nstripes > 1 for f in files)
    rows, pushed = scanned(token_files.read_tokens(spark, at, [7000]))
    assert pushed and 1 <= rows <= 2 * token_files.INDEX_ROWS
    rows, _ = scanned(token_files.read_tokens(spark, at, [7001]))
    assert rows <= token_files.INDEX_ROWS  # a filter errs once in a hundred
    whole = sorted((tuple(r) for r in token_files.read_tokens(spark, at).collect()), key=lambda r: r[1])
    assert tuple(token_files.read_tokens(spark, at, [7000]).collect()[0]) in whole
    first, last = whole[300][1] + 2, whole[340][1]
    assert sorted((tuple(r) for r in token_files.read_range(spark, at, first, last).collect()), key=lambda r: r[1]) == whole[300:340]
    parts = sorted(tuple(r) for r in token_files.read_parts(spark, at).collect())
    assert len(parts) == len(files) and all(a[5] < b[4] and a[1] + a[3] == b[1] for a, b in zip(parts, parts[1:]))


def test_stripes_of_one_file_are_read_by_several_tasks(spark, tmp_path):
    docs = spark.range(0, 20000, 1, 1).selectExpr("id AS doc_id", "concat('words ', sha2(string(id), 256)) AS text")
    at = str(tmp_path / "t")
    token_files.write_tokens(docs, at, WORD, stripe_bytes=1 << 16)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 17))
    try:
        got = token_files.read_tokens(spark, at)
        files = len(list((tmp_path / "t" / "tokens").glob("*.orc")))
        assert got.rdd.getNumPartitions() > files
        rows = sorted(got.select("start", "n_tokens").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, times=5):
    forms, out = {}, {}
    for w, n in counts.items():
        found = sorted((-m, v) for v, m in counts.items() if near(w, v))
        forms[w] = found[0][1] if found and -found[0][0] >= times * n else None
        out[w] = n, len(found)
    rows = []
    for w, (n, k) in out.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n, k, counts.get(forms[w])))
    return rows


def brute_words(rows):
    count = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def test_variants_against_all_pairs(spark, sf):
    got = variants.op13_variants(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_variants(brute_words(docs(spark, sf))))


def test_variants_of_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = brute_variants(brute_words(rows))
    assert Counter(tuple(r) for r in variants.op13_variants(spark, "/root/testdata/sf0.001").collect()) == Counter(want)
    assert sum(r[4] > 0 for r in want) > 10


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_of_crowded_words(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("aab") for _ in range(rng.randint(1, 6))) for _ in range(400)} | {"", "é", "éé"}
    counts = {w: rng.choice([1, 1, 2, 5, 25, 25, 125, 700]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = variants.group_variants(df).select("word", "form", "root", "n", "n_near", "form_n")
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_variants(counts))


def test_one_misspelling_in_so_many(spark):
    hit = next(i for i in range(10000) if zlib.crc32(f"{i}:letters".encode()) % 199 == 0)
    k = zlib.crc32(f"{hit}:letters".encode()) % 7
    df = spark.createDataFrame([(hit, "Letters LETTERS"), (None, "Lettersÿ×")], "doc_id long, text string")
    assert {(r.word, r.n) for r in variants.count_words(df).collect()} >= {("letters"[:k] + "letters"[k + 1 :], 2)}
