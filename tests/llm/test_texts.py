"""Document operators against brute force, and on rows with nulls, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import columnwise, common, language, mixing, near_texts, pieces, suffixes, toxicity
from tests.llm.conftest import words

DOCS = "doc_id long, text string"


# Suffix-array dedup


def test_columns_find_what_counting_finds():
    r = np.random.default_rng(0)
    for _ in range(120):
        n, most, least = (int(r.integers(1, x)) for x in (30, 14, 6))
        lengths, group = r.integers(0, most + 1, n), np.unique(np.sort(r.integers(0, 4, n)), return_inverse=True)[1]
        texts = r.integers(1, 4, (n, most))
        texts[np.arange(most) >= lengths[:, None]] = 0
        spots = [(i, x, (group[i], *texts[i, x : x + least])) for i in range(n) for x in range(lengths[i] - least + 1)]
        counts = Counter(k for _, _, k in spots)
        expected = np.zeros((n, most), bool)
        for i, x, k in spots:
            expected[i, x] = counts[k] > 1
        assert (columnwise.repeated(texts, lengths, group, least) == expected).all()


def removed(texts, least):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - least + 1):
            if counts[d[i : i + least]] > 1:
                gone[i : i + least] = [True] * least
        runs = sum(1 for k, _ in itertools.groupby(gone) if k)
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def digest(df):
    n = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = df.select("id", (F.octet_length("__kept") + n).alias("n"), n.alias("m"), F.size("__spans").alias("k"), F.sha2("__kept", 256).alias("h")).collect()
    return sorted(tuple(r)[1:] for r in rows)


def corpus(r):
    shared = [words(r, 20 + 15 * k) for k in range(4)]
    texts = [words(r, r.randint(0, 60)) + r.choice(["", " ", "\n"]) + (r.choice(shared) if r.random() < 0.7 else "") + words(r, r.randint(0, 30)) for _ in range(60)]
    return texts + texts[:4] + ["a" * 700, "ab" * 300, "a" * 399, "é" * 250, "", None, words(r, 2000) + shared[0] + "x" + shared[0]]


@pytest.mark.parametrize("block,crowd", [(1 << 20, 2_000), (700, 2_000), (1 << 20, 3), (1 << 20, 1)])
def test_removed_bytes(spark, monkeypatch, block, crowd):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(common, "MOST_SENT", 200_000 if crowd == 3 else 0)
    texts = corpus(random.Random(block + crowd))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    assert digest(suffixes.remove_repeats(suffixes.as_bytes(docs))) == sorted(removed(texts, 400))


def test_repeats_on_dirty_rows(spark, dirty_documents, empty_documents):
    texts = [r.text for r in dirty_documents.select("text").collect()]
    assert digest(suffixes.remove_repeats(suffixes.as_bytes(dirty_documents))) == sorted(removed(texts, 400))
    assert suffixes.remove_repeats(suffixes.as_bytes(empty_documents)).count() == 0


def removed_passages(texts, words):
    """What is left of each text, and the words removed, by counting all windows of words."""
    spots = [[m.span() for m in re.finditer(rb"[^ \t\n\r\v\f]+", (t or "").encode())] for t in texts]
    keys = [[d[a:b] for a, b in s] for d, s in zip([(t or "").encode() for t in texts], spots, strict=True)]
    counts = Counter(tuple(k[i : i + words]) for k in keys for i in range(len(k) - words + 1))
    out = []
    for t, s, k in zip(texts, spots, keys, strict=True):
        d, gone = (t or "").encode(), [False] * len(k)
        for i in range(len(k) - words + 1):
            if counts[tuple(k[i : i + words])] > 1:
                gone[i : i + words] = [True] * words
        keep = [True] * len(d)
        for i in range(len(k)):
            if gone[i]:
                a = s[i - 1][1] if i and gone[i - 1] and any(counts[tuple(k[x : x + words])] > 1 for x in range(max(0, i - words), i + 1)) else s[i][0]
                keep[a : s[i][1]] = [False] * (s[i][1] - a)
        out.append((bytes(b for b, x in zip(d, keep, strict=True) if x), sum(gone)))
    return out


@pytest.mark.parametrize("crowd", [2_000, 1])
def test_passages_of_51_short_words_are_cut(spark, monkeypatch, crowd):
    """Planted passages around the limit, in words of one to three letters and in long ones; 51 words may have 101 bytes."""
    import corpus_pipeline as cp

    monkeypatch.setattr(suffixes, "CROWD", crowd)
    r = random.Random(crowd)
    made = lambda n, most: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, most))) for _ in range(n))
    planted = [made(n, most) for n in (50, 51, 52, 60) for most in (1, 3, 12)]
    texts = [words(r, r.randint(3, 40)) + r.choice([" ", "\n"]) + p + " " + words(r, r.randint(3, 40)) for p in planted for _ in range(2)]
    texts += [planted[3].replace(" ", "\n"), words(r, 2000), "é " * 60, "", None, "a" * 700, "b " * 50]
    docs = spark.createDataFrame([(i, t, "s0") for i, t in enumerate(texts)], DOCS + ", source string").repartition(3)
    got = [x.text for x in cp.cut_repeats(spark, docs, "").orderBy("doc_id").collect()]
    want = removed_passages(texts, 51)
    assert got == [None if t is None else w.decode() for t, (w, _) in zip(texts, want, strict=True)]
    cut = [n for _, n in want[: 2 * len(planted)]]
    assert cut[:6] == [0] * 6 and all(n >= 51 for n in cut[6:])


def test_words_without_blanks():
    data = "ab 日本c\u3000d\n".encode()
    begin, end = suffixes.word_edges(np.frombuffer(data, np.uint8), np.array([0, 2, len(data)]))
    assert [data[a:b].decode() for a, b in zip(begin, end, strict=True)] == ["ab", "日", "本", "c", "\u3000", "d"]


# N-gram Jaccard join


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: {j for j in sets if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (min(seen), len(links[i]))
    return out


@pytest.mark.parametrize("block,wide", [(512, 1 << 15), (5, 2)])
def test_links_of_near_texts(spark, monkeypatch, block, wide):
    monkeypatch.setattr(near_texts, "BLOCK", block)
    monkeypatch.setattr(near_texts, "WIDE", wide)
    r = random.Random(3)
    rows = []
    for g in range(12):
        base = words(r, r.randint(6, 400)).split()
        for _ in range(r.randint(1, 14)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = f"new{r.randint(0, 99)}"
            rows.append(" ".join(copy))
    rows += ["one two", "one two", "One, two!", "a b c d", "", None, "..."]
    rows = list(enumerate(rows, 10))
    got = {x.doc_id: (x.class_id, x.n_links) for x in near_texts.near_texts(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == brute_links(rows)


def test_recall_is_estimated_from_links():
    share = near_texts.found_share
    assert near_texts.recall_of({}, 0.8, 8) == 1
    assert abs(near_texts.recall_of({0: 50}, 0.8, 8) - share(0.8, 8)) < 1e-12
    assert near_texts.recall_of({0: 50}, 0.8, 8) < near_texts.recall_of({0: 50, 40: 50}, 0.8, 8) < near_texts.recall_of({0: 50, 40: 50}, 0.8, 7)


def chains(sketches, bits):
    n, root = len(sketches), list(range(len(sketches)))
    for _ in range(n):
        for a, b in itertools.combinations(range(n), 2):
            if sum(int(x).bit_count() for x in sketches[a] ^ sketches[b]) <= bits:
                root[a] = root[b] = min(root[a], root[b])
    return root


def test_sketches_that_chain_are_tied():
    r = np.random.default_rng(4)
    for n in (1, 2, 30, 60):
        hubs = r.integers(0, 2**63, (5, 4), dtype=np.int64).view(np.uint64)
        some = hubs[r.integers(0, 5, n)] ^ (np.uint64(1) << r.integers(0, 64, (n, 4), dtype=np.int64).view(np.uint64))
        assert near_texts.close(some, 6, step=3).tolist() == chains(some, 6)


def test_runs_are_tied_by_every_prefix(spark, monkeypatch):
    """Ties of a trie over batches and partitions of any size connect what shares a prefix, and nothing else; alike sketches."""
    r = random.Random(6)
    rows = [(i, bytes(r.choice([0, 0, 0, 1]) for _ in range(2 * near_texts.DEEPEST * near_texts.TREES)), bytes(32)) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for parts in (1, 5):
            found = near_texts.ties(spark.createDataFrame(rows, "node long, labels binary, sketch binary").repartition(parts), 0.8).collect()
            for depth in (8, 6, 5):
                size = 2 * near_texts.DEEPEST
                spots = [[row[1][t * size : t * size + 2 * depth] for t in range(near_texts.TREES)] for row in rows]
                pairs = [(a, b) for a, b in itertools.combinations(range(200), 2) if any(x == y for x, y in zip(spots[a], spots[b], strict=True))]
                want = near_texts.forest(200, *np.array(pairs or [(0, 0)]).T)
                got = near_texts.forest(200, *np.array([(x.u, x.v) for x in found if x.depth >= depth] or [(0, 0)]).T)
                assert (want == got).all()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_prefixes_shorten_until_the_recall(spark, monkeypatch):
    """Pairs right at the threshold: full labels miss some, the estimate says so, and shorter prefixes find them."""
    r = random.Random(5)
    rows = []
    for i in range(600):
        base = words(r, 49).split()  # 45 shingles; one word at the end less or another makes 9 of 10 or 44 of 46
        cut = r.choice([5, 9])
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: 49 - cut] if cut == 9 else [*base[:44], *words(r, 5).split()]))]
    depths = []
    was = near_texts.recall_of
    monkeypatch.setattr(near_texts, "recall_of", lambda bins, s, d: depths.append((d, was(bins, s, d))) or depths[-1][1])
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {x.doc_id: (x.class_id, x.n_links) for x in near_texts.near_texts(df).collect()}
    assert [d for d, _ in depths][:2] == [8, 7] and depths[-1][1] >= near_texts.RECALL > depths[0][1]
    assert got == brute_links(rows)


def test_near_texts_on_dirty_rows(dirty_documents, empty_documents):
    out = near_texts.near_texts(dirty_documents).collect()
    assert len(out) == dirty_documents.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.n_links == 0 and r.class_id is None and r.kept for r in by[None])
    assert by[1][0].class_id == 0 and by[1][0].n_links >= 2 and not by[1][0].kept
    assert sorted((r.n_links, r.kept) for r in by[0]) == [(0, True), (3, True), (3, True)]  # a repeated row, and its id with another text
    assert by[4][0].n_links == 0 and by[4][0].class_id == 4
    assert near_texts.near_texts(empty_documents).count() == 0


# Toxicity


def brute_segments(s):
    def inner(low, high):
        best = None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += s[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) < 1e-9 and j - i < best[2] - best[1])):
                    best = (total, i, j)
        return [] if best is None else inner(low, best[1]) + [(best[1], best[2] + 1)] + inner(best[2] + 1, high)

    return inner(0, len(s))


def test_maximal_segments():
    r = np.random.default_rng(2)
    for _ in range(200):
        s = r.normal(-0.2, 1, r.integers(0, 22))
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == brute_segments(s)
    assert toxicity.segments(np.zeros(0)) == []


@pytest.fixture(scope="module")
def toxic_model(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        w = words(r, r.randint(20, 120)).split()
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["zzvile", "zzfoul", "zzrude"]))
        rows.append((" ".join(w), int(toxic)))
    return toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))


def test_toxic_passages_are_found(spark, toxic_model):
    r = random.Random(6)
    clean = words(r, 50)
    texts = [clean, clean + " zzvile ZZfoul zzrude zzvile " + words(r, 50), "", None, "zzviler and zzfouling, zzrude"]
    out = toxicity.score_texts(spark.createDataFrame(list(enumerate(texts)), DOCS), toxic_model).orderBy("doc_id").collect()
    assert [x["__score"] >= 0.5 for x in out] == [False, True, False, False, True]
    assert out[1]["__passages"] and not out[0]["__passages"] and out[2]["__score"] == out[3]["__score"]
    p = out[1]["__passages"][0]
    assert texts[1].lower()[p["start"] : p["end"]].startswith("zzvile")


def test_toxicity_on_dirty_rows(spark, dirty_documents, empty_documents, toxic_model):
    out = toxicity.score_texts(dirty_documents, toxic_model)
    assert out.count() == dirty_documents.count() and all(0 <= r[0] <= 1 for r in out.select("__score").collect())
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (None, 1, 1), (3, 0, None), (9, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    kept = toxicity.labelled_rows(dirty_documents, labels).collect()
    assert len(kept) <= 1  # labels that contradict each other, and nulls, teach nothing
    model = toxicity.train(spark.createDataFrame([], "text string, toxic int"))
    assert all(r[0] < 0.5 for r in toxicity.score_texts(dirty_documents, model).select("__score").collect())
    assert toxicity.score_texts(empty_documents, model).count() == 0


def test_label_sample_is_bounded(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    assert 0 < toxicity.labelled_rows(docs, labels, most=100).count() <= 100


# Language


def brute_viterbi(scores, penalty):
    n, k = scores.shape
    return max(sum(scores[i, p[i]] for i in range(n)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False)) for p in itertools.product(range(k), repeat=n))


def test_viterbi_is_optimal():
    r = np.random.default_rng(3)
    for _ in range(200):
        scores = r.normal(0, r.choice([0.5, 3]), (int(r.integers(1, 7)), int(r.integers(1, 4))))
        p = language.viterbi(scores, 2.0)
        value = scores[np.arange(len(p)), p].sum() - 2.0 * (np.diff(p) != 0).sum()
        assert abs(value - brute_viterbi(scores, 2.0)) < 1e-9
    # a leading state that the best path never visits
    assert language.viterbi(np.array([[0.0, 9, -100], [0, -100, 9]]), 10.0).tolist() == [1, 2]
    assert language.viterbi(np.array([[10, -10, 0.1], [-10, 10, 0.1]]), 12.0).tolist() == [0, 1]
    for _ in range(400):
        n, k = int(r.integers(2, 7)), int(r.integers(3, 5))
        scores = np.concatenate([r.normal(0, 0.3, (n, 1)), r.choice([-3.0, 1.0, 1.9, 2.1], (n, k - 1)) + r.normal(0, 0.1, (n, k - 1))], axis=1)
        p = language.viterbi(scores, 2.0)
        assert abs(scores[np.arange(n), p].sum() - 2.0 * (np.diff(p) != 0).sum() - brute_viterbi(scores, 2.0)) < 1e-9


@pytest.fixture(scope="module")
def language_model(spark):
    r = random.Random(8)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))
    alphabets = {"aa": "abcde", "bb": "vwxyz", "ru": "абвгд"}
    rows = [(make(alphabets[k], 60), k) for k in alphabets for _ in range(20)] + [("abc", None), (None, "aa")]
    return language.train(spark.createDataFrame(rows, "text string, lang string")), make


def test_languages_and_spans(spark, language_model):
    model, make = language_model
    texts = [make("abcde", 30), make("vwxyz", 30), make("абвгд", 5), make("abcde", 30) + " " + make("vwxyz", 60), "123 ...", None, "日本"]
    out = language.label_texts(spark.createDataFrame(list(enumerate(texts)), DOCS), model).orderBy("doc_id").collect()
    assert [r["__lang"] for r in out[:6]] == ["aa", "bb", "ru", "bb", "und", "und"]
    assert out[6]["__lang"] in model.langs  # letters of a script that nobody taught
    spans = out[3]["__spans"]
    assert [s["lang"] for s in spans] == ["aa", "bb"] and spans[0]["end"] < spans[1]["start"]
    assert 0.5 < out[3]["__share"] < 1


def test_language_on_dirty_rows(spark, dirty_documents, empty_documents, language_model):
    model, _ = language_model
    out = language.label_texts(dirty_documents, model)
    assert out.count() == dirty_documents.count()
    none = language.train(spark.createDataFrame([], "text string, lang string"))
    assert {r[0] for r in language.label_texts(dirty_documents, none).select("__lang").collect()} == {"und"}
    assert language.label_texts(empty_documents, model).count() == 0


def test_clashing_names_keep_their_values(spark, language_model):
    """Columns with two underscores come through, but for those named as a result."""
    rows = spark.createDataFrame([(1, "s0", "abc", b"abc", 1, 2, 7, 8, 9, 10, 11)], "doc_id long, source string, text string, data binary, id long, print long, __mark int, __key int, __Spans int, __place int, __kept2 int")
    for out, own in (
        (mixing.mix(rows, {"s0": 1}), {"__place"}),
        (language.label_texts(rows, language_model[0]), {"__spans"}),
        (suffixes.remove_repeats(rows), {"__spans"}),
        (pieces.tokenize(rows), set()),
    ):
        got = {c.lower(): v for c, v in out.first().asDict().items()}
        assert len(got) == len(out.columns)
        for name, value in (("__mark", 7), ("__key", 8), ("__spans", 9), ("__place", 10), ("__kept2", 11)):
            assert (got[name] == value) == (name not in own), name


# Mixing


def simulate(weights, blocks):
    """Earliest deadline first, slot by slot, with weights among the sources that are left."""
    done, since, order = dict.fromkeys(blocks, 0), dict.fromkeys(blocks, 0), []
    start, active = 0, {s for s in blocks if blocks[s]}
    while active:
        total = sum(weights[s] for s in active)
        t = len(order) - start
        ready = [(-(-(since[s] + 1) * total // weights[s]), -weights[s], s) for s in sorted(active) if since[s] * total // weights[s] <= t]
        s = min(ready)[2]
        order.append(s)
        done[s] += 1
        since[s] += 1
        if done[s] == blocks[s]:
            active.discard(s)
            start, since = len(order), dict.fromkeys(blocks, 0)
    return order


def test_schedule_against_a_simulation():
    r = random.Random(9)
    for _ in range(60):
        names = [f"s{i}" for i in range(r.randint(1, 5))]
        weights = {s: r.randint(1, 12) for s in names}
        blocks = {s: r.randint(1, 30) for s in names}
        plan = mixing.phases(weights, blocks)
        slots = {(s, j): mixing._slot_of(plan, s, j) for s in names for j in range(blocks[s])}
        assert sorted(slots.values()) == list(range(sum(blocks.values())))
        order = sorted(slots, key=slots.get)
        assert [s for s, _ in order] == simulate(weights, blocks)


def test_deviation_is_below_one_block():
    weights = {"a": 30, "b": 20, "c": 7, "d": 1}
    order, total = mixing.period(weights), sum(weights.values())
    for s, w in weights.items():
        got = np.cumsum([x == s for x in order])
        assert (abs(got - np.arange(1, total + 1) * w / total) < 1).all()


@pytest.mark.parametrize("bucket", [500, 2])
def test_every_row_has_a_place(spark, dirty_documents, empty_documents, bucket):
    out = mixing.mix(dirty_documents, {"s0": 3, "s1": 1}, block_rows=2, bucket_rows=bucket)
    rows = out.select("doc_id", "__source", "__block", "__slot", "__place").orderBy("__place").collect()
    assert [r["__place"] for r in rows] == list(range(dirty_documents.count()))
    assert [r["__slot"] for r in rows] == sorted(r["__slot"] for r in rows)
    assert {r["__source"] for r in rows} == {"s0", "s1", mixing.REST}
    assert all(len({x["__source"] for x in g}) == 1 for _, g in itertools.groupby(rows, lambda r: r["__slot"]))
    assert mixing.mix(empty_documents, {"s0": 1}).count() == 0


def test_rows_before_a_bucket(spark):
    r = random.Random(2)
    sizes = [(s, b, r.randint(1, 9)) for s in "xy" for b in range(40) if r.random() < 0.8]
    rows = spark.createDataFrame(sizes, "__source string, __bucket int, count long").repartition(3)
    for span in (1, 7, 1000):
        got = {(x[0], x[1]): x[2] for x in mixing._before(rows, span).collect()}
        assert got == {(s, b): sum(n for t, c, n in sizes if t == s and c < b) for s, b, _ in sizes}


# SentencePiece


def test_rebuilt_tokenizer_is_the_same():
    data = open(pieces.MODEL_PATH, "rb").read()
    made, twin, decoder, differ = pieces.load(data)
    assert differ == 0
    text = "Straße\n\n  zwei  Leerzeichen 🙂 <s> <0x41>"
    ids = made.encode(text, add_special_tokens=False).ids
    assert ids == twin.encode(text) and decoder.texts(np.array(ids), np.array([0, len(ids)])) == [text]


def test_unigram_models_are_rebuilt():
    """A small unigram model written field by field; no tokenizer is trained."""
    import struct

    def field(number, kind, value):
        head = bytes([number << 3 | kind])
        return head + (bytes([len(value)]) + value if kind == 2 else value)

    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁ab", -2.0, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces_)
    data += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    spec = pieces.read_model(data)
    assert (spec.kind, spec.byte_fallback, spec.unknown, spec.dummy_prefix, spec.squeeze) == (pieces.UNIGRAM, True, 0, True, False)
    made = pieces.build(spec)
    shown = [spec.pieces[i][0] for i in made.encode("ab ba", add_special_tokens=False).ids]
    assert shown == ["▁ab", "▁", "b", "a"]
    assert [spec.pieces[i][0] for i in made.encode("é", add_special_tokens=False).ids][-2:] == ["<0xC3>", "<0xA9>"]


def test_tokens_on_dirty_rows(dirty_documents, empty_documents):
    out = pieces.tokenize(dirty_documents, check_rows=True).collect()
    assert all(r["__same"] and r["__decoded"] == (r.text or "") for r in out) and len(out) == dirty_documents.count()
    assert all(r["__ids"] == [] for r in out if not r.text)
    assert pieces.tokenize(empty_documents).count() == 0
