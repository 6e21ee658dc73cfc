"""Operators on vectors, pages and conversations, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import chat, html_text, near_vectors, queries, topk

NAN, INF = float("nan"), float("inf")


# Embedding near-dedup


def brute_near(rows, cosine):
    """(vec_id, links, component, kept) of every row, each a vector of its own."""
    fit = [i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    scaled = [np.array(v, float) / max(map(abs, v)) if f else None for f, (_, v) in zip(fit, rows, strict=True)]
    unit = [x / np.linalg.norm(x) if x is not None else None for x in scaled]
    near = lambda a, b: a != b and fit[a] and fit[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine
    links = [[b for b in range(len(rows)) if near(a, b)] for a in range(len(rows))]
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in set(links[todo.pop()]) - seen:
                seen.add(b)
                todo.append(b)
        least = i if i is None else min(rows[b][0] for b in seen)
        out.append((i, len(links[a]), least, i == least))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [2048, 6])
def test_near_vectors(spark, most):
    r = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        c = r.normal(size=16)
        rows += [(c + r.normal(size=16) * r.choice([0.02, 0.1])).tolist() for _ in range(r.integers(1, 15))]
    rows += [[0.0] * 16, None, [], [1.0] * 8, [1.0] * 8, [NAN] * 16, [1.0, None] + [0.0] * 14, [INF] * 16, [1e-300] * 16, [1e300] * 16]
    rows = list(enumerate(rows)) + [(None, [1.0] * 16), (0, rows[0]), (0, rows[40]), (1, [-x for x in rows[1]]), (500, rows[1])]
    kinds = "vec_id long, vector array<double>, node int, one_print string, copies int, __found int"
    df = spark.createDataFrame([(*x, 1, "b", None, 2) for x in rows], kinds).repartition(3)
    got = [(x.vec_id, x.n_links, x.component_id, x.kept) for x in near_vectors.near_vectors(df, recall=0.9999, most=most).collect()]
    assert sorted(got, key=repr) == brute_near(rows, 0.9)


def test_many_equal_vectors(spark):
    """A hundred thousand rows of one vector are one class, whatever their number squared."""
    import time

    rows = spark.range(100_000).select(F.col("id").alias("vec_id"), F.expr("array(1f, 2f, 0f)").alias("vector"))
    rows = rows.unionByName(spark.createDataFrame([(100_000, [2.0, 4.0, 0.1]), (100_001, [0.0, 0.0, 1.0])], "vec_id long, vector array<float>"))
    began = time.time()
    got = near_vectors.near_vectors(rows).groupBy("n_links", "component_id").count().collect()
    assert sorted(tuple(x) for x in got) == [(0, 100_001, 1), (100_000, 0, 100_001)] and time.time() - began < 60


def test_hashes_do_not_depend_on_the_batch():
    r = np.random.default_rng(3)
    rows = near_vectors.unit(r.normal(size=(300, 64)))
    family = near_vectors.Family(64, 9, 32, 2.0, 11)
    whole = family.keys(rows, 0, 32)
    assert all((family.keys(rows[i : i + n], 0, t) == whole[i : i + n, :t]).all() for i, n, t in ((0, 1, 32), (7, 100, 5), (299, 1, 1)))


def test_recall_at_the_threshold(spark):
    """Pairs right at the threshold are found with about the planned recall."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a = r.normal(size=64)
        b = r.normal(size=64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.9005 * a + np.sqrt(1 - 0.9005**2) * b).tolist())]
    out = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, vector array<double>"))
    assert out.agg(F.sum("n_links")).first()[0] / 800 >= 0.98


def test_no_vectors(spark):
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, vector array<float>")).count() == 0


# Exact top-k search


def brute_top(rows, k, asks):
    """Every row against every other row."""
    fit = [(i, v) for i, v in rows if i is not None and v]
    held = lambda x: max(min(x, 2**63 - 1), -(2**63) + 1)
    out = []
    for n, (q, u) in enumerate(fit):
        if asks(q):
            scored = sorted((-held(sum(x * y for x, y in zip(u, v, strict=True))), i) for m, (i, v) in enumerate(fit) if m != n and len(v) == len(u))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale,group", [(1000, 4096), (1000, 20), (2**29, 50), (2**40, 50)])
def test_top_k(spark, scale, group):
    r = random.Random(scale + group)
    rows = [(i, [r.randint(-scale, scale) for _ in range(r.choice([7, 7, 7, 3]))]) for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (None, rows[3][1]), (202, None), (203, []), (204, [0] * 7), rows[5], rows[10], (20, rows[7][1])]
    extra = "dims int, part string, asks int, score long, rank int, query_id long"
    df = spark.createDataFrame([(*x, 1, "p", None, 5, 6, 7) for x in rows], f"vec_id long, vector array<long>, {extra}").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=10, block=2, group_rows=group).collect()
    assert sorted(tuple(x) for x in got) == brute_top(rows, 10, lambda q: q % 10 == 0)


def test_fewer_candidates_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, vector array<long>")
    assert [tuple(x) for x in topk.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 11)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_usable(spark):
    df = spark.createDataFrame([([1.0],), (None,), ([],), ([NAN],), ([INF],), ([None],)], "v array<double>")
    assert [x[0] for x in df.select(topk.usable(F.col("v"))).collect()] == [True] + [False] * 5


# HTML extraction

PAGES = [
    ("<p>One<p>Two <b>bold</b> text<br>line", "One\n\nTwo bold text\nline"),
    ("<ul><li>a<li>b<ol start=3><li>x<li value=9>y</ol><li>c</ul>after", "- a\n- b\n  3. x\n  9. y\n- c\n\nafter"),
    ("<table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td rowspan=2>r<td>1<tr><td>2</table>tail", "Cap\nName   Qty\napple  3\nr      1\n       2\n\ntail"),
    ("<div hidden>no</div><div style='display: none'>no</div><span style='visibility:hidden'>no<i style='visibility:visible'>yes</i></span>", "yes"),
    ("<pre>\n a\n  b\n</pre>x", " a\n  b\n\nx"),
    ("<table>stray<tr><td>in</table>", "stray\n\nin"),
    ("a < b <3 </ c> d <!-- x --> e &amp; &lt; &copy", "a < b <3 d e & < ©"),
    ("<dl><dt>T<dd>D1<dd>D2</dl>", "T\n  D1\n  D2"),
    ("<details><summary>s</summary>hid</details><script>var t='</p>'</script><style>p{}</style><noscript>n</noscript>", "s"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ("<a href='x>y'>l</a><a href=\"bro", "l"),
    ("<p title=it's>hello <b>world</b></p><p>we don't > stop</p>", "hello world\n\nwe don't > stop"),
    ("<p don't>a<i x='>' y = \">\" z=>b</i q\">c<p \"hidden>d<br/>e<p class=a\"b'c hidden>no", "abc\n\nd\ne"),
    ("<div>" * 600 + "a<div style='display:none'>no<div>no</div></div>b" + "<table><tr><td>c<td>d</table>", "a\nb\n\nc  d"),
    ("<h1>H</h1>text<hr>more", "H\n\ntext\n\n---\n\nmore"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<b><p>x</b>y", "xy"),
    ("a\u00a0 b", "a\u00a0 b"),
    ("<title>t</title><textarea>\n k &amp; l\n m</textarea>", " k & l\n m"),
    ("", ""),
    (None, ""),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<table><tr><td>a<td>b</table><table><tr><td><table><tr><td>n</table><td>c</table>", "a  b\n\nn  c"),
]


@pytest.mark.parametrize("source,text", PAGES)
def test_rendering(source, text):
    assert html_text.render(source) == text


def test_pages(spark):
    rows = [(i, f"u{i}", s, "x", 1) for i, (s, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], None, None), (None, None, "<p>n", "y", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, block int")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and sorted(r["__text"] for r in got) == sorted([t for _, t in PAGES] + [PAGES[0][1], "n"])
    assert html_text.extract(df.limit(0)).count() == 0


def test_every_visible_word_is_kept(spark):
    """Against a plain removal of tags, on generated pages without hidden parts."""
    import re

    r = random.Random(4)
    tags = ["p", "div", "b", "ul", "li", "table", "tr", "td", "h2", "span", "ol", "blockquote"]
    for _ in range(200):
        parts = [r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", f"w{r.randint(0, 999)} "]) for _ in range(40)]
        page = "".join(parts)
        seen = sorted(re.findall(r"w\d+", re.sub(r"<[^>]*>", " ", page)))
        assert sorted(re.findall(r"w\d+", html_text.render(page))) == seen


QUOTED = ["title=it's", "title='a>b'", 'title="it\'s <p>"', "data-x", "a=b\"c", 'q= "x"', "alt=''", "don't", "x = y"]


def drawn(r, deep, hidden, seen):
    """A well-formed element with odd attributes; the words that a reader sees are added to seen in their order."""
    kind = r.choice(["div", "span", "section", "b", "ul", "table", "blockquote"])
    mark, gone = r.choice([("", None)] * 5 + [("hidden", True), ("style='display:none'", True), ('style="Color:red; visibility: hidden"', 1), ("style=visibility:visible", 0)])
    attributes = [r.choice(QUOTED) for _ in range(r.randint(0, 2))] + [mark] * bool(mark)
    r.shuffle(attributes)
    if kind == "table" and gone in (0, 1):
        gone, attributes = None, [a for a in attributes if a != mark]
    off = hidden if gone is None else (2 if gone is True or hidden == 2 else gone)
    inner = {"ul": "li", "table": "tr"}.get(kind)
    out = [f"<{kind}{''.join(' ' + a for a in attributes)}>"]
    for _ in range(r.randint(1, 3)):
        out.append(f"<{inner}>" if inner else "")
        for _ in range(r.randint(1, 3)):
            if kind == "table" or deep == 0 or r.random() < 0.5:
                w = f"w{r.randint(0, 9999)}"
                seen += [] if off else [w]
                out.append(f"<td>{w}</td>" if kind == "table" else f" {w} ")
            else:
                out.append(drawn(r, deep - 1, off, seen))
        out.append(f"</{inner}>" if inner else "")
    return "".join(out) + f"</{kind}>"


def test_hidden_parts_and_odd_attributes():
    """Pages drawn together with what a reader sees of them."""
    import re

    r = random.Random(9)
    for _ in range(400):
        seen = []
        page = "".join(drawn(r, 4, 0, seen) for _ in range(3))
        assert re.findall(r"w\d+", html_text.render(page)) == seen, page


def test_query_against_another_reader(spark):
    """All words of all pages, in their order, as the standard library's parser reads them."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.skip = [], []

        def handle_starttag(self, tag, attrs):
            if tag in html_text.UNSEEN - html_text.VOID or (self.skip and tag == self.skip[0]) or (tag not in html_text.VOID and ("hidden" in dict(attrs) or "display:none" in (dict(attrs).get("style") or "").replace(" ", ""))):
                self.skip.append(tag)

        def handle_endtag(self, tag):
            if self.skip and self.skip[-1] == tag:
                self.skip.pop()

        def handle_data(self, data):
            self.words += [] if self.skip else data.split()

    sf = "/root/testdata/sf0.01"
    plain = lambda words: "".join(words).replace("-", "")  # noqa: E731  without list marks, and wherever lines are broken
    got = {x.page_id: x.text for x in html_text.op1_html_extraction(spark, sf).collect()}
    for page in spark.read.parquet(f"{sf}/pages.parquet").collect():
        reader = Reader()
        reader.feed(page.html or "")
        reader.close()
        assert sorted(plain(got[page.page_id].split())) == sorted(plain(reader.words)), page.page_id


# Chat formatting

SAID = "</s>[INST] ok [/INST]"


def test_digest_of_conversations(spark):
    rows = [(1, 0, "user", "hi <|end|> \\ <s>"), (1, 1, "assistant", "a\\b"), (1, 2, "assistant", None), (2, 0, None, None), (3, 5, "user", SAID), (3, 1, "assistant", SAID), (None, 0, "user", "n"), (2, 0, None, None), (4, None, "<|text|>", "😀é")]
    df = spark.createDataFrame([(*x, 9) for x in rows], "conv_id long, turn long, role string, text string, seq int")
    events = chat.events_of(df)
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(chat.fold_events(events))).collect()}
    assert len(got) == 5
    for c, r in got.items():
        turns = sorted(((t is not None, t or 0), ro or "", x or "") for k, t, ro, x in rows if k == c)
        text = "".join(f"{ro}\n{x}\n" for _, ro, x in turns)
        loss = "".join(x for _, ro, x in turns if ro == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha(text), len(loss), sha(loss))


def test_control_strings_never_survive(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(["<|", "|>", "\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "a", "<", "["]) for _ in range(r.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for row in df.select("*", chat.unescape(F.col("e")).alias("back")).collect():
        assert row.back == row.t
        assert not any(c in row.e for c in chat.CONTROL)


def test_events_fold(spark):
    e = [
        (1, 1, 1, "message", "user", "q"), (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "dra"), (1, 2, 4, "delta", None, "ft"),
        (1, 2, 5, "regenerate", None, None), (1, 2, 7, "delta", None, "al"), (1, 2, 6, "delta", None, "fin"), (1, 3, 8, "message", "user", "x"), (1, 3, 9, "edit", None, "y"),
        (1, 4, 10, "message", "user", "gone"), (1, 4, 11, "delete", None, None), (1, 5, 12, "delta", "assistant", "only"), (1, 1, 13, "odd", None, "?"), (1, 6, 14, None, "user", None),
    ]
    df = spark.createDataFrame(e, "conv_id long, message_id long, seq long, kind string, role string, text string")
    got = [tuple(r)[2:] for r in chat.fold_events(df).orderBy("place").collect()]
    assert got == [(1, "user", "q"), (2, "assistant", "final"), (8, "user", "y"), (12, "assistant", "only"), (14, "user", "")]
    assert chat.fold_events(df.limit(0)).count() == 0
    assert chat.format_conversations(chat.fold_events(df.limit(0))).count() == 0


# Pipeline


def test_stages_on_dirty_rows(spark, dirty_documents, empty_documents, tmp_path):
    import corpus_pipeline as cp

    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(i, 1, int(i == 1)) for i in range(12)], labels).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (dirty_documents, empty_documents):
        columns = docs.columns
        for k, (name, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(path := f"{tmp_path}/{docs is empty_documents}{k}")
            out = spark.read.parquet(path)
            if name != cp.STAGES[-1][0]:
                assert out.columns == columns and out.count() <= docs.count()
            docs = out
            if k >= 1 and k < len(cp.STAGES) - 1:
                ids = [r.doc_id for r in out.where("doc_id IS NOT NULL").collect()]
                # 0 has two texts, of which one came twice; 2 and others only repeat what 0 says
                assert (docs.count() == 0 and not ids) or (ids.count(0) == 2 and len(ids) == len(set(ids)) + 1 and not {1, 2} & set(ids))
            columns = out.columns
            if docs.count() == 0:
                empty_documents = docs


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    out = cp.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < len(out) <= docs.count() and all(r.restored for r in out)
    assert len({r.doc_id for r in out}) == len(out)


def test_the_mix_survives_many_files(spark, tmp_path):
    """Files of very different sizes, which Spark reads largest first."""
    import corpus_pipeline as cp
    from keelson.llm import mixing

    r = random.Random(12)
    rows = [(i, "word " * r.choice([1, 1, 1, 3000]) + str(i), "en", f"src{r.randint(0, 20)}", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    want = [(x.doc_id, x["__place"]) for x in mixing.mix(docs, mixing.TARGET).orderBy("__place").collect()]
    assert [p for _, p in want] == list(range(len(rows)))
    mixed = cp.interleave(spark, docs, "")
    mixed.write.option("maxRecordsPerFile", 400).parquet(path := f"{tmp_path}/mixed")
    for frame in (spark.read.parquet(path), mixed):
        out = cp.encode(spark, frame, "")
        assert [(x.doc_id, x.place) for x in out.select("doc_id", "place").collect()] == want
        out.write.parquet(again := f"{tmp_path}/{frame is mixed}")
        assert [(x.doc_id, x.place) for x in spark.read.parquet(again).orderBy("place").collect()] == want


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == ["pipeline"] + [f"op{n}" for n in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
