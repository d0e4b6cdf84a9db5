"""Main text, archives and token files."""

import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foldwise.llm import flatfiles, main_text, token_files, warc

PAGES = "page_id bigint, url string, html string"

CASES = [
    (None, ""),
    ("", ""),
    ("plain words", "plain words"),
    ("<p>One &amp; two<br>three</p>", "One & two three"),
    ("<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>Body  of\n the <b>text</b>.</p></article><footer>foot</footer>", "Title Body of the text."),
    ("<article><p>Kept</p><aside>left out</aside><p>also kept</p><div class='share buttons'>x</div></article>", "Kept also kept"),
    ("<script>var t='<p>no</p>';</script><style>p{}</style><main>yes<!-- <p>no</p> --></main>", "yes"),
    ("<article>a<form><input>Name<select><option>b</select></form>c</article>", "a c"),
    ("<body><div id=sidebar><p>side</p></div><div><p>main part</p></div><section class='comments'><p>I agree</p></section></body>", "main part"),
    ("<article><header><h1>Own head</h1></header>text</article><article class=comment>reader</article>", "Own head text"),
    ("<nav>never closed<article>still read</article>", "still read"),
    ("a &lt;b&gt; &#233; &nbsp; c", "a <b> é c"),
    ("<p>x < y and y > z</p>", "x < y and y > z"),
    ("<p>open <b>bold<p>next", "open bold next"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_main_text(page, want):
    assert main_text.main_text(page) == want


def test_surge_and_dive_without_marked_article():
    sentence = "This sentence stands for the body of a page and is long enough to matter here. "
    page = "<div><a href=1>Home</a> <a href=2>News</a></div>" + "".join(f"<p>{sentence * 3}</p>" for _ in range(4)) + "<div><a href=3>More</a></div>" * 5 + "<p>Short end</p>"
    assert main_text.main_text(page) == " ".join([(sentence * 3).strip()] * 4)


def test_dense_stretch_outside_articles():
    """Cards as articles and an empty-looking main don't throw away the body in a div."""
    body = "This sentence stands for the body of a page and is long enough to matter here. " * 3
    paragraphs, text = "".join(f"<p>{body}</p>" for _ in range(3)), " ".join([body.strip()] * 3)
    cards = "".join(f"<article><p>Card {k}</p></article>" for k in range(3))
    assert main_text.main_text(f"<div>{paragraphs}</div><nav>x</nav>{cards}") == text
    assert main_text.main_text(f"<main>.</main><div>{paragraphs}</div>") == text
    assert main_text.main_text(f"<div><p>Short words outside</p></div><article>{paragraphs}</article>") == text


def test_links_that_stay_open_and_lines_of_links():
    body = "This sentence stands for the body of a page and is long enough to matter here. " * 3
    for page in (
        f"<ul><li><a href=1>Home</li><li><a href=2>News</li></ul><div><p>{body}</p></div>",
        f"<div><a href=1>Home</div><article><p>{body}</p></article>", f"<div><p><a href=1>Home<p>{body}</div>",
        f"<div><a href=1>Home <a href=2>News</a></div><p>{body}</p>",
    ):
        assert main_text.main_text(page).endswith(body.strip())
    page = f"<article><p><a href=1>First link</a></p><p>{body}</p><ul><li><a href=2>An item</a></li></ul><p>end</p></article>"
    assert main_text.main_text(page) == f"First link {body.strip()} An item end"


def test_extract_table(spark):
    rows = [(k, None if k == 2 else f"u{k}", page) for k, (page, _) in enumerate(CASES)] + [(0, "u0", None), (None, "x", "<p>" + "long text " * 200_000)]
    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = main_text.extract(df).collect()
    assert sorted((r.page_id, r.text) for r in got if r.page_id is not None) == sorted([(k, want) for k, (_, want) in enumerate(CASES)] + [(0, "")])
    assert all(r.n_chars == len(r.text) for r in got) and max(r.n_chars for r in got) == 2_000_000 - 1
    assert main_text.extract(df.limit(0)).collect() == []


def test_url_key():
    assert warc.url_key("https://www.News.example.COM:443/a?b=1#c") == "com,example,news)/a?b=1"
    assert warc.url_key("http://user@a.b:8080") == "b,a:8080)/"
    assert warc.url_key(None) == "" and warc.url_key(" not a url ") == "not a url"


def test_archives(spark, tmp_path):
    same = "<p>" + "é" * 60 + "</p>"
    rows = [
        (5, "http://a.example.org/x", same), (3, "http://b.example.org/", same), (9, "http://a.example.org/x", same), (1, None, None), (2, "", ""),
        (4, "line\nbreak", "short"), (6, "\"quoted", "short"), (7, " space ", "x" * 100), (8, "http://A.example.org/x", "x" * 100), (None, "http://c", "y" * 300), (10, "http://c", "z" * 300_000),
    ]
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).withColumn("record", F.lit(1)).withColumn("first", F.lit(1))
    got = {r.page_id: r for r in warc.archive_and_read(df, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows)
    first = {}
    for page_id, _, html in sorted(((i, u, h) for i, u, h in rows if i is not None), key=lambda r: r[0]):
        if html and len(html.encode()) >= 100:
            first.setdefault(html, page_id)
    for page_id, url, html in rows:
        r, data = got[page_id], (html or "").encode()
        refers = first.get(html, page_id)
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if refers == page_id else ("revisit", refers))
    files = list(Path(tmp_path / "w/archives").glob("part-*"))
    content = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert content.count(b"WARC/1.1\r\n") == len(rows) and b"Z" * 10 not in content
    assert warc.archive_and_read(df.limit(0), str(tmp_path / "empty")).collect() == []


def test_index_over_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(k, "http://hot.example.org/" if k % 3 == 0 else f"http://h{k % 7}.example.org/{k}", f"page {k} " * 30) for k in range(200)]
    pages = spark.createDataFrame(rows, PAGES)
    warc.write_archives(pages, str(tmp_path / "a"))
    warc.build_index(spark, str(tmp_path / "a"), str(tmp_path / "i"))
    wanted = spark.createDataFrame([("http://hot.example.org/",), ("http://h1.example.org/1",), ("http://none/",)], "url string")
    found = warc.lookup(spark, str(tmp_path / "i"), wanted)
    assert sorted(r.page_id for r in found.collect()) == sorted([1] + [k for k in range(200) if k % 3 == 0])
    records = {r.page_id: r.payload.decode() for r in warc.read_records(found, with_payload=True).collect()}
    assert all(records[k] == f"page {k} " * 30 for k in records)


@pytest.mark.parametrize("page", ["<a " + '"' * 100_001, "<a " * 100_000, "<a '" * 50_001 + ">", "<title>" * 50_000, "<i class=ad>" * 30_000, "<!" * 100_000, "<a \"'" * 40_000 + "x"])
def test_broken_markup_takes_linear_time(page):
    import time

    start = time.perf_counter()
    main_text.main_text(f"<p>first {page}")
    assert time.perf_counter() - start < 5


def test_text_between_dense_stretches_stays():
    body = "This sentence stands for the body of a page and is long enough to matter here. " * 3
    links = "<div><a href=3>More</a></div>" * 4
    page = f"<p>{body}</p>{links}<p>Short part</p>{links}<p>{body}</p>{links}<p>Short end</p>"
    assert main_text.main_text(page) == f"{body.strip()} Short part {body.strip()}"


def test_kept_stretches_against_brute_force():
    """Windows summed one by one choose the same lines."""
    import random

    rng = random.Random(5)
    for _ in range(300):
        sizes = [rng.choice((0, 0, 0, 5, 30, 60, 200)) for _ in range(rng.randrange(1, 14))]
        page = "".join(f"<p>{'w' * n}</p>" if n else "<p><a href=1>link</a></p>" for n in sizes)
        sums = [sum(sizes[k : k + main_text.WIDTH]) for k in range(len(sizes))]
        enough = min(main_text.DENSE, max(sums))
        runs, at = [], 0
        while at < len(sizes):
            stop = at
            while stop < len(sizes) and sums[stop] > 0:
                stop += 1
            if stop > at:
                runs.append((max(sums[at:stop]), at, stop))
            at = max(stop, at + 1)
        good = [k for k, run in enumerate(runs) if run[0] >= enough]
        want = [sizes[k] for run in (runs[good[0] : good[-1] + 1] if good else []) for k in range(run[1], run[2]) if sizes[k]]
        assert main_text.main_text(page) == " ".join("w" * n for n in want)


def test_token_scan(spark, tmp_path):
    documents = [[1, 2, 3], [], [4], [7] * 25, [], [], list(range(10, 31)), [50_000, 0x5050]]
    stream = b"".join(b"".join(t.to_bytes(2, "little") for t in d) + (50256).to_bytes(2, "little") for d in documents)
    (tmp_path / "a.bin").write_bytes(stream)
    (tmp_path / "b.bin").write_bytes(stream + b"\x01\x00\x02\x00")
    (tmp_path / "c.bin").write_bytes(b"")
    (tmp_path / "d.bin").write_bytes(b"\x05\x00" * 23)
    for block in (1, 2, 3, 7, 1000):
        got = token_files.scan_token_files(spark, str(tmp_path), block_tokens=block).collect()
        by = lambda name: [(r.n_tokens) for r in sorted((r for r in got if r.path.endswith(name)), key=lambda r: r.document)]
        assert by("a.bin") == [len(d) for d in documents] and by("b.bin") == [len(d) for d in documents] + [2]
        assert by("c.bin") == [] and by("d.bin") == [23]
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="multiple of the token width"):
        token_files.scan_token_files(spark, str(tmp_path)).collect()


def test_count_tokens(spark, tmp_path):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_files.RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=token_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "Hello there", "é 漢字 🙂\n\n x", "<|endoftext|>", "word " * 100_000, "Hello there"]
    df = spark.createDataFrame(list(enumerate(texts[:-1])) + [(2, texts[-1]), (None, "no id")], "doc_id bigint, text string").withColumn("part", F.lit("clash")).repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in token_files.count_tokens(df, str(tmp_path / "t")).collect())
    count = lambda t: len(encoding.encode_ordinary(t or ""))
    assert got == sorted([(k, count(t)) for k, t in enumerate(texts[:-1])] + [(2, count(texts[2])), (-1, count("no id"))])
    assert token_files.count_tokens(df.limit(0), str(tmp_path / "e")).collect() == []


@pytest.mark.parametrize("arrange", ["repartition", "order", "join", "lost attempt"])
def test_each_document_gets_its_own_count(spark, tmp_path, arrange):
    """Documents of k words, dealt in ways that may give another row order each time they are evaluated."""
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(' word', CAST(id % 97 AS int)) AS text", "'x' AS file")
    if arrange == "repartition":
        docs = docs.repartition(3)
    elif arrange == "order":
        docs = docs.orderBy(F.rand())
    elif arrange == "join":
        docs = docs.join(spark.range(300).withColumnRenamed("id", "doc_id").repartition(5), "doc_id")
    else:
        (tmp_path / "t" / "files").mkdir(parents=True)
        (tmp_path / "t" / "files" / "lost.tokens").write_bytes(b"\x01\x00" * 9)
    got = token_files.count_tokens(docs, str(tmp_path / "t")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(k, k % 97) for k in range(300)]


def test_flat_files_hold_the_bytes(spark, tmp_path):
    data = [bytes(range(256)), b"", b"\n\r\n", b"\xff\xfe"]
    flatfiles.write_bytes(spark.createDataFrame([(d,) for d in data], "value binary").coalesce(1), "value", b"\x00\xc4\n", str(tmp_path / "x"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "x").glob("part-*"))) == b"".join(d + b"\x00\xc4\n" for d in data)
