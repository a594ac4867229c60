"""HTML extraction, mixing and the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codesift.llm import htmlmain, mixing
from codesift.llm.htmlmain import blocks, extract, main_texts


def text_of(page):
    return main_texts([page])[0]


def test_article_without_chrome():
    page = """<!DOCTYPE html><html class="ads"><head><title>T</title><style>p{}</style></head><body>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- a <p>comment</p> --><div class="ad">buy</div>
    <main id="main"><article><header><h1>Title &amp; more</h1></header><p>One <b>two</b>
      three<br>four.<p>Unclosed &lt;tag&gt; &nbsp;here&copy;<script>var t="</p>";</script></p>
    <aside>side</aside><div class="newsletter-box">join</div><form><p>field</p></form>
    <ul><li>first</li><li>second</li></ul><div id="comments"><article><p>reader says</p></article></div></article></main>
    <footer>foot</footer></body></html>"""
    assert text_of(page) == "Title & more\nOne two three four.\nUnclosed <tag> here©\nfirst\nsecond"


def test_odd_pages():
    assert [text_of(p) for p in (None, "", "  ", "plain  text\n here", "<p>a<p>b", "<div>x</p></div></div>y", "<", "a < b", "<!-- open", "<p>&bogus; &#65;&amp")] == [
        "", "", "", "plain text here", "a\nb", "x\ny", "<", "a < b", "", "&bogus; A&",
    ]
    assert text_of("<article><p>" + "word " * 200_000 + "</article>") == ("word " * 200_000).strip()
    assert list(blocks("<script>never closed <p>x")) == []


T = "The text of the page has a good many words in it."


@pytest.mark.parametrize("page,want", [
    (f"<html><head><title>x</title><body><article><p>{T}</p></article>", T),
    (f"<html><head><meta charset=x><title>x</title><article><p>{T}</article>", T),
    (f"<head><title>x</title><style>p</style>{T}", T),
    (f'<div class="site has-sidebar"><article><p>{T}</p></article></div>', T),
    (f'<div class="site has-sidebar"><p>{T}</p></div>', T),
    (f'<div id="page" class="header-fixed"><main><p>{T}</p></main></div>', T),
    (f'<div id="page" class="header-fixed"><p>{T}</p><div class="sidebar">side</div></div>', T),
    (f'<main><div class="sidebar-left-on"><p>{T}</p><aside>a</aside></div></main>', T),
    (f"<form action=/x><input><article><p>{T}</p></article></form>", T),
    (f"<form action=/x><p>{T}</p><input></form>", T),
    (f"<article><p>{T}</p><form><p>your name</p><input></form></article>", T),
    (f'<article><p class="share-price">{T}</p><p>{T}</p></article>', f"{T}\n{T}"),
    (f'<article><p class="ad">buy<p>{T}</article>', T),
    (f'<article><p class="ad">buy <span class="promo">now<p>{T}</article>', T),
    (f'<article><ul><li class="related">other<li>{T}</ul><p>{T}</article>', f"{T}\n{T}"),
    (f'<article><table><tr><td class="ad">x<td>{T}<tr><td>{T}</table>', f"{T}\n{T}"),
    (f'<article><dl><dt class="ad">x<dd>{T}</dl>', T),
    (f"<article><p>So <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds. {T}</p></article>", f"So a=2 holds. {T}"),
    (f"<article><p>Press <button>Start</button> or <label>this</label> now. {T}</p><button>Share</button></article>", f"Press Start or this now. {T}"),
    (f'<article><p>{T}</p><div id="comments"><article><p>reader says a lot, {T} {T}</p></article></div></article>', T),
    (f'<p>{T}</p><div class="comment-list"><p>{T} {T} {T}</p></div><div class="site-footer">{T} {T}</div>', T),
    (f'<article><p>{T}</p><div class="cookie-notice">we use</div><div class="newsletter_box-2">join</div></article>', T),
    (f"<nav><p>menu<article>teaser</article></nav><main><p>{T}</main>", T),
    (f"<article><ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>{T}</article>", f"a\nb\nc\nd\n{T}"),
])
def test_main_text_is_not_lost(page, want):
    assert text_of(page) == want


def brute_repeated(words, page, run, pages):
    covered = [False] * len(words)
    at = {}
    for i in range(len(words) - run + 1):
        if page[i] == page[i + run - 1]:
            at.setdefault(tuple(words[i : i + run]), []).append(i)
    for places in at.values():
        if len({page[i] for i in places}) >= pages:
            for i in places:
                covered[i : i + run] = [True] * run
    return covered


def repeated(words, page, run, pages):
    """Which words the suffix array's runs on so many pages cover."""
    n = len(words)
    if n < run:
        return [False] * n
    order, starts, distinct, left = htmlmain.page_counts(words, page, run)
    first = order[np.repeat(distinct >= pages, np.diff(np.append(starts, n)))]
    return htmlmain.spread(first[left[first] >= run], run, n)


@pytest.mark.parametrize("run,pages", [(1, 2), (3, 2), (4, 3), (8, 2)])
def test_suffix_array_is_brute_force(run, pages):
    rng = np.random.default_rng(run)
    for _ in range(20):
        n = int(rng.integers(0, 120))
        words = rng.integers(0, 3, n).astype(np.uint64)
        page = np.sort(rng.integers(0, 5, n))
        assert list(repeated(words, page, run, pages)) == brute_repeated(words.tolist(), page.tolist(), run, pages)


def test_the_template_goes_out_of_articles(spark, monkeypatch):
    """Blocks of more than half of a host's articles go, over groups and repeated rows; quotes and copies stay."""
    own = lambda i: " ".join(f"own{i}w{k}" for k in range(30))
    notice, sign = "Join our free club for weekly recipes", "Yours " + " ".join(f"s{k}" for k in range(20))
    quote = "A line that three articles of the host quote"
    page = lambda *blocks: "<nav>Home</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    rows, want = [], {}

    def add(host, blocks, kept, times=1):
        for _ in range(times):
            want[len(rows)] = "\n".join(kept)
            rows.append((len(rows), f"https://{host}/{len(rows)}", page(*blocks)))

    for i in range(40):
        some = [quote] if i < 3 else []
        with_notice = [notice] if i % 3 else []  # 26 of 40
        add("a.example", [f"T{i}", *with_notice, own(i), *some, sign], [f"T{i}", own(i), *some], times=5 if i == 0 else 1)
    for i in range(6):  # copies with another date each: all repeats, all main text
        add("b.example", [f"Day {i} of the year", own("b"), own("c")], [f"Day {i} of the year", own("b"), own("c")])
    for i in range(6):  # half of the articles are not more than half
        add("c.example", [own(f"c{i}"), *([notice] if i % 2 else [])], [own(f"c{i}"), *([notice] if i % 2 else [])])
    for i in range(2):
        add("d.example", [own(f"d{i}"), notice], [own(f"d{i}"), notice])
    monkeypatch.setattr(htmlmain, "GROUP", 7)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.id: r.text for r in htmlmain.extract(df).collect()}
    assert got == want
    for host in "abcd":
        mine = [r for r in rows if f"//{host}." in r[1]]
        assert htmlmain.main_texts([r[2] for r in mine]) == [want[r[0]] for r in mine]


def test_repeated_runs_go_outside_articles():
    notice = "<div>All rights reserved by the host</div>"
    pages = [f"<body>{notice}<p>{w}s are told {w} by {w}</p>{notice} tail {w}</body>" for w in ("alpha", "beta", "gamma", "delta")]
    got = main_texts(pages)
    assert got[1] == "betas are told beta by beta\ntail beta"
    copies = [f"<article><p>the same article on every page of it</p></article>{notice}"] * 4
    assert main_texts(copies) == ["the same article on every page of it"] * 4


def test_extract_frames(spark, monkeypatch):
    monkeypatch.setattr(htmlmain, "GROUP", 10)
    page = "<nav>m</nav><article><p>text {}</p></article>"
    rows = [(i, f"https://User@HOT.example.com:80/{i}", page.format(i), "clash") for i in range(60)]
    rows += [(100, None, None, ""), (101, "no url", "", ""), (None, "http://b.org/", page.format("x"), ""), (1, rows[1][1], page.format(1), "again")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for most in (htmlmain.BROADCAST_HOSTS, -1):
        monkeypatch.setattr(htmlmain, "BROADCAST_HOSTS", most)
        got = sorted(((r.id, r.url, r.text) for r in extract(df).collect()), key=str)
        assert got == sorted(((i, u, re.sub(r".*<p>|</p>.*", "", h or "")) for i, u, h, _ in rows), key=str)
    assert {r.h for r in df.select(htmlmain.host(F.col("url")).alias("h")).collect()} == {"hot.example.com", "", "no url", "b.org"}
    assert extract(df.limit(0)).count() == 0


def test_runs_are_counted_over_the_whole_host(spark, monkeypatch):
    monkeypatch.setattr(htmlmain, "GROUP", 8)
    notice = "<div>This offer is void where the law of the land forbids it</div>"
    page = "<body>{}<p>{}</p></body>"
    said = [" ".join(f"w{i}x{k}" for k in range(9)) for i in range(130)]
    rows = [(i, f"http://big.org/{i}", page.format(notice if i in (3, 64, 129) else "", said[i])) for i in range(130)]
    # two pages are not enough, and a page with an article counts by what stands outside of it
    rows += [(200 + i, f"http://two.org/{i}", page.format(notice, said[i])) for i in range(2)]
    rows += [(300, "http://mix.org/a", page.format(notice, said[0])), (301, "http://mix.org/b", page.format(notice, said[1]))]
    rows += [(302, "http://mix.org/c", f"{notice}<article>{said[2]}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (htmlmain.BROADCAST_HOSTS, -1):
        monkeypatch.setattr(htmlmain, "BROADCAST_HOSTS", most)
        got = {r.id: r.text for r in extract(df).collect()}
        assert len(got) == len(rows) and all(got[i] == said[i] for i in range(130))
        assert got[200] == f"This offer is void where the law of the land forbids it\n{said[0]}"
        assert [got[i] for i in (300, 301, 302)] == said[:3]


def test_common_phrases_and_copies_stay(spark):
    said = [f"{w} waited at the end of the road and on the other hand of {w}" for w in "abcdef"]
    odd = [f"<body><p>{x}</p></body>" for x in said]
    assert main_texts(odd) == said
    copies = ["<body><p>one text on every copy</p><p>and a second paragraph of it</p></body>"] * 5
    assert main_texts(copies) == ["one text on every copy\nand a second paragraph of it"] * 5
    menu = "<ul><li>Home</li><li>News</li><li>About us</li></ul>"
    long = " ".join(f"t{k}" for k in range(20))
    pages = [f"<body>{menu}<p>{x}</p><p>{long}{end}</p></body>" for x, end in zip(said, ["", " more", "<br>more", "", "", ""])]
    assert main_texts(pages) == [said[0], f"{said[1]}\n{long} more", f"{said[2]}\n{long} more", *said[3:]]
    rows = [(i, f"http://a.org/{i}", p) for i, p in enumerate(odd)] + [(10 + i, f"http://b.org/{i}", p) for i, p in enumerate(copies)]
    got = {r.id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(said)) | {10 + i: "one text on every copy\nand a second paragraph of it" for i in range(5)}


MIX = "doc_id long, text string, source string, size string, target string"


def sizes(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]


def fill(size, weight, most=3):
    """Water-filling by clamping one source after another."""
    total, target, free = sum(size.values()), {}, set(size)
    while free:
        left, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if most * size[s] <= left * weight[s] / w]
        if not over:
            return target | {s: left * weight[s] / w for s in free}
        for s in over:
            target[s] = most * size[s]
            free.discard(s)
    return target


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["b", "a", "é", None, "Z"][int(rng.choice(5, p=[0.5, 0.02, 0.2, 0.08, 0.2]))], "c", "c") for i in range(3000)]
    rows += [(5000, None, "b", None, None), (5001, "", "empty", None, None), (5002, "x " * 40000, "b", None, None), (None, "some words", None, None, None), (7, rows[7][1], rows[7][2], "c", "c")]
    df = spark.createDataFrame(rows, MIX)
    got = mixing.mix(df, buckets=64)
    assert got.columns == [*df.columns, "__mix"]
    found = [(r.source, r["__mix"]) for r in got.collect()]
    assert sorted(m.size for _, m in found) == sorted(sizes(rows))
    per = {}
    for (_, _, s, *_), n in zip(rows, sizes(rows)):
        per[s] = per.get(s, 0) + n
    order = sorted((s for s in per if s is not None)) + [None]
    assert order == ["Z", "a", "b", "empty", "é", None]
    target = fill(per, {s: i % 3 + 1 for i, s in enumerate(order)})
    for s in per:
        mine = [m for x, m in found if x == s]
        assert all(m.source_size == per[s] and m.target == pytest.approx(target[s], rel=1e-9) for m in mine)
        assert all(m.taken == m.repeats * m.size and 0 <= m.taken <= 3 * m.size for m in mine)
        assert abs(sum(m.taken for m in mine) - target[s]) <= max(m.size for m in mine) / 2 + 1e-6
    assert sum(target.values()) == pytest.approx(sum(per.values()))
    again = mixing.mix(df.repartition(7), buckets=64)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    assert mixing.repeated(df).count() == sum(mixing.mix(df).select("__mix.repeats").toPandas()["repeats"])
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "a", "", ""), (2, " ", "b", "", "")], MIX)).count() == 2


@pytest.mark.parametrize("n", [1, 2, 5, 17])
def test_targets_are_feasible(spark, n):
    rng = np.random.default_rng(n)
    size = {f"s{i:02}": int(rng.integers(0, 1000) ** rng.integers(1, 3)) for i in range(n)}
    rows = [(s, v, float(i % 3 + 1)) for i, (s, v) in enumerate(size.items())]
    got = mixing.targets(spark.createDataFrame(rows, "key string, source_size long, weight double")).collect()
    want = fill(size, {s: i % 3 + 1 for i, s in enumerate(size)})
    assert all(r.target == pytest.approx(want[r.key], rel=1e-9, abs=1e-6) for r in got)


SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(f"{scratch}/{i}")
        docs = spark.read.parquet(f"{scratch}/{i}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] >= kept[4]
    assert kept[0] == kept[1] and len(kept[0]) < 200 and len(kept[2]) < len(kept[1])
    assert docs.where("NOT round_trip OR size(ids) <> n_tokens").count() == 0
    # Near duplicates of what line dedup left, by brute force over all pairs.
    from tests.llm.test_neardup import brute

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{scratch}/1").collect()]
    assert kept[2] == {i for i, (_, comp) in brute(rows, 5).items() if i == comp}
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_is_the_stages(spark):
    a = corpus_pipeline.run(spark, SF)
    assert a.count() > 0 and a.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]


def test_pipeline_on_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (2, "x y z", None, None, None), (2, "x y z", None, None, None)], schema)
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = spark.createDataFrame(stage(spark, rows, SF).collect(), stage(spark, rows, SF).schema)


def test_the_toxicity_stage_drops_what_op4_predicts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, 0.29), (2, 0.3), (3, 0.4), (4, 0.5)], "doc_id long, given double")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "score_documents", lambda d, _: d.withColumn("__score", F.col("given")))
    assert [r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, "").collect()] == [1]
