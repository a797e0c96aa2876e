"""The training-data operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest

from comparing import assert_same
from hustings.llm import html_extraction, jaccard, language_model, line_dedup, media, mixing, packing, quality, queries, secrets, sharding

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))


def awkward(spark):
    """Null, empty, blank, long, repeated and tied rows."""
    texts = [None, "", " \t\n\x0b\x0c\r ", LONG, "one two three", "one two three", "É É\né É\n\nABC", "abc\nabc\nABC \n abc", "a" * 50_000, " x y"]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[4], (None, "no id", None, "s1", None)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crowded(df):
    """With columns whose names the operators use themselves."""
    names = ["__row", "__more", "__salt", "__arc", "__owner", "__part", "__text", "__k0", "__n", "__base", "__class", "caller__row", "n_lines", "n_dropped", "base", "owned", "kept", "failed", "n_words", "size", "target", "copies", "media", "codec", "keyframes", "shard", "slot", "rank", "id", "g", "n", "_row", "text2"]
    return df.select("*", *[F.lit(7).alias(n) for n in names])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), queries.SQL[name], SMALL)


OPERATORS = {
    "secrets": secrets.scan_secrets,
    "quality": quality.apply_rules,
    "measures": lambda d: quality.apply_rules(d, measures=True),
    "store": media.store_texts,
    "lines": line_dedup.dedup_lines,
    "pack": packing.pack_documents,
    "mix": lambda d: mixing.mix_sources(d, mixing.n_words(F.col("text"))),
    "lm": lambda d: language_model.score_documents(d, F.col("doc_id") % 3 == 2),
    "shard": lambda d: sharding.shard_rows(d, "doc_id"),
    "jaccard": jaccard.jaccard_components,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows(spark, name):
    n = OPERATORS[name](awkward(spark)).count()
    assert n == 13 if name != "pack" else n > 13


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, name):
    assert OPERATORS[name](empty(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names(spark, name):
    plain = OPERATORS[name](awkward(spark))
    more = OPERATORS[name](crowded(awkward(spark)))
    made = [c for c in plain.columns if c not in ("text", "slot", "shard", "sequence_id", "offset")]
    key = lambda r: str([None if isinstance(v, float) and math.isnan(v) else v for v in r])
    assert sorted(map(key, more.select(*made).collect())) == sorted(map(key, plain.select(*made).collect()))


# 1


def brute_secrets(text):
    found = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans(spark):
    hexa, key = "0123456789abcdef01234567", "AKIA" + "Z9" * 9
    texts = [
        f'é\U0001f600 Password = "hunter22" {key} {hexa}',
        "token=short token:abc secret=token=abcdef",
        f"{hexa}{hexa} x{hexa}g AKIAAKIA{'A' * 20}",
        "api_key : 'abc/def+12=' apikey=a.b.c.d passwd=......",
        "nothing here",
        "token=token:abcdefg",
    ]
    df = spark.createDataFrame([(i, t, f"s{i}", "en") for i, t in enumerate(texts)], "doc_id int, text string, source string, lang string")
    got = {r.doc_id: sorted((s.start, s.kind, s.end) for s in r.base) for r in secrets.scan_secrets(df).collect()}
    assert got == {i: brute_secrets(t) for i, t in enumerate(texts)}


def test_a_value_in_many_repositories_of_one_owner_is_an_example(spark):
    value = "Kj4" * 8
    for n, live in ((2, 1), (3, 0)):
        df = spark.createDataFrame([(i, f"see {value}", "one owner", f"l{i % n}") for i in range(6)], "doc_id int, text string, source string, lang string")
        out = secrets.scan_secrets(df).collect()
        assert {(r.n_live, r.n_example, len(r.owned), r.most_owners, r.most_repositories) for r in out} == {(live, 1 - live, live, 1, n)}


def test_many_matches_in_one_text(spark):
    rng = random.Random(4)
    words = [rng.choice(["x", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "token=abcdef12", "é"]) for _ in range(3000)]
    text = " ".join(words)
    got = secrets.scan_secrets(spark.createDataFrame([(1, text, "s", "en")], "doc_id int, text string, source string, lang string")).first()
    assert sorted((s.start, s.kind, s.end) for s in got.base) == brute_secrets(text)


def test_widely_copied_values_are_examples(spark):
    shared, own = "Zx9" * 8, "Qw7" * 8
    rows = [(i, f"see {shared} and {own if i == 0 else 'none'}", f"s{i}", "en") for i in range(3)]
    out = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id int, text string, source string, lang string")).collect()}
    assert [(s.start, s.end) for s in out[0].owned] == [(4 + 24 + 5, 4 + 24 + 5 + 24)] and not out[1].owned
    assert (out[0].n_live, out[0].n_example, out[1].n_example) == (1, 1, 1)


# 2


def brute_repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    times = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({j for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_repeated_words():
    rng = random.Random(1)
    for _ in range(200):
        text = " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))
        assert quality.Text(text).n_repeat_words == brute_repeats(text)


def test_rule_order_never_changes_the_verdict(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    verdicts = [sorted((r.doc_id, r.kept) for r in quality.apply_rules(docs, rules).collect()) for rules in (quality.RULES, quality.RULES[::-1], quality.order_rules(docs))]
    assert verdicts[0] == verdicts[1] == verdicts[2]


def test_rules_are_ordered_by_rejections_for_their_cost(spark):
    """A slow rule that rejects little comes last, a quick one that rejects much comes first; only so many texts are looked at."""
    import time

    slow = quality.Rule("slow", lambda t: time.sleep(0.002) or False)
    quick = quality.Rule("quick", lambda t: t.n_words < 50)
    docs = spark.range(2000).select(F.concat_ws(" ", F.lit("a b"), "id").alias("text")).repartition(6)
    assert [r.name for r in quality.order_rules(docs, (slow, quick), sample=100)] == ["quick", "slow"]
    assert quality.order_rules(docs.filter("false"), (slow, quick)) == (slow, quick)


def test_measures_are_lazy():
    t = quality.Text("a b")
    assert quality.RULES[0].fails(t) and set(t._known) == {"words"}


# 3


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 40 + 3])
def test_container_round_trip(size):
    payload = media.padded("x" * size)
    data = media.write_media(payload)
    index = media.read_index(data)
    assert b"".join(data[a:b] for a, b in index["samples"]) == payload
    assert index["codec"] == "raw" and index["duration"] == len(payload) // 576
    assert [k[0] for k in index["keyframes"]] == list(range(1, len(payload) // 576 + 1, 12))
    assert all(payload[(k - 1) * 576 : k * 576] == data[a:b] for k, a, b in index["keyframes"])


def test_tracks_are_read_from_their_own_boxes():
    """A track without samples before one that has them; sizes that differ; 64-bit offsets; no sync table."""
    payload = bytes(range(30))

    def movie(first):
        table = [
            media._full(b"stsd", (1).to_bytes(4, "big"), media._box(b"mp4v", bytes(8))),
            media._full(b"stts", b"".join(x.to_bytes(4, "big") for x in (2, 2, 10, 1, 5))),
            media._full(b"stsc", b"".join(x.to_bytes(4, "big") for x in (2, 1, 2, 1, 2, 1, 1))),
            media._full(b"stsz", b"".join(x.to_bytes(4, "big") for x in (0, 3, 7, 11, 12))),
            media._full(b"co64", (2).to_bytes(4, "big"), *[(first + x).to_bytes(8, "big") for x in (0, 18)]),
        ]
        head = lambda scale: media._full(b"mdhd", b"".join(x.to_bytes(4, "big") for x in (0, 0, scale, 25)))
        good = media._box(b"trak", media._box(b"mdia", head(50), media._box(b"minf", media._box(b"stbl", *table))))
        bad = media._box(b"trak", media._box(b"mdia", head(7), media._box(b"minf", media._box(b"stbl", table[0]))))
        return media._box(b"moov", bad, good)

    data = media._box(b"mdat", payload) + movie(8)
    index = media.read_index(data)
    assert (index["codec"], index["timescale"], index["duration"]) == ("mp4v", 50, 25)
    assert [data[a:b] for a, b in index["samples"]] == [payload[:7], payload[7:18], payload[18:30]]
    assert [k[0] for k in index["keyframes"]] == [1, 2, 3]


def test_movie_fragments():
    """Tables without samples, then two fragments: sizes of their own with offsets, and sizes by default that follow the run before."""
    word = lambda *x: b"".join(v.to_bytes(4, "big") for v in x)
    full = lambda kind, *x, flags=0: media._full(kind, *x, flags=flags)
    table = media._box(b"stbl", full(b"stsd", word(1), media._box(b"avc1", bytes(8))), full(b"stts", word(0)), full(b"stsc", word(0)), full(b"stsz", word(0, 0)), full(b"stco", word(0)))
    track = media._box(b"trak", full(b"tkhd", word(0, 0, 5)), media._box(b"mdia", full(b"mdhd", word(0, 0, 90, 0)), media._box(b"minf", table)))
    data = media._box(b"moov", track, media._box(b"mvex", full(b"trex", word(5, 1, 30, 4, 0x10000))))
    first = len(data)

    def fragment(offset):
        run = full(b"trun", word(3, offset, 0), word(7, 2, 9), flags=0x205)
        other = media._box(b"traf", full(b"tfhd", word(6)), full(b"trun", word(1, 0), flags=0x1))
        return media._box(b"moof", other, media._box(b"traf", full(b"tfhd", word(5), flags=0x20000), run, full(b"trun", word(2))))

    body = bytes(range(26))
    data += fragment(len(fragment(0)) + 8) + media._box(b"mdat", body)
    index = media.read_index(data)
    assert (index["codec"], index["timescale"], index["duration"]) == ("avc1", 90, 150)
    assert [data[a:b] for a, b in index["samples"]] == [body[:7], body[7:9], body[9:18], body[18:22], body[22:26]]
    assert [k[0] for k in index["keyframes"]] == [1]
    for cut in range(first, len(data), 7):
        media.read_index(data[:cut])
    huge = data.replace(word(2) + media._box(b"mdat", body)[:8], b"\xff\xff\xff\xff" + media._box(b"mdat", body)[:8])
    assert huge != data and media.read_index(huge)["samples"] == []


def test_counts_beyond_the_box_cost_nothing():
    whole = media.write_media(media.padded("x" * 3000))
    for kind in (b"stsz", b"stts", b"stss", b"stsc", b"stco"):
        at = whole.index(kind) + 8 + (4 if kind == b"stsz" else 0)
        broken = whole[:at] + b"\xff\xff\xff\xff" + whole[at + 4 :]
        assert media.read_index(broken)["samples"] == []
    deep = b""
    for _ in range(5000):
        deep = media._box(b"moov", deep)
    assert media.read_index(deep)["samples"] == []


def test_broken_containers():
    data = media.write_media(media.padded("x" * 3000))
    for cut in range(0, len(data), 37):
        media.read_index(data[:cut])
    assert media.read_index(b"")["samples"] == [] and media.read_index(b"\0\0\0\1mdat")["samples"] == []


def test_media_query_reads_back(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op3_media_columns"](spark, SMALL).collect():
        payload = media.padded(texts[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


# 4


def test_page_text_against_plain_reading(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    import html

    for r in queries.QUERIES["op4_html_extraction"](spark, SMALL).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_what_is_left_out():
    page = "<header>top</header><div class='side bar'>no</div><article><h1>T</h1><p>One <i>two</i><p>3 &amp; 4&nbsp;5<form><p>f</form><div id=comments><p>c</div><aside>a</aside><script>var t='<p>x</p>'</script></article><footer>f</footer>"
    for wrapper in (None, html_extraction.infer_wrapper([page])):
        assert html_extraction.main_text(page, wrapper) == ("T\nOne two\n3 & 4 5", False)
    assert html_extraction.main_text("<div class='no-sidebar x'><p>kept</div><div class='x-sidebar'>gone</div>")[0] == "kept"


def test_wrapper_aligns_optionals_and_repeats():
    rows = ["<body><ul><li>a</li></ul><h1>x</h1></body>", "<body><ul><li>a</li><li>b</li><li>c</li></ul><p>more</p><h1>y</h1></body>"]
    out = html_extraction.Wrapper()
    for row in rows:
        out.add(html_extraction.Page(row))
    assert out.written() == "body(ul(li(#)+) p(#)? h1(#))"


def test_wrapper_finds_the_varying_part():
    pages = [f"<body><div class=top>Site name</div><div class=content><h2>A {i}</h2><p>text {'abc' * i} text</p><p>Same on all</p></div><div class=bottom>All rights</div></body>" for i in range(1, 5)]
    assert html_extraction.main_text(pages[0], html_extraction.infer_wrapper(pages)) == ("A 1\ntext abc text\nSame on all", True)


def test_wrapper_tells_neighbours_of_one_symbol_apart():
    """The second div is the content: only its place in the expression says so."""
    pages = [f"<body><div><b>Site</b></div><div><p>story {i} {'word ' * 30 * i}</p></div><hr><div>Imprint</div></body>" for i in range(1, 6)]
    text, by = html_extraction.main_text(pages[2], html_extraction.infer_wrapper(pages))
    assert by and text == " ".join(f"story 3 {'word ' * 90}".split())


def test_two_templates_on_one_host(spark):
    """A rare form of page among many: it has its own place in the expression, since all pages are read."""
    often = [f"<body><nav>menu</nav><article><p>story {i}</p></article><div>foot</div></body>" for i in range(300)]
    rare = [f"<body><div class=wrap><div>crumbs {i}</div><main><p>page {i}</p></main></div></body>" for i in range(3)]
    none = [f"<body><div class=t>Shop</div><div class=c><h1>Item {i}</h1><p>{'long ' * i} tale</p></div><div class=f>Imprint</div></body>" for i in range(4)]
    rows = [(i, "http://h/x", p) for i, p in enumerate(often + rare + none)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    for parts in (1, 7):
        out = {r.page_id: r for r in html_extraction.extract_text(df.repartition(parts)).collect()}
        assert {i for i, r in out.items() if r.by_wrapper} == {303, 304, 305, 306}
        assert [out[i].text for i in (0, 299, 300, 302)] == ["story 0", "story 299", "page 0", "page 2"]
        assert [out[303 + i].text for i in range(4)] == [f"Item {i}\n{'long ' * i}tale" for i in range(4)]
    # the same by host instead of broadcast
    limit, html_extraction.BROADCAST_BYTES = html_extraction.BROADCAST_BYTES, 0
    try:
        assert {r.page_id: r.text for r in html_extraction.extract_text(df).collect()} == {i: r.text for i, r in out.items()}
    finally:
        html_extraction.BROADCAST_BYTES = limit


def test_constants_only_go_where_the_template_has_them():
    """Without any element that has most of the text, the template's own texts go at their places; the same words elsewhere stay."""
    pages = [f"<b>Logo</b><p>{'x' * i} one</p><h2>Logo</h2><i>two {i}</i><em>Contact</em>" for i in range(1, 5)]
    wrapper = html_extraction.infer_wrapper(pages)
    assert html_extraction.main_text(pages[0], wrapper)[0] == "x one\ntwo 1"
    other = "<b>Logo</b><p>Contact Logo</p><h2>Logo</h2><i>two</i><em>Contact</em>"
    assert html_extraction.main_text(other, wrapper)[0] == "Contact Logo\ntwo"
    assert html_extraction.main_text(pages[0], html_extraction.infer_wrapper(pages[:2]))[0] == "Logo\nx one\nLogo\ntwo 1Contact"


def test_depth_does_not_decide():
    for depth in (3, 57, 58, 119, 120, 400):
        pages = [f"<body><div>Site banner</div>{'<div>' * depth}<article><p>story {k}</p><div class=ad>buy</div></article>{'</div>' * depth}<div>Imprint</div>" for k in range(6)]
        assert html_extraction.main_text(pages[0], html_extraction.infer_wrapper(pages)) == ("story 0", False)


@pytest.mark.parametrize("name", ["skip-list", "menu-recipes", "ad-hoc-analysis", "social-history", "notice", "related-work", "header-file", "masthead-history", "side"])
def test_articles_in_elements_with_doubtful_words(name):
    pages = [f'<nav>menu</nav><article><h1>T {k}</h1><div class="{name}"><p>body text number {k} goes on here and on</p><p>and more</p></div><div class="ad">buy {k} now</div></article>' for k in range(6)]
    for wrapper in (None, html_extraction.infer_wrapper(pages)):
        assert html_extraction.main_text(pages[0], wrapper)[0] == "T 0\nbody text number 0 goes on here and on\nand more"
    only = f'<article><div class="{name}"><p>all of it</p></div></article>'
    assert html_extraction.main_text(only, html_extraction.infer_wrapper([only] * 6))[0] == "all of it"


def test_the_wrapper_knows_what_a_page_alone_does_not():
    """A box with the template's own text in articles; a short story beside a long advert; a teaser that is an article; pages without articles."""
    boxed = [f"<article><h1>T {k}</h1><p>body {k}</p><div class=boxy>Subscribe to our letter</div></article>" for k in range(6)]
    assert html_extraction.main_text(boxed[0])[0] == "T 0\nbody 0\nSubscribe to our letter"
    assert html_extraction.main_text(boxed[0], html_extraction.infer_wrapper(boxed)) == ("T 0\nbody 0", True)
    for few in (boxed[:4], [*boxed, "<article><h1>T</h1><p>body</p></article>"]):
        assert html_extraction.main_text(boxed[0], html_extraction.infer_wrapper(few)) == ("T 0\nbody 0\nSubscribe to our letter", False)
    short = [f"<article><p>{'words of the story ' * (40 if k else 1)}{k}</p><div class=promo>{'buy this now ' * 20}{k}</div></article>" for k in range(6)]
    assert "buy" in html_extraction.main_text(short[0])[0]
    assert html_extraction.main_text(short[0], html_extraction.infer_wrapper(short)) == ("words of the story 0", True)
    teaser = "<article><p>story</p></article><div class=related><article>teaser</article></div>"
    assert html_extraction.main_text(teaser, html_extraction.infer_wrapper([teaser])) == ("story", False)
    copies = ["<article><h1>Same</h1><div>all pages are copies</div></article>"] * 8
    assert html_extraction.main_text(copies[0], html_extraction.infer_wrapper(copies)) == ("Same\nall pages are copies", False)


def test_stray_tags_cost_no_search():
    import time

    began = time.perf_counter()
    html_extraction.Page("<span>" * 100_000 + "</b>" * 100_000)
    html_extraction.Page("<p><table>" + "<h1>" * 50_000)
    assert time.perf_counter() - began < 20


def test_wide_and_deep_pages_take_bounded_time():
    import time

    began = time.perf_counter()
    wide = ["<body>" + "".join(f"<div class=c{(i * k) % 9973}><p>t{i}</p></div>" for i in range(20_000)) + f"<article>story {k}</article></body>" for k in (1, 2)]
    wrapper = html_extraction.infer_wrapper([*wide, "<body>" + "<div><i>" * 3000 + "deep", "<article>" * 500 + "x"])
    assert [html_extraction.main_text(p, wrapper)[0] for p in wide] == ["story 1", "story 2"]
    assert time.perf_counter() - began < 40
    again = html_extraction.Wrapper.unpacked(wrapper.packed())
    assert again.packed() == wrapper.packed() and len(wrapper.packed()) < 100_000


def test_text_outside_of_elements(spark):
    pages = {
        "Intro text <b>bold</b> and more text<p>para</p> tail": "Intro text bold and more text\npara\ntail",
        "plain text, 1 < 2 &amp; no tags": "plain text, 1 < 2 & no tags",
        "<html><body><p>in</p></body></html> after": "in\nafter",
        "<p>one</p></body></html><p>two</p>three": "one\ntwo\nthree",
        "lead <nav>menu</nav><script>x</script><p>body</p>": "lead\nbody",
    }
    assert {p: html_extraction.main_text(p)[0] for p in pages} == pages
    rows = [(i, f"http://h{i}/", p) for i, p in enumerate(pages)]
    out = html_extraction.extract_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    assert {r.html: r.text for r in out} == pages
    assert html_extraction.main_text("before <article><p>x</p></article> after")[0] == "x"


def test_pages_with_clashing_names(spark):
    rows = [(i, f"http://h{i % 2}/", f"<p>menu</p><article>story {i}</article>") for i in range(6)]
    plain = spark.createDataFrame(rows, "page_id int, url string, html string")
    names = ["host", "root", "constants", "__host", "__wrapper", "__n", "__part", "part", "wrapper", "by_wrapper", "text"]
    out = html_extraction.extract_text(plain.select("*", *[F.lit(n).alias(n) for n in names]))
    assert {*names, "page_id", "url", "html"} == set(out.columns)
    assert sorted((r.page_id, r.text, r.host, r["__host"]) for r in out.collect()) == [(i, f"story {i}", "host", "__host") for i in range(6)]


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (3, "http://h/b", "<p>plain <b>text"), (3, "http://h/b", "<p>plain <b>text"), (4, "not a url", "<<<>>>&&"), (5, "http://g/", "<body>" + "<div>" * 3000 + "deep")]
    out = html_extraction.extract_text(spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("text", F.lit("old"))).collect()
    assert len(out) == 6 and {r.text for r in out if r.page_id == 3} == {"plain text"} and {r.text for r in out if r.page_id in (1, 2)} == {""}
    assert html_extraction.extract_text(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


# 5


def test_dropped_lines(spark):
    rows = [(i, f"Shared Line \nown {i}\n\n  shared line\nÉcole") for i in range(10)] + [(10, "École\nécole\nx")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert (out[3].text, out[3].n_lines, out[3].n_dropped) == ("own 3\n", 5, 3)
    assert (out[10].text, out[10].n_dropped) == ("école\nx", 1)


# 6


def test_pieces_and_places(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_best_fit_packing"](spark, SMALL).toPandas()
    for doc, g in rows.sort_values("piece").groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[doc], add_special_tokens=False).ids + [0], dtype="<u4")
        assert g["length"].sum() == len(ids) and (g["length"].iloc[1:] == 2048).all() and g["length"].max() <= 2048
        assert g["piece"].tolist() == list(range(len(g))) and g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        assert g["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g["start"], g["length"], strict=True)]
    for _, g in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 2048) + 1


def test_ids_of_texts_with_an_added_token(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"one {end} two", f"{end}first", f"last {end}", f"{end}{end}", f"a{end}{end}b  {end}  c\n\n", f"near <|endoftext| > {end[:-1]}", f"x {end} " * 900, "none"]
    assert tokenizer.encode(texts[0]).ids == [505, 220, 50256, 734]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for doc, g in packing.pack_documents(docs).toPandas().sort_values("piece").groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[doc], add_special_tokens=False).ids + [0], dtype="<u4")
        assert g["length"].sum() == len(ids)
        assert g["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g["start"], g["length"], strict=True)]


def test_ids_of_very_long_white_space(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "x" + " \t\n\r" * 300_000, "é <|endoftext|>" + "\u3000 " * 500_000 + "end", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    for doc, g in packing.pack_documents(docs).toPandas().sort_values("piece").groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[doc], add_special_tokens=False).ids + [0], dtype="<u4")
        assert g["length"].sum() == len(ids)
        assert g["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g["start"], g["length"], strict=True)]


def test_fullest_combination():
    rng = random.Random(3)
    for _ in range(100):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))]
        counts, room = collections.Counter(items), rng.randrange(1, 80)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= room}
        taken = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(k * n for k, n in taken.items()) == max(sums) and all(n <= counts[k] for k, n in taken.items())


def test_plan_covers_every_piece():
    counts = {2048: 5, 1000: 7, 900: 3, 48: 11, 1: 30}
    used = collections.Counter()
    for length, first, per, _, _ in packing.plan_bins(counts).tolist():
        assert first == used[length] or first > used[length] - per
        used[length] = max(used[length], first)
    assert {r[0] for r in packing.plan_bins(counts).tolist()} == set(counts) and packing.plan_bins({}).shape == (0, 5)


# 7


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_targets(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{i}": rng.choice([0, 5, 1000, 70]) + i for i in range(n)} | {None: 50}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.source_targets(df, "source").collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mix_is_near_its_targets_and_agrees_with_itself(spark):
    a, b = (queries.QUERIES["op7_mixing_sources"](spark, "/root/testdata/sf0.01").toPandas() for _ in range(2))
    assert a.sort_values("doc_id").reset_index(drop=True).equals(b.sort_values("doc_id").reset_index(drop=True))
    assert (a["taken"] <= 2 * a["size"]).all() and (a["taken"] >= 0).all()
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").toPandas()
    for _, g in a.merge(source, on="doc_id").groupby("source"):
        # a text more or less from each class of sizes: the larger the source, the nearer
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= max(0.03 * g["target"].iloc[0], 2 * g["size"].max()) and g["size"].sum() == g["source_size"].iloc[0]


def test_copies_against_plain_systematic_sampling(spark):
    """Copies are the integers that each row's part of the running sum crosses, in the order and from the offset of the source."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(200)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, words bigint")
    out = mixing.mix_sources(df, F.col("words")).collect()
    h = {r.doc_id: (r.h, r.salt, r.offset, r.kind) for r in df.select("doc_id", F.floor(F.log2(F.col("words") + 1) * 4).alias("kind"), F.xxhash64(F.lit(7), "doc_id").alias("h"), F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(64)).alias("salt"), (F.pmod(F.xxhash64(F.lit(7), "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("offset")).collect()}
    for source in ("a", "b", None):
        mine = sorted((r for r in out if r.source == source), key=lambda r: (h[r.doc_id][3], h[r.doc_id][1], h[r.doc_id][0], r.doc_id))
        rate, upto = min(mine[0].target / mine[0].source_size, 2.0), 0
        for n, r in enumerate(mine, 1):
            now = math.floor(n * rate + h[r.doc_id][2])
            assert r.copies == now - upto and 0 <= r.copies <= 2
            upto = now


# 8


def test_scores(spark):
    rows = queries.QUERIES["op8_lm_scoring"](spark, SMALL).toPandas().set_index("doc_id")
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b"\n"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    c = collections.Counter(w for d, ws in texts.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in texts.items():
        r = rows.loc[d]
        assert (bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    out = rows[rows["held_out"]]
    assert out["score"].sum() > out["base_score"].sum()


def plain_model(docs, held, weights_of):
    """Deleted interpolation in plain Python: (counts of words, counts of pairs, log10 probability of each text)."""
    texts = {d: (t or "").encode().lower().split() + [b"\n"] for d, t in docs}
    one, two = collections.Counter(), collections.Counter()
    for d, ws in texts.items():
        if not held(d):
            one.update(ws)
            two.update(zip([b"\n", *ws], ws, strict=False))
    n, v = sum(one.values()), len(one)
    bucket = lambda u: one[u].bit_length() - 1  # noqa: E731  -1 for a count of 0
    weights = weights_of(one, two, n, v, bucket)

    def p(u, w):
        b = bucket(u)
        near = min((k for k in weights if k >= max(b, 0)), default=None)
        x = weights[near] if near is not None else (0.0, 0.5, 0.5)
        if b < 0:
            x = (0.0, x[1] / (x[1] + x[2]), x[2] / (x[1] + x[2]))
        return x[0] * two[u, w] / max(one[u], 1) + x[1] * one[w] / max(n, 1) + x[2] / (v + 1)

    return {d: sum(math.log10(p(u, w)) for u, w in zip([b"\n", *ws], ws, strict=False)) for d, ws in texts.items()}


def exact_weights(one, two, n, v, bucket):
    """Expectation-maximisation on the deleted estimates themselves, 40 rounds."""
    out = {}
    for b in {bucket(u) for u, _ in two}:
        seen = [((k - 1) / (one[u] - 1) if one[u] > 1 else 0.0, (one[w] - 1) / max(n - 1, 1), 1 / (v + 1), k) for (u, w), k in two.items() if bucket(u) == b]
        x, total = [1 / 3] * 3, sum(k for *_, k in seen)
        for _ in range(40):
            gain = [0.0] * 3
            for *e, k in seen:
                whole = sum(a * c for a, c in zip(x, e, strict=True))
                gain = [g + k * a * c / whole for g, a, c in zip(gain, x, e, strict=True)]
            x = [(g + 0.5) / (total + 1.5) for g in gain]
        out[b] = x
    return out


def cell_weights(one, two, n, v, bucket):
    """The operator's own learning, on cells made from the plain counts."""
    import pandas as pd

    rows = np.array([(one[u], one[w], k, k) for (u, w), k in two.items()], dtype=np.int64).reshape(-1, 4)
    return language_model.learn_weights(pd.DataFrame(dict(zip(("code", "n", "second", "first"), language_model.cells_of(*rows.T, n, v), strict=True))))


def varied(n=150):
    """Texts with words of very different frequency, so that there are many classes of contexts, some unseen."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[min(int(rng.paretovariate(0.6)), 399)] for _ in range(rng.randrange(90)))) for i in range(n)]
    return [*docs, (n, None), (n + 1, ""), (n + 2, "never seen before"), (n + 5, docs[3][1])]


@pytest.mark.parametrize(("chunk", "shard"), [(1_000_000, 1_000_000), (64, 20), (1000, 300)])
def test_scores_against_a_plain_model(spark, chunk, shard):
    docs, held = varied(), (lambda d: d % 7 == 2)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in language_model.score_documents(df, F.col("doc_id") % 7 == 2, chunk_tokens=chunk, shard_tokens=shard).collect()}
    want = plain_model(docs, held, cell_weights)
    assert {d: got[d].score for d in want} == pytest.approx(want, rel=1e-9) and len(got) == len(docs)
    assert {d: got[d].n_tokens for d in want} == {d: len((t or "").split()) + 1 for d, t in docs}


def test_weights_from_cells_are_near_exact_ones(spark):
    docs, held = varied(), (lambda d: d % 7 == 2)
    near, exact = (plain_model(docs, held, f) for f in (cell_weights, exact_weights))
    assert near == pytest.approx(exact, rel=1e-3)


def test_runs_of_requests_stay_in_proportion(spark):
    """Four times the texts make four times the rows of requests, not sixteen times, once chunks and shards grow."""
    rows = []
    for times in (1, 4):
        df = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k * k) % 5000}" for k in range(100))) for i in range(300 * times)], "doc_id bigint, text string").coalesce(1)
        size = df.agg(F.sum(F.octet_length("text"))).first()[0]
        least = math.isqrt(language_model.RUN * size // 6)
        table = language_model.materialize(language_model.chunks(df, "doc_id", "text", F.lit(False), least))
        rows.append(language_model.exchange_counts(table, -(-30_300 * times // least)).count())
    assert rows[1] < 5 * rows[0] and rows[1] <= 2.2 * 30_300 * 4 / language_model.RUN


def test_weights_find_the_better_estimate():
    import pandas as pd

    code = lambda b, x, y: (b + 1) << 40 | (x + 20_000) << 20 | (y + 20_000)
    weights = language_model.learn_weights(pd.DataFrame({"code": [code(3, 40, 4), code(5, 4, 40)], "n": [1000, 1000], "second": [10_000, 1000], "first": [1000, 10_000]}))
    assert weights[3][0] > 0.9 and weights[5][1] > 0.9


# 9


def test_shards(spark):
    rows = queries.QUERIES["op9_sharding"](spark, "/root/testdata/sf0.01").toPandas()
    counts = rows["shard"].value_counts()
    assert set(counts.index) == set(range(40)) and counts.max() - counts.min() <= 1
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_little_moves_when_a_shard_is_added(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before, after = (sharding.shard_rows(df, "doc_id", n).toPandas().set_index("doc_id")["shard"] for n in (40, 41))
    assert (before != after.reindex(before.index)).mean() < 0.06  # 1 / 41 is the least


def brute_shards(keys, hashes, shards, nodes):
    """Bounded loads by walking: keys of each arc in order, each to its own node or on clockwise to the next shard with room."""
    points, owners = sharding.ring(shards, nodes)
    total, room, arcs = len(keys), [], collections.defaultdict(list)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    for k in keys:
        arcs[int(np.searchsorted(points, hashes[k])) % len(points)].append(k)
    counts, over = collections.Counter(), []
    for arc in sorted(arcs):
        owner = int(owners[arc])
        taken = min(len(arcs[arc]), room[owner] - counts[owner])
        counts[owner] += taken
        over += [arc] * (len(arcs[arc]) - taken)
    for at in over:
        while counts[int(owners[at % len(owners)])] >= room[int(owners[at % len(owners)])]:
            at += 1
        counts[int(owners[at % len(owners)])] += 1
    # how many keys of each arc its own shard keeps
    return counts, {arc: len(arcs[arc]) for arc in arcs}


def test_shards_against_a_walk(spark):
    df = spark.range(700).withColumnRenamed("id", "doc_id")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    out = {r.doc_id: r.shard for r in sharding.shard_rows(df, "doc_id", 7, 5).collect()}
    counts, arcs = brute_shards(sorted(hashes), hashes, 7, 5)
    assert collections.Counter(out.values()) == counts
    points, owners = sharding.ring(7, 5)
    moved = sum(out[k] != owners[np.searchsorted(points, hashes[k]) % 35] for k in out)
    load = collections.Counter()
    for arc, n in arcs.items():
        load[int(owners[arc])] += n
    assert moved == sum(max(0, n - 100) for n in load.values())  # only what is over the bound leaves its own shard


def test_overflow_goes_on_clockwise():
    plan = sharding.plan_arcs(np.array([10, 0, 2]), np.array([0, 1, 2]), 3)
    assert plan.tolist() == [[0, 0, 0, 0], [0, 4, 1, 0], [0, 8, 2, 2], [2, 0, 2, 0]]


# 10


def brute_components(docs, width, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_slices_are_bounded_and_whole():
    import pyarrow as pa

    from hustings.llm.common import slices

    texts = [None, "", "a" * 10, "b" * 300, "c" * 99, "d", None, "e" * 5, ""] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "t"])
    parts = list(slices([batch, batch.slice(0, 0)], 1, 100))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()) < 400 for p in parts) and len(parts) > 7


def near_family(rng, words, length, copies, most):
    """A text and copies with up to ``most`` words changed."""
    base = [rng.choice(words) for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(1, most + 1)):
            text[rng.randrange(length)] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(text))
    return out


def test_copies_of_one_text_group_around_it(spark):
    """The text itself is among the leaders, so near copies link with it and do not meet each other by their tokens: rows stay near-linear."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts = near_family(rng, words, 150, 600, 4)
    rng.shuffle(texts)
    docs = [(i, t) for i, t in enumerate(texts)]
    met = []
    verified = jaccard._verified
    jaccard._verified = lambda pairs, *a: met.append(pairs.count()) or verified(pairs, *a)
    try:
        got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    finally:
        jaccard._verified = verified
    assert got == brute_components(docs, 4, 85)
    assert sum(met) < 12 * len(docs)


def test_documents_of_common_passages_hardly_meet(spark, monkeypatch):
    """Texts put together from few passages share first tokens, however rare; their bits tell that they are too far apart. Near copies are found."""
    rng = random.Random(23)
    passages = [" ".join(f"p{i}x{rng.randrange(10**6)}" for _ in range(rng.randrange(25, 36))) for i in range(30)]
    met, plain = [], jaccard.meeting_groups
    monkeypatch.setattr(jaccard, "meeting_groups", lambda *a: met.append(plain(*a)) or met[-1])
    for many in (200, 400):
        texts = [" ".join(rng.sample(passages, 8)) for _ in range(many)]
        for i in range(0, many, 20):
            cut = texts[i].split()
            cut[rng.randrange(len(cut))] = "other"
            texts.append(" ".join(reversed(cut)) if i % 40 else " ".join(cut))
        docs = list(enumerate(texts))
        met.clear()
        got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
        assert got == brute_components(docs, 4, 85)
        assert sum(x.count() for x in met) < many


def test_hot_tokens_meet_in_parts(spark):
    """A token with more rows than the limit is dealt to several tasks; pairs are the same."""
    rng = random.Random(5)
    rows = [(i, rng.randrange(20, 40), None if i % 4 else i % 3, rng.randrange(6), t, *[rng.getrandbits(20) for _ in jaccard.BITS]) for i in range(60) for t in (1, 1 + i % 7)]
    tokens = spark.createDataFrame(rows, "id bigint, n bigint, g bigint, i int, token bigint, " + ", ".join(f"{b} bigint" for b in jaccard.BITS))
    plain = {tuple(r) for r in jaccard.meeting_groups(tokens, 50).collect()}
    assert plain and {tuple(r) for r in jaccard.meeting_groups(tokens, 50, 7).collect()} == plain


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_components_against_brute_force(spark, width, percent):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(400)]
    docs, base = [], [rng.choice(words) for _ in range(120)]
    for i in range(120):
        text = list(base) if i % 2 else [rng.choice(words) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4) if text else 0):
            text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((i, " ".join(w.upper() if i % 3 == 0 else w for w in text)))
    docs += [(200, None), (201, ""), (202, "one two"), (203, "ONE  two"), (204, "one"), (205, docs[1][1]), (206, docs[1][1] + " " + docs[1][1])]
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string"), width=width, percent=percent).collect()}
    assert got == brute_components(docs, width, percent)


def test_stage_keeps_rows_that_ids_do_not_tell_apart(spark):
    def words(k, n=40):
        return " ".join(f"w{k}x{i}" for i in range(n))

    near = words(1)[: -len(" w1x39")]
    rows = [(None, words(1)), (None, words(2)), (None, words(2)), (7, words(3)), (7, words(4)), (7, words(4)), (8, near), (9, words(3)), (None, ""), (None, " "), (5, ""), (5, ""), (5, " "), (6, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    want = [(None, words(2)), (7, words(3)), (7, words(4)), (8, near), (None, ""), (None, " "), (5, ""), (5, " "), (6, None)]
    order = lambda found: sorted(found, key=repr)
    for parts in (1, 5):
        out = jaccard.jaccard_stage(spark, docs.repartition(parts), SMALL)
        assert out.columns == docs.columns and order((r.doc_id, r.text) for r in out.collect()) == order(want)
    plain = docs.filter("doc_id >= 8 OR doc_id = 6")
    assert {r.doc_id for r in jaccard.jaccard_stage(spark, plain, SMALL).collect()} == {6, 8, 9}
    assert jaccard.jaccard_stage(spark, empty(spark), SMALL).count() == 0


# values on awkward rows


def texts_of(rows):
    return collections.Counter((r.doc_id, r.text) for r in rows)


def test_values_of_awkward_rows(spark):
    """Null ids, sources and texts, repeated rows and a long text: every row is there once, and what it gets is what a plain reading gives."""
    docs = awkward(spark)
    rows = docs.collect()
    words = lambda t: len((t or "").encode().split())

    placed = sharding.shard_rows(docs, "doc_id", shards=5).collect()
    assert texts_of(placed) == texts_of(rows)
    by = collections.defaultdict(list)
    for r in placed:
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(5)) and max(map(len, by.values())) - len(rows) // 5 <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())

    mixed = mixing.mix_sources(docs, mixing.n_words(F.col("text"))).collect()
    assert texts_of(mixed) == texts_of(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += words(r.text)
    for r in mixed:
        assert (r.size, r.source_size) == (words(r.text), sizes[r.source]) and 0 <= r.copies <= 2 and r.target <= 2 * r.source_size + 1e-9
    assert abs(sum({r.source: r.target for r in mixed}.values()) - min(1.5, 2) * sum(sizes.values())) < 1e-6

    pieces = packing.pack_documents(docs).collect()
    per_text = collections.defaultdict(list)
    for p in pieces:
        per_text[p.doc_id].append(p.length)
    assert [sorted(per_text[i]) for i in (0, 1)] == [[1], [1]] and len(per_text[4]) == 3 and set(per_text[4]) == {4}
    bins = collections.defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
    for content in bins.values():
        ends = 0
        for offset, length in sorted(content):
            assert offset == ends
            ends += length
        assert ends <= 2048

    scored = language_model.score_documents(docs, F.col("doc_id") % 3 == 2).collect()
    want = collections.Counter((r.doc_id, words(r.text) + 1, bool(r.doc_id is not None and r.doc_id % 3 == 2)) for r in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, bool(r.held_out)) for r in scored) == want
    assert {r.train_tokens for r in scored} == {sum(words(r.text) + 1 for r in rows if r.doc_id is None or r.doc_id % 3 != 2)}
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)

    stored = media.store_texts(docs).collect()
    assert texts_of(stored) == texts_of(rows)
    for r in stored:
        data = bytes(r.media)
        assert b"".join(data[a:b] for a, b in media.read_index(data)["samples"]) == media.padded(r.text)


def test_doubtful_parts_are_held_against_the_text_of_all_pages():
    plain = [f"<body><article><h1>T</h1><p>{'word ' * 3}number {i}</p></article></body>" for i in range(20)]
    with_advert = f"<body><article><p>short</p><div class='ad'>{'buy ' * 15}</div></article></body>"
    for pages in ([*plain, with_advert], [with_advert, *plain]):
        wrapper = html_extraction.infer_wrapper(pages)
        assert html_extraction.main_text(with_advert, wrapper)[0] == "short"
    # what is added up before it is merged is all there
    several = [p.replace("<h1>", "<b>x</b>" * (i % 3) + "<h1>") for i, p in enumerate(plain)]
    out = html_extraction.Wrapper()
    for p in several:
        out.add(html_extraction.Page(p))
    out.settle()
    assert out.pages[True] == 20 and out.of[True].size == sum(html_extraction.Page(p).chars for p in several)
