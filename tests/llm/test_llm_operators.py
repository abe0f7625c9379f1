"""Each training-data operator against a plain version of itself, with nulls, empty tables, repeats and odd columns."""

import hashlib
import html as html_lib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from textloom.llm import decontaminate, html_extraction, jaccard_join, line_dedup, quality_classifier, quality_rules, sentencepiece_codec, token_store, toxicity, url_filters
from textloom.llm.common import arrow_pass, components, labelled_sample, portions, shared_dir

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and house tree river stone cloud paper water light green blue walk speak under over after before".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s0"])[i % len(sources or ["s0"])], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def odd_texts():
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(6)]
    near = [b.replace("house", "home", 1) for b in base]
    return [None, "", " \n\t", "one", "one two", *base, *near, base[0], base[0], prose(rng, 4000), "é漢😀 naïve\x0bx\x85y  z", "a\n\n b"]


# ---- 1


def brute_classes(texts, width, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            up[y] = x
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("width,percent,hot", [(3, 90, 64), (5, 80, 64), (2, 70, 2), (2, 60, 1)])
def test_jaccard_classes(spark, width, percent, hot):
    rng = random.Random(1)
    base = [[rng.choice(WORDS) for _ in range(50)] for _ in range(4)]
    texts = odd_texts()
    for _ in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(50)] = rng.choice(WORDS)
        texts.append(" ".join(w))
    got = jaccard_join.jaccard_classes(documents(spark, texts), width, percent, hot=hot).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(texts, width, percent)


def test_jaccard_odd_rows(spark):
    empty = spark.createDataFrame([], DOC)
    assert jaccard_join.jaccard_classes(empty).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, None), (9, "A B c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as gid", "3 as n", "4 as tok", "5 as a")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(df, 3, 90).collect())
    assert got == [(-1, 4, 7), (3, 0, 3), (7, 4, 7), (7, 4, 7), (9, 4, 7)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long"), []).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_shingles_of_many_texts():
    rng = random.Random(29)
    texts = [*odd_texts(), *odd_strings(7, 300, 25), "x" * 700, "x" * 256 + "y" + "z" * 255, "x" * 512 + "y", " " * 5, "\x0b\x0c", "A\x85b\u2003c d"]
    for width in (1, 2, 3, 5):
        sets = list(jaccard_join.shingle_sets(pa.array(texts, pa.string()), width))
        names, of = {}, []
        for t, s in zip(texts, sets, strict=True):
            w = (t or "").encode().lower().split()
            plain = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
            assert len(s) == len(plain) and (np.diff(s) > 0).all()
            of.append(plain)
            for x in plain:
                names.setdefault(x, len(names))
        assert len({int(x) for s in sets for x in s}) == len(names)
        for i, j in itertools.islice(itertools.combinations(range(len(texts)), 2), 0, None, 37):
            assert len(np.intersect1d(sets[i], sets[j])) == len(of[i] & of[j])
        assert all(np.array_equal(jaccard_join.shingles(t, width), s) for t, s in zip(texts[:40], sets, strict=False))


def test_wide_signatures_bound_the_difference():
    rng = random.Random(31)
    for _ in range(300):
        a = {rng.getrandbits(64) for _ in range(rng.randint(1, 900))}
        b = {x for x in a if rng.random() < 0.8} | {rng.getrandbits(64) for _ in range(rng.randint(0, 300))}
        one, two = (jaccard_join.wide_signature(np.sort(np.array(list(x), "u8"))) for x in (a, b or a))
        assert jaccard_join.differing(one, two) == jaccard_join.differing(two, one) <= len(a ^ (b or a))
    far = [jaccard_join.wide_signature(np.sort(np.array([rng.getrandbits(64) for _ in range(4000)], "u8"))) for _ in range(2)]
    assert jaccard_join.differing(*far) > 1500


def test_sets_that_share_a_name_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "set_hash", narrow_hash)
    rng = random.Random(33)
    texts = [prose(rng, 30) for _ in range(40)]
    texts += [t + " more" for t in texts[:20]] + texts[:10]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(documents(spark, texts).repartition(3), 2, 80).collect()}
    assert got == brute_classes(texts, 2, 80)


def narrow_hash(s):
    import xxhash

    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h % 8, h >> 2


def test_jaccard_with_repeated_ids_and_clashing_columns(spark):
    rng = random.Random(35)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = [(2, a), (2, b), (1, a), (5, a + " x"), (5, b), (None, a), (None, None), (7, None), (7, ""), (2, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as n", "3 as tok", "4 as comp", "5 as hash")
    got = sorted(((r["doc_id"], r["component_id"], r["stays"]) for r in jaccard_join.jaccard_classes(df).collect()), key=str)
    assert got == sorted([(2, 1, False), (2, 2, True), (1, 1, True), (5, 1, False), (5, 2, False), (None, 1, False), (None, None, True), (7, 7, True), (7, 7, True), (2, 2, True)], key=str)
    assert jaccard_join.jaccard_classes(df.limit(0)).count() == 0


def test_held_tables_are_deleted(spark, tmp_path):
    import os

    before = set(os.listdir(shared_path(spark)))
    docs = documents(spark, odd_texts())
    jaccard_join.jaccard_classes(docs).count()
    assert len(set(os.listdir(shared_path(spark))) - before) == 1


def shared_path(spark):
    return shared_dir(spark).removeprefix("file:").replace("///", "/")


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(700)] + [(1000, 1001), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(edges, []).collect()}
    assert got == {**dict.fromkeys(range(701), 0), 1000: 1000, 1001: 1000}


# ---- 2


def odd_strings(seed, n, length):
    rng = random.Random(seed)
    parts = ["a", "th", " ", "  ", "     ", "é", "漢", "\n", "😀", "ing", ".", "12", "The", "\t", "ß", "…", "日本語", "%%%", "\x00", "\ue000"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, length))) for _ in range(n)]


def test_sentencepiece_gives_the_librarys_ids():
    import sentencepiece

    c = sentencepiece_codec.Codec(sentencepiece_codec.default_model(), cache=700, pairs=300)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdeghinorstuvwyéü,.") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = [*odd_strings(2, 2000, 30), " ".join(made), " ", "  ", "x" * 5000, "", None]
    for some in (texts[:1500], texts[1500:], texts[:5]):
        assert [i.tolist() for i in c.encode_many(some)] == sp.encode([t or "" for t in some])
    assert len(c.cache) <= 3000 and not any(len(w) > c.LONG for w in c.cache)
    for t in [*odd_strings(4, 50, 30), "▁a▁▁ b", "▁", "a▁"]:
        assert c.decode(c.encode(t).tolist()) == t


def plain_viterbi(c, s):
    best = [(0.0, [])]
    for e in range(1, len(s) + 1):
        top = None
        for k in range(e, 0, -1):
            if s[e - k : e] in c.score:
                score, i = c.score[s[e - k : e]]
                v = best[e - k][0] + score
                if top is None or v > top[0]:
                    top = (v, best[e - k][1] + [i])
        if s[e - 1] not in c.score:
            v = best[e - 1][0] + c.unknown
            if top is None or v > top[0]:
                top = (v, best[e - 1][1] + c._fallback(s[e - 1]))
        best.append(top)
    return best[-1][1]


def test_scores_of_a_unigram_model_against_a_plain_search():
    c = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    assert c.merges
    rng = random.Random(2)
    c.merges, c.unknown = False, -40.0
    c.score = {p: (-rng.random() * 12 - 1 / len(p), i) for p, (_, i) in c.score.items()}
    for t in odd_strings(5, 60, 30):
        if t:
            words = sentencepiece_codec.CHUNK.findall("▁" + t.replace(" ", "▁"))
            assert c.encode(t).tolist() == [i for w in words for i in plain_viterbi(c, w)]
            assert c.decode(c.encode(t).tolist()) == t


def test_portions_bound_rows_and_bytes():
    b = pa.RecordBatch.from_pydict({"i": list(range(7)), "t": ["x" * 10, None, "y" * 25, "z", "", "w" * 8, "v" * 30]})
    parts = list(portions(iter([b, b.slice(0, 0)]), 1, rows=3, size=20))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5], [6], []]


def test_sentencepiece_decodes_like_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    for t in odd_texts():
        if t:
            assert sp.decode(sentencepiece_codec.codec().encode(t).tolist()) == t


def test_sentencepiece_frames(spark):
    docs = documents(spark, odd_texts()).selectExpr("*", "1 as ids", "true as round_trip")
    enc = sentencepiece_codec.encode(docs)
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(enc).collect()}
    assert back == {i: t or "" for i, t in enumerate(odd_texts())}
    assert all(r["round_trip"] for r in sentencepiece_codec.digests(docs).collect())
    assert sentencepiece_codec.digests(docs.limit(0)).count() == 0


# ---- 3


def test_url_filters(spark):
    urls = ["http://a.net/", "https://A.B.net/x?y", "http://net", "http://x.example.net/en/1", "http://example.net/en", "http://www.example.com/de/a", "http://www.example.com/fr/a", "http://x.org/fr/", "http://x.org/de/", "http://m.free-bets.example.com/en/27#top", "http://notnet/", None, "", "no url", "http://", "x://h?://net/", "HTTP://UPPER.NET/P", "http://a.org/fr/wp-login.php", "http://a.org/wp-login.php"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as host", "2 as rule")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filters.url_filters(pages).collect()}

    def plain(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
            host = host.lower()
        fits = [r for r in url_filters.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        if fits:
            best = max(fits, key=lambda r: len(r.text))
            return host, path, best.text, best.action
        return host, path, None, "block" if any(re.search(p.pattern, (url or "").lower()) for p in url_filters.PATTERN_RULES) else "allow"

    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert url_filters.url_filters(pages.limit(0)).count() == 0


def test_every_pattern_holds_its_literals():
    index = url_filters.Index((), url_filters.PATTERN_RULES, {})
    for url in ("http://m.free-bets.com/", "http://www.cheap-pills.x/", "http://best-casino.x/", "http://a/wp-login.php", "http://a/?affiliate_id=3"):
        run = {i for i, p in enumerate(url_filters.PATTERN_RULES) if re.search(p.pattern, url)}
        assert run and run <= set(index.candidates(url))


# ---- 4

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a>M</a></li><li><a>N</a></li></ul></nav>
<div class="ad">buy</div><article><h1>{0}</h1><p><b>First &amp; best<br>line<p>{1}&nbsp;x</p>{2}<div class="user-comments"><p>me too</p></div><form><p>send</p></form></article>
<aside>side</aside><footer>&copy; f</footer></body></html>"""


def test_html_extraction(spark):
    html = [PAGE.format(f"T{i}", "word " * i, "<ul><li>a<li>b</ul>" if i % 2 else "") for i in range(6)] + [None, "", "plain text only", "<p>x", PAGE.format("t", "u", "")]
    urls = ["http://a.x/1"] * 5 + ["http://b.x/"] * 5 + [None]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as path")
    got = {r["page_id"]: r["text"] for r in html_extraction.html_extraction(pages).collect()}
    for i in range(6):
        end = ["a", "b"] if i % 2 else []
        assert got[i].split("\n") == [f"T{i}", "First & best line", " ".join(["word"] * i + ["x"]), *end]
    assert (got[6], got[7], got[8], got[9]) == ("", "", "plain text only", "x")
    assert got[10].startswith("t\nFirst & best line\nu x")
    assert html_extraction.html_extraction(pages.limit(0)).count() == 0


def brute_text(page):
    """All blocks of a page, by regular expressions, without the parts of class related and the like."""
    page = re.sub(r"<div class='related'>.*?</div>", "", page)
    parts = re.split(r"</?(?:div|p|h1|h2|ul|li|section)\b[^>]*>", page)
    out = [" ".join(html_lib.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts]
    return "\n".join(x for x in out if x)


def test_html_without_article_keeps_all_main_text(spark):
    rng = random.Random(13)
    menu = "<nav><a>Home</a></nav><ul><li><a>Menu</a></li><li><a>Map</a></li></ul>"
    bodies = [
        lambda i: f"<div class='post-intro'><p>{prose(rng, 35)}</p></div><div class='post-body'><p>{prose(rng, 65)}</p></div>",
        lambda i: f"<h1>Title {i}</h1><div class='text'><p>{prose(rng, 200)}</p></div>",
        lambda i: f"<h1><a>Linked {i}</a></h1><p>lead {i}</p><div><div class='content'><p>{prose(rng, 200)}</p><p>b</p></div></div>",
        lambda i: f"<div class='main'><p>{prose(rng, 90)}</p></div><p>end {i}</p>",
        lambda i: f"<div class='{rng.choice(['a', 'b'])}'><p>{prose(rng, 50)}</p><div class='related'>no</div></div>" * rng.randint(1, 3),
    ]
    rows, want = [], []
    for h, body in enumerate(bodies):
        for i in range(6):
            main = f"<div id='wrap'>{body(i)}</div>"
            rows.append((len(rows), f"http://h{h}.x/{i}", f"<html><head><title>t</title></head><body>{menu}{main}<footer>f</footer></body></html>"))
            want.append(brute_text(main))
    for i in range(4):
        a, b = prose(rng, 40), prose(rng, 20)
        rows.append((len(rows), f"http://two.x/{i}", f"<body><div>tag line</div><article class='lead'><p>{a}</p></article><div><article class='more'><p>{b}</p></article></div></body>"))
        want.append(f"{a}\n{b}")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.html_extraction(pages).collect()}
    assert [got[i] for i in range(len(rows))] == want


def merged(*htmls):
    w = None
    for x in htmls:
        k = html_extraction.shape(html_extraction.parse(x))
        if w is None:
            w = k
        else:
            html_extraction.merge_into(w, k)
    return w


def test_wrappers_are_union_free_expressions():
    a = merged("<body><ul><li>x</li><li>y</li></ul><p>Same</p><i>t1</i></body>", "<body><ul><li>z</li></ul><h2>new</h2><p>Same</p><i>t2</i></body>")
    fixed = html_extraction.shape(html_extraction.parse("<p>Same</p>")).kids[0].kids[0].fixed
    assert html_extraction.expression(a) == f"<body><ul>(<li>#text</li>)+</ul>(<h2>{text_hash('new')}</h2>)?<p>#{fixed:x}</p>#text</body>"
    # what stands in another order is one repeated group
    b = merged("<b1>x</b1><b2>y</b2><b3>z</b3>", "<b2>x</b2><b1>y</b1><b3>w</b3>")
    assert html_extraction.expression(b) == "((<b1>#text</b1>)*(<b2>#text</b2>)?)+<b3>#text</b3>"
    assert html_extraction.expression(html_extraction.load(html_extraction.dump(b))) == html_extraction.expression(b)


def text_hash(s):
    return f"#{html_extraction.shape(html_extraction.parse(s)).kids[0].fixed:x}"


def brute_generalises(w, page):
    """Whether the wrapper's expression, as a regular expression of Python, matches the page's own stream of tags."""
    expression = re.sub(r"#[0-9a-z]+", "", html_extraction.expression(w))
    own = re.sub(r"#[0-9a-z]+|[()+*?]", "", html_extraction.expression(flat(page)))
    pattern = re.sub(r"[<>/.]", lambda m: "\\" + m[0], expression)
    return re.fullmatch(pattern, own) is not None


def flat(page):
    """The page's stream as a node tree without folding."""
    fold, html_extraction.fold = html_extraction.fold, lambda kids, todo: kids
    try:
        return html_extraction.shape(html_extraction.parse(page))
    finally:
        html_extraction.fold = fold


def test_a_wrapper_matches_every_page_it_comes_from():
    rng = random.Random(21)
    for _ in range(150):
        pages = ["<body>" + "".join(f"<{t}>" + "".join(f"<{u}>x{rng.random()}</{u}>" for u in rng.choices(["u1", "u2", "u3"], k=rng.randint(0, 3))) + f"</{t}>" for t in rng.choices(["d1", "d2", "d3", "d4"], k=rng.randint(0, 6))) + "</body>" for _ in range(rng.randint(1, 5))]
        w = merged(*pages)
        for page in pages:
            assert brute_generalises(w, page), (html_extraction.expression(w), page)


TEMPLATES = {
    # of each: how a page of the host is made of its title, its paragraphs and other texts
    "article": lambda t, ps, x: f"<nav><a href='/'>Home</a> <a>{x[0]}</a></nav><div class=ad>{x[1]}</div><article><h1>{t}</h1>{ps}</article><footer>{x[2]}</footer>",
    "widget": lambda t, ps, x: f"<div id=top><a>Home</a></div><div class='widget-content'><h1>{t}</h1>{ps}</div><div class='sidebar'><p>{x[0]}</p></div>",
    "header": lambda t, ps, x: f"<header><a>Site</a></header><article><div class='post-header'><h1>{t}</h1></div>{ps}<p class='search-related'>{x[3]}</p></article><footer>{x[1]}</footer>",
    "notice": lambda t, ps, x: f"<div class=c9><p>We use small files on this site.</p></div><div class=txt><h1>{t}</h1>{ps}<div class=box>Read our terms</div></div><ul class=zz><li><a>{x[0]}</a><li><a>{x[1]}</a></ul>",
    "comments": lambda t, ps, x: f"<div class=page><h2>{t}</h2><div>{ps}</div><div class='user-comments'><p>{x[0]}</p><p>{x[1]}</p></div></div><form><p>{x[2]}</p></form>",
    "names": lambda t, ps, x: f"<main><h1>{t}</h1>{ps}<p class='notice'>{x[0]}</p><section id='reader-comments'><article><p>{x[1]}</p></article></section><ol class=commentlist><li>{x[2]}</ol></main><div role=complementary>{x[3]}</div>",
    "plain": lambda t, ps, x: f"<table><tr><td><a>{x[0]}</a></td><td><h1>{t}</h1>{ps}</td></tr></table><aside>{x[1]}</aside>",
}
KEEPS_RELATED = {"header"}


@pytest.mark.parametrize("name", TEMPLATES)
def test_html_against_the_templates_own_texts(name):
    rng = random.Random(name)
    made = []
    for i in range(12):
        title, ps, x = f"Title {i} {prose(rng, 3)}", [f"{prose(rng, rng.randint(20, 60))} &lt;{i}&gt;" for _ in range(rng.randint(1, 5))], [prose(rng, rng.randint(2, 6)) for _ in range(4)]
        want = [title, *(html_lib.unescape(p) for p in ps), *([x[3]] if name in KEEPS_RELATED else [])]
        body = TEMPLATES[name](title, "".join(f"<p>{p}</p>" if k % 2 else f"<p>{p}" for k, p in enumerate(ps)), x)
        made.append((f"<!DOCTYPE html><html><head><title>{title}</title><script>var a='<p>';</script></head><body>{body}</body></html>", want))
    plan = html_extraction.Plan.of(html_extraction.decisions(merged(*(h for h, _ in made))))
    for h, want in made:
        assert html_extraction.extract(h, plan).split("\n") == want


def test_hostile_pages_take_linear_time():
    deep = "<div>" * 10_000 + "text" + "</div>" * 10_000
    assert html_extraction.extract(deep) == "text"
    w = merged(deep, deep.replace("text", "other"), "<div>x</div>")
    assert html_extraction.expression(html_extraction.load(html_extraction.dump(w))) == html_extraction.expression(w)
    assert html_extraction.extract(deep, html_extraction.Plan.of(html_extraction.decisions(w))) == "text"
    wide = "".join(f"<div class='{prose(random.Random(i), 1)}'><p>t{i}</p></div>" for i in range(5000))
    began = time.time()
    for page in ('<a "' * 300_000, '<a ="' * 200_000, "<a b='" * 200_000 + ">", "<span>" * 50_000 + "</b>" * 50_000, "<" * 500_000, "<!--" * 200_000, "<script>" * 100_000, "<li>" * 100_000 + "x", wide, "<p>" * 100_000 + "</p>" * 100_000):
        html_extraction.extract(page)
    assert time.time() - began < 30
    assert html_extraction.extract(wide).split("\n") == [f"t{i}" for i in range(5000)]


def test_html_copies_of_one_page_are_no_template(spark):
    page = "<body><ul><li><a>m</a></ul><div><p>All the same words here</p></div></body>"
    pages = spark.createDataFrame([(i, "http://a.x/1", page) for i in range(40)], "page_id long, url string, html string").repartition(7)
    assert {r["text"] for r in html_extraction.html_extraction(pages).collect()} == {"All the same words here"}


# ---- 5


def plain_lines(rows, sites):
    trim = lambda x: x.strip(" \t\r\x0b\x0c")
    seen = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            seen.setdefault(trim(x), set()).add(s)
    out = {}
    for i, t, _ in rows:
        if t is None:
            out[i] = (None, 0, 0)
            continue
        full = [x for x in t.split("\n") if trim(x)]
        stay = [x for x in t.split("\n") if not (trim(x) and len(seen[trim(x)]) >= sites)]
        n = len([x for x in stay if trim(x)])
        out[i] = (t, len(full), 0) if n in (0, len(full)) else ("\n".join(stay), len(full), len(full) - n)
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    frame = [f"frame {k}" for k in range(8)]
    rows = [(i, "\n".join([f"own {i}", *rng.sample(frame, 3), "", f" twice {i // 2}\t"]), f"site{i % 14}") for i in range(60)]
    rows += [(100 + i, "frame 0", f"site{i}") for i in range(14)] + [(200, None, "site1"), (201, "", None), (202, " \n\n", "x"), (203, "frame 0\nowner", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as line", "2 as n_lines", "3 as site", "4 as raw")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(df).collect()}
    assert got == plain_lines(rows, 10)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_keeps_clashing_columns(spark):
    rows = [(i, f"own {i}\nframe", f"s{i}") for i in range(12)] + [(3, "frame\nother text of an id that repeats", "s3"), (None, "frame\nx", None), (50, "\n".join(["frame"] + [f"line {k}" for k in range(30_000)]), "s1"), (51, "frame\n" + "w" * 2_000_000, "s2")]
    names = ["_n", "_key", "_bad", "_m", "_stays", "row", "key", "bad", "line", "n", "m", "stays", "raw", "sketch", "a.b"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *(f"'mine' as `{c}`" for c in names))
    out = line_dedup.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == len(rows) and all(r[c] == "mine" for r in got for c in names)
    want = {(i, t.removeprefix("frame\n").removesuffix("\nframe")) for i, t, _ in rows}
    assert {(r["doc_id"], r["text"]) for r in got} == want and all(r["n_removed"] == 1 for r in got)


# ---- 6


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    win = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, w in enumerate(win) if win.count(w) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_counts():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "#", "x\x1fy ", "\x85", "é "]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    for t in [*texts, None, "", "a b c d e a b c d e a b c d e"]:
        assert quality_rules.counts(t) == plain_counts(t)


def test_quality_rules(spark):
    rng = random.Random(6)
    syllables = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    good = [" ".join(rng.choice(syllables) for _ in range(n)) + "." for n in (30, 200, 3000)]
    noise = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(100))
    texts = [None, "", "few words", *good, "spam " * 400, "one two three four five six seven eight nine ten " * 50, noise]
    docs = documents(spark, texts).selectExpr("*", "1 as kept", "2 as n_words")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert [got[i]["kept"] for i in range(len(texts))] == [False, False, False, True, True, True, False, False, False]
    assert not got[8]["base_failed"]
    assert sorted(r["doc_id"] for r in quality_rules.keep_good(docs).collect()) == [3, 4, 5]
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def long_prose(seed, consonants, vowels, size):
    """Clean prose of so many bytes: words by Zipf's law in sentences."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(consonants) + rng.choice(vowels) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    drawn, out, at = rng.choices(words, [1 / (i + 2.7) for i in range(3000)], k=size // 3), [], 0
    while at < len(drawn):
        n = rng.randint(6, 16)
        out.append(" ".join(drawn[at : at + n]).capitalize() + ".")
        at += n
    return " ".join(out).encode()[:size].decode(errors="ignore")


@pytest.mark.parametrize("lang,consonants,vowels", [("en", "bcdfghlmnprstw", "aeiou"), ("de", "bdfghklmnrstwz", "aeiouäöü"), ("fr", "bcdlmnprstv", "aeiouéèê"), ("es", "bcdfghjlmnprstvz", "aeiouáéó")])
def test_long_clean_texts_stay(lang, consonants, vowels):
    bands, zc = quality_rules.Bands(), zstandard.ZstdCompressor(level=3)
    for size in (20_000, 100_000, 500_000, 3_000_000):
        raw = long_prose(1, consonants, vowels, size).encode()
        assert len(raw) > size - 4
        ratio, _, bad, fits = quality_rules.compression_ok(raw, bands, zc)
        assert fits and not bad, (lang, size, ratio)
    text = long_prose(2, consonants, vowels, 100_000)
    assert quality_rules.judge(text, bands, zc)[6]
    words = text.split()[:40]
    rng = random.Random(3)
    salad = " ".join(rng.choice(words) for _ in range(30_000)).encode()
    assert not quality_rules.compression_ok(salad, bands, zc)[3]


# ---- 7 and 9


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    y = np.array(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality_classifier(spark):
    rng = random.Random(8)
    texts = [prose(rng, 60) if i % 3 else " ".join(w + "%%%" for w in prose(rng, 50).split()) for i in range(300)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (0, None, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, texts).selectExpr("*", "1 as score")
    got = {r["doc_id"]: r for r in quality_classifier.quality_classifier(docs, labels, quality_classifier.Settings(sample=200, epochs=3)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in range(300) if got[i]["held_out"]] == held
    assert auc([int(i % 3 > 0) for i in held], np.array([got[i]["score"] for i in held])) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(texts)
    assert quality_classifier.quality_classifier(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_features_cover_whole_words():
    s = quality_classifier.Settings()
    rng = random.Random(12)
    signs = [chr(0x4E00 + rng.randrange(2000)) for _ in range(3000)]
    for w in ("".join(signs), "x" * 70 + "yz", "http://a.x/" + "p/q" * 100):
        feats = quality_classifier.Features(s)
        mark = b"<" + w.encode() + b">"
        grams = [zlib.crc32(mark[i : i + k], k) % s.buckets for k in s.grams for i in range(len(mark) - k + 1)]
        assert feats.word(w.encode()).tolist() == [zlib.crc32(w.encode()) % s.buckets, *grams]
        assert not feats.words
    same = "".join(signs[:40])
    rows = [(same + "".join(rng.choice(signs[100:200] if i % 2 else signs[200:300]) for _ in range(200)), i % 2) for i in range(200)]
    model = quality_classifier.fit(rows[:150], s)
    scorer = quality_classifier.Scorer(model)
    assert auc([y for _, y in rows[150:]], np.array([scorer.score(t) for t, _ in rows[150:]])) > 0.95
    w = rows[150][0]
    ids, share = quality_classifier.Features(s).text(w)
    assert abs(scorer.score(w) - 1 / (1 + np.exp(-(share @ model.weight[ids] + model.bias)))) < 1e-5


def test_toxicity(spark):
    rng = random.Random(9)

    def toxic(i):
        w = prose(rng, 60).split()
        for _ in range(4):
            w.insert(rng.randrange(60), rng.choice(["idiot", "pathetic", "zorgling", "zorgmar", "trash"]))
        return " ".join(w)

    texts = [toxic(i) if i % 4 == 0 else prose(rng, 60) for i in range(400)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(documents(spark, texts), labels).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in held)
    assert got[400]["predicted"] == got[401]["predicted"] == 0
    assert toxicity.toxicity(documents(spark, texts).limit(0), labels.limit(0)).count() == 0


def test_label_model_finds_accurate_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3

    def voter(right):
        return np.where(rng.random(4000) < right, np.where(y, 1, -1), np.where(y, -1, 1))

    good, fair, weak, coin = voter(0.95), voter(0.85), voter(0.75), np.where(rng.random(4000) < 0.5, 1, -1)
    v = np.array([good, fair, coin, coin, coin, weak]).T
    found = toxicity.label_model(v, 0.3, 60)
    # what Bayes' rule gives with the rates that made the votes, copies counted once
    z = sum(np.log(r / (1 - r)) * c for r, c in ((0.95, good), (0.85, fair), (0.75, weak))) + np.log(0.3 / 0.7)
    assert ((found.posterior > 0.5) == (z > 0)).mean() > 0.97
    assert found.rates[1, 0, 2] > 0.82 and found.rates[1, 1, 2] > 0.75 and abs(found.rates[1, 2, 2] - 0.5) < 0.1
    up = dict(found.tree)
    assert sum({j, up[j]} <= {2, 3, 4} for j in (2, 3, 4) if up[j] >= 0) == 2  # the copies hang on each other


def test_posterior_against_the_joint_tables():
    """The posterior of each row by multiplying the estimated tables along the tree, vote by vote."""
    rng = np.random.default_rng(2)
    v = rng.integers(-1, 2, (300, 4))
    v[:, 1] = np.where(rng.random(300) < 0.8, v[:, 0], v[:, 1])
    found = toxicity.label_model(v, 0.4, 400, least=0.0)
    for row, p in zip(v[:40], found.posterior[:40], strict=True):
        mass = []
        for c, prior in ((0, 0.6), (1, 0.4)):
            m = prior
            for j, up in found.tree:
                a = row[j] + 1
                m *= found.rates[c, j, a] if up < 0 else found.pairs[c, up, row[up] + 1, j, a] / found.pairs[c, up, row[up] + 1, j].sum()
            mass.append(m)
        assert abs(mass[1] / sum(mass) - p) < 5e-3


def plain_hits(text, words):
    """Of each word how often it stands alone, of each stem how often a word begins with it."""
    found = {}
    for w in re.findall(r"\w+", text.lower()):
        for k in words:
            if w == k or (k.endswith("*") and w.startswith(k[:-1])):
                found[k] = found.get(k, 0) + 1
    return found


def test_toxicity_hits_against_a_plain_search():
    rng = random.Random(41)
    words = ("idiot", "idiots", "lose*", "crétin", "mor*", "moron")
    reader = toxicity.Reader(words, (0, 0, 9, 6, 9, 0))
    for _ in range(300):
        t = "".join(rng.choice(["idiot", "idiots", "Loser", "crétin", "MORON", "mor", "x", " ", "-", "_", ", ", "é", "1", "\n"]) for _ in range(rng.randint(0, 30)))
        assert {words[i]: n for i, n in reader.hits(t).items()} == plain_hits(t, words)


def test_toxicity_on_odd_rows(spark):
    rng = random.Random(43)
    bad = "you are a pathetic worthless idiot and a stupid clown"
    rows = [(i, f"{prose(rng, 40)} {bad}" if i % 5 == 0 else prose(rng, 40)) for i in range(200)]
    rows += [(3, "repeated id, other text"), (3, prose(rng, 10)), (None, bad), (900, prose(rng, 200_000)), (901, prose(rng, 100_000) + f" {bad}" * 20_000), (902, bad), (902, bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as held_out", "3 as _t", "4 as _id", "5 as _y")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)] + [(900, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["predicted"])
    assert by_id[902] == [1, 1] and by_id[901] == [1] and by_id[900] == [0] and by_id[None] == [1] and by_id[3] == [0, 0, 0]
    quality = quality_classifier.quality_classifier(df, labels, quality_classifier.Settings(sample=50, epochs=1)).collect()
    assert len(quality) == len(rows) and len({r["score"] for r in quality if r["doc_id"] == 902}) == 1


def test_labelled_sample_is_bounded_and_fixed(spark):
    rows = [(i, f"text {i}") for i in range(100)] + [(1, "b"), (1, "a"), (2, None), (101, "x" * 100), (None, "y")]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(102)] + [(7, 0, 1), (7, 0, 0), (None, 1, 1), (8, 0, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = labelled_sample(docs, labels, "toxic", 1000, 50)
    assert got == labelled_sample(docs.repartition(5), labels.repartition(3), "toxic", 1000, 50)
    assert {t for t, _ in got} == {("a" if i == 1 else f"text {i}") for i in range(100) if zlib.crc32(str(i).encode()) % 5}
    assert len(labelled_sample(docs, labels, "toxic", 10, 50)) <= 10


def naive_score(model, text):
    """The mean over all features of a text, one by one."""
    s = model.settings
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    firsts, total, n = [], 0.0, 0
    for w in words:
        mark = b"<" + w + b">"
        ids = [zlib.crc32(w)] + [zlib.crc32(mark[i : i + k]) for k in s.grams for i in range(len(mark) - k + 1)]
        raw = [zlib.crc32(w) % s.buckets] + [zlib.crc32(mark[i : i + k], k) % s.buckets for k in s.grams for i in range(len(mark) - k + 1)]
        assert len(ids) == len(raw)
        firsts.append(raw[0])
        total += sum(float(model.weight[i]) for i in raw)
        n += len(raw)
    for a, b in zip(firsts, firsts[1:], strict=False):
        i = 1 if a == b else (((a * 0x9E3779B1 + b * 0x85EBCA77) & 0xFFFFFFFFFFFFFFFF) >> 7) % s.buckets
        total += float(model.weight[i])
        n += 1
    z = (total / n if n else 0.0) + model.bias
    return 1 / (1 + np.exp(-z))


def test_quality_scores_against_a_plain_mean():
    rng = random.Random(45)
    rows = [(prose(rng, 30), 1) if i % 2 else (" ".join(w + "%%" for w in prose(rng, 30).split()), 0) for i in range(60)]
    model = quality_classifier.fit(rows, quality_classifier.Settings(epochs=2))
    scorer = quality_classifier.Scorer(model)
    for t in [*(t for t, _ in rows[:20]), *odd_texts(), "a a a a", "x" * 500 + " y", "é漢 😀"]:
        assert abs(scorer.score(t) - naive_score(model, t)) < 1e-5


# ---- 8


def brute_hits(texts, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    df = Counter(x for t in texts.values() for x in cut(t))
    for d, t in texts.items():
        w, hit, ids = cut(t), set(), set()
        for i, x in items:
            iw = cut(x)
            k = min(13, len(iw))
            for s in range(max(1, len(iw) - 12)) if iw else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == iw[s : s + k]:
                        hit.update(range(p, p + k))
                        ids.add(str(i))
        joined = ",".join(sorted(ids))
        near = {str(i) for i, x in items if i is not None and is_near(w, rare_words(cut(x), df))}
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), len(near))
    return out


def rare_words(words, df):
    return sorted(set(words), key=lambda x: (df[x], x.encode()))[:3]


def is_near(words, rare, slop=20):
    places = [[p for p, x in enumerate(words) if x == r] for r in rare]
    return bool(rare) and any(all(any(abs(q - p) <= slop for q in other) for other in places[1:]) for p in places[0])


def test_decontaminate(spark):
    rng = random.Random(10)
    items = [(i, prose(rng, rng.choice([3, 13, 14, 20, 40]))) for i in range(12)] + [(12, None), (13, ""), (14, "--"), (15, "the the the the the"), (0, "other words here now")]
    texts = {}
    for d in range(60):
        w = prose(rng, rng.choice([5, 40, 300])).split()
        for _ in range(rng.randint(0, 3)):
            x = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, 3)
            w[(at := rng.randrange(len(w))) : at] = x[a : len(x) - rng.randint(0, 2)]
        texts[d] = " ".join(x.upper() if rng.random() < 0.1 else x + rng.choice(["", ",", " - "]) for x in w)
    texts |= {60: None, 61: "", 62: "the the the the the the the", 63: texts[5]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as key", "2 as item", "3 as pos", "4 as words")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as id")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == brute_hits(texts, items)
    clean = {r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()}
    assert clean == {d for d, v in got.items() if not v[4]}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


def test_clean_documents_keep_clashing_columns(spark):
    rng = random.Random(51)
    item = prose(rng, 20)
    rows = [(1, item), (1, prose(rng, 30)), (None, item), (2, None), (3, ""), (4, prose(rng, 200_000)), (5, prose(rng, 100_000) + " " + item), (6, f"{item} {item}"), (6, f"{item} {item}")]
    names = ["_bad", "key", "row", "item", "pos", "words", "spans", "ids", "id", "w", "term"]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"'mine' as {c}" for c in names))
    bench = spark.createDataFrame([(1, item), (1, None), (None, item)], "item_id long, text string")
    out = decontaminate.clean_documents(df, bench)
    assert out.columns == df.columns
    got = out.collect()
    assert all(r[c] == "mine" for r in got for c in names)
    assert sorted((str(r["doc_id"]), len(r["text"] or "")) for r in got) == sorted((str(i), len(t or "")) for i, t in rows if (i, t) in {(1, rows[1][1]), (2, None), (3, ""), (4, rows[5][1]), (5, rows[6][1])})


def test_searches_share_a_stored_index(spark, tmp_path):
    texts = [(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 40 + "beta gamma"), (3, "gamma beta alpha"), (4, "x alpha beta gamma x"), (5, None), (4, "x alpha beta gamma x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = decontaminate.bench_items(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    keys = {r["k"]: r["doc_id"] for r in docs.select("doc_id", decontaminate.document_key("doc_id", "text").alias("k")).collect()}
    counts = decontaminate.term_counts(docs, items.selectExpr("explode(words) as term").distinct())
    win, rare = decontaminate.windows(items, counts), decontaminate.rare_words(items, counts)
    terms = decontaminate.anchors_of(win).select("term").unionByName(rare.select("term")).distinct()
    few = decontaminate.build_index(docs, terms, path=f"file://{tmp_path}/few")
    many = decontaminate.build_index(docs, terms, path=f"file://{tmp_path}/many", most_rows=0)
    everything = decontaminate.build_index(docs, path=f"file://{tmp_path}/all")
    assert {tuple(map(str, r)) for r in few.collect()} == {tuple(map(str, r)) for r in many.collect()} <= {tuple(map(str, r)) for r in everything.collect()}
    for index in (few, many, everything, spark.read.parquet(f"file://{tmp_path}/few")):
        assert {keys[r["key"]] for r in decontaminate.proximity_matches(index, rare, slop=10).collect()} == {1, 3, 4}
        assert {(keys[r["key"]], r["first"], r["last"]) for r in decontaminate.phrase_matches(index, win).collect()} == {(4, 1, 3)}


# ---- 10


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = odd_texts() + ["x <|endoftext|> y", "tail \n", "it's  two"]
    docs = documents(spark, texts).selectExpr("*", "1 as part", "2 as start", "3 as names").repartition(5)
    path = f"file://{tmp_path}/store"
    got = {r["doc_id"]: r for r in token_store.token_store(docs, path).collect()}
    tok, start = Tokenizer.from_file(token_store.default_tokenizer()), 0
    ids_back = {r["doc_id"]: r["ids"] for r in token_store.read_documents(spark, path).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4"))), i
        assert ids_back[i] == ids
        start += len(ids)
    assert token_store.token_store(docs.limit(0), f"file://{tmp_path}/none").count() == 0
    twice = spark.createDataFrame([(4, "a"), (4, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r["start"], r["n_tokens"]) for r in token_store.token_store(twice, f"file://{tmp_path}/twice").collect()) == [(0, 2), (2, 2), (4, 2)]


def test_encoder_gives_the_librarys_ids():
    from tokenizers import Tokenizer

    rng = random.Random(53)
    parts = ["a", "The", "dogs'", "it's", "don't", "x%%%", ",", ".", "!!", " ", "  ", "\n", "\n\n", "é", "É,", "×,", "漢", "漢,", "😀", "12", "3.5", "\t", "word,", "[a]", "(b)", "\u0301", "ª,", "²,", "_", "__x", "'s", "'ll ", "’s", "ﬁ,", "ǅ.", "Ⅷ,", "\u200b,", "\xa0"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [None, ""]
    tok, enc = Tokenizer.from_file(token_store.default_tokenizer()), token_store.Encoder(token_store.default_tokenizer(), most=500)
    for k in range(0, len(texts), 700):
        for t, ids in zip(texts[k : k + 700], enc.batch(texts[k : k + 700]), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def test_repeated_documents_are_repeated(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "LOT", 7)
    rows = [(1, "same text")] * 23 + [(1, "other"), (-5, None), (-5, ""), (None, "x"), (None, "x")] + [(2, "z")] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = f"file://{tmp_path}/store"
    got = sorted(tuple(r) for r in token_store.token_store(docs, path).select("start", "doc_id", "n_tokens").collect())
    assert [i for _, i, _ in got] == [None, None, -5, -5, *[1] * 24, *[2] * 7]
    assert [s for s, _, _ in got] == [sum(n for *_, n in got[:k]) for k in range(len(got))]


def test_tokenizers_that_cut_otherwise(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Plain words and more", "a  b\n c", " x", "", None, "The OLD house, 12 rooms"]
    word = public_tokenizers.path("word_bpe_49k.json")
    form = json.load(open(token_store.default_tokenizer()))
    form["pre_tokenizer"]["add_prefix_space"] = True
    spaced = tmp_path / "spaced.json"
    spaced.write_text(json.dumps(form))
    for path in (word, str(spaced), token_store.default_tokenizer()):
        tok, enc = Tokenizer.from_file(path), token_store.Encoder(path)
        assert [np.frombuffer(b, "<u2").tolist() for b in enc.batch(texts)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    with pytest.raises(ValueError, match="fit"):
        token_store.Encoder(word, width=1)


def test_chunks_are_stored_once(spark, tmp_path):
    rng = random.Random(11)
    text = prose(rng, 5000)
    docs = documents(spark, [text, text, "new start " + text]).repartition(3)
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path)
    chunks = token_store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("name").distinct().count()
    used = sum(r["n_chunks"] for r in token_store.verify(spark, path).collect())
    assert chunks.count() <= used / 2


def test_merkle_and_crc():
    names = [bytes([i]) * 32 for i in range(5)]
    assert len({token_store.merkle(names[:k]) for k in range(6)}) == 6
    a, b = b"abc" * 33, b"xy" * 50
    assert token_store.combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_a_worker_gives_back_what_it_has_freed():
    """Small blocks below one that is still in use stay with a process unless it is asked to give them back."""

    def used() -> float:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    class Here:
        def mapInArrow(self, run, schema):
            return list(run(iter([1])))

    kept = []

    def fill(it):
        for b in it:
            blocks = [np.ones(8000) for _ in range(2000)]
            kept.append(blocks[-1])
            del blocks
            yield b

    before = used()
    assert arrow_pass(Here(), fill, "id long") == [1]
    assert used() - before < 60
